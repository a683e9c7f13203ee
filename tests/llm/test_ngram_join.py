"""The n-gram join against brute force over all pairs."""

import random

import numpy as np
import pytest

from sitefold.llm import ngram_join as nj
from sitefold.llm.common import WordHashes, shingles, word_hashes


def near_copies(rng, n):
    """Texts in groups: exact copies, copies with a few other words, and texts of their own."""
    vocabulary = [f"w{k}" for k in range(400)]
    docs = []
    while len(docs) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 30, 120, 300]))]
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
            docs.append(text.upper() if rng.random() < 0.1 else text)
    return docs[:n]


def brute(docs, threshold=nj.THRESHOLD):
    memo = WordHashes()
    sets = {i: set(shingles(word_hashes(t, memo), nj.WORDS).tolist()) for i, t in docs}
    links, parent = {i: 0 for i in sets}, {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and shared / len(sets[a] | sets[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (root(i), links[i]) for i in sets}


@pytest.mark.parametrize("block", [(1024, 2_000_000), (4, 2_000_000), (1024, 500)])
def test_links_and_groups_match_brute_force(make_docs, block):
    docs = list(enumerate(near_copies(random.Random(5), 300)))
    found = nj.ngram_join(make_docs(docs), block_members=block[0], block_shingles=block[1]).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == brute(docs)


def test_one_stays_of_each_group(make_docs):
    docs = list(enumerate(near_copies(random.Random(6), 200)))
    kept = nj.keep_one_per_group(make_docs(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in brute(docs).values()})


def test_ids_of_several_texts_are_told_apart(make_docs):
    """Brute force over rows; a group has the smallest id of its rows."""
    texts = near_copies(random.Random(7), 150)
    docs = [(k % 110, t) for k, t in enumerate(texts)]
    by_row = brute(list(enumerate(texts)))
    first = {}
    for row, (group, _) in by_row.items():
        first[group] = min(first.get(group, 10**9), docs[row][0])
    want = sorted((docs[row][0], first[group], n) for row, (group, n) in by_row.items())
    found = nj.ngram_join(make_docs(docs)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == want
    assert any(a[0] == b[0] and a[1] != b[1] for a, b in zip(want, want[1:]))
    kept = sorted((r["doc_id"], r["text"]) for r in nj.keep_one_per_group(make_docs(docs)).collect())
    assert kept == sorted((d, t) for row, (d, t) in enumerate(docs) if first[by_row[row][0]] == d)


def test_posterior_is_the_beta_tail():
    grid = (np.arange(200_000) + 0.5) / 200_000
    for m, n in ((20, 32), (25, 32), (60, 96), (128, 160)):
        density = grid**m * (1 - grid) ** (n - m)
        want = density[grid >= 0.8].sum() / density.sum()
        assert abs(nj.posterior_reaches(m, n) - want) < 1e-4
    least = nj.least_matches(0.8, 1e-6)
    assert [n for n, _ in least] == [32, 64, 96, 128, 160]
    assert all(nj.posterior_reaches(m, n) >= 1e-6 > nj.posterior_reaches(m - 1, n) for n, m in least)


def test_components(spark):
    rng = random.Random(2)
    edges = [(k + 1, k) for k in range(40)] + [(100 + k, 100) for k in range(1, 30)]
    edges += [(b, a) for a, b in (sorted(rng.sample(range(200, 300), 2)) for _ in range(60))]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    labels = {r["node"]: r["label"] for r in nj.connected(df).collect()}
    want = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert labels == want
    assert nj.connected(df.limit(0)).count() == 0

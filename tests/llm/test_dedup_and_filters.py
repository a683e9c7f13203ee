"""Exact and substring deduplication, decontamination and the classifier."""

import os
import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from sitefold.llm import decontaminate as dc, exact_dedup as ed, quality as q, queries, substring_dedup as sd
from sitefold.llm.common import WordHashes
from sitefold.session import scratch_path

SMALL = "/root/testdata/sf0.01"


def test_exact_groups(spark, make_docs):
    rng = random.Random(1)
    docs = [(k, rng.choice(["a", "b", "A", "a ", None, "", f"own{k}"])) for k in range(400)]
    groups = defaultdict(list)
    for k, t in docs:
        groups[t or ""].append(k)
    rows = ed.exact_dedup(make_docs(docs), ed.new_index(spark)).collect()
    assert len(rows) == 400
    for r in rows:
        mine = groups[dict(docs)[r["doc_id"]] or ""]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(mine), len(mine), r["doc_id"] == max(mine))
        assert r["text_sha256"] == sha256((dict(docs)[r["doc_id"]] or "").encode()).hexdigest()


def test_index_outlives_a_batch(spark, make_docs):
    path = scratch_path(spark, "index")
    index = ed.DigestIndex(spark, path, 4)
    ed.exact_dedup(make_docs([(1, "x"), (2, "x"), (3, "y")]), index).collect()
    spark.sql(f"DROP TABLE {index.table}")  # as a later session would find it
    again = ed.DigestIndex(spark, path, 4)
    rows = ed.exact_dedup(make_docs([(8, "x"), (9, "z")]), again).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in rows) == [(8, 2, False), (9, 9, True)]
    assert again.entries().count() == 3
    plan = again.new(ed.digests(make_docs([(1, "x")])))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # only the new side moves


def test_drop_copies_leaves_one_row(spark, make_docs):
    docs = make_docs([(1, "x"), (2, "x"), (2, "x"), (3, None), (4, ""), (5, "y"), (5, "z")])
    kept = ed.drop_copies(docs, ed.new_index(spark))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(2, "x"), (4, ""), (5, "y"), (5, "z")]


@pytest.mark.parametrize("buckets", [2, 4, 16])
def test_index_keeps_its_number_of_buckets(spark, make_docs, buckets):
    path = scratch_path(spark, "index")
    docs = [(k, f"text {k % 300}") for k in range(1000)]
    index = ed.DigestIndex(spark, path, 4)
    want = sorted(map(tuple, ed.exact_dedup(make_docs(docs), index).collect()))
    spark.sql(f"DROP TABLE {index.table}")  # a new session with other settings
    again = ed.DigestIndex(spark, path, buckets)
    assert again.buckets == 4
    assert sorted(map(tuple, ed.exact_dedup(make_docs(docs), again).collect())) == want
    assert again.entries().count() == 300


def test_index_without_its_number_of_buckets_is_refused(spark, make_docs):
    path = scratch_path(spark, "index")
    ed.exact_dedup(make_docs([(1, "x")]), ed.DigestIndex(spark, path, 4)).collect()
    os.remove(f"{path}/_buckets")
    with pytest.raises(ValueError):
        ed.DigestIndex(spark, path, 4)


def brute_clean(docs, size=sd.SPAN):
    seen, cleaned = {}, {}
    for doc_id, text in sorted(docs):
        parts = sd.sentences(text)
        keys = [" ".join(p.lower().split()) for p in parts]
        drop = [False] * len(parts)
        for k in range(len(keys) - size + 1):
            first = seen.setdefault(tuple(keys[k : k + size]), (doc_id, k))
            if first != (doc_id, k):
                drop[k : k + size] = [True] * size
        cleaned[doc_id] = "".join(p for p, d in zip(parts, drop) if not d), sum(drop)
    return cleaned


def test_substring_dedup_matches_brute_force(make_docs):
    rng = random.Random(2)
    pool = [f"Sentence {k} of the pool." for k in range(40)] + ["Why?", "No!", "line without end\n"]
    passage = " ".join(pool[:6])
    docs = []
    for k in range(150):
        parts = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.4:
            parts.insert(rng.randrange(len(parts) + 1), passage)
        docs.append((k, " ".join(parts)))
    found = sd.substring_dedup(make_docs(docs)).collect()
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in found} == brute_clean(docs)


def brute_registered(docs, size=sd.SPAN, least=sd.LEAST_WORDS):
    """Sentence spans of enough words, whole short texts and runs of words, by plain loops."""
    seen, cleaned = {}, {}
    for doc_id, text in sorted(docs):
        parts = sd.sentences(text)
        words = [p.lower().split() for p in parts]
        starts = [sum(map(len, words[:k])) for k in range(len(parts) + 1)]
        spans = [(k, k + 1, ("s", tuple(words[k]))) for k in range(len(parts)) if len(words[k]) >= sd.RUN]
        if len(parts) < size and any(words):
            spans.append((0, len(parts), ("s", *map(tuple, words))))
        else:
            spans += [(k, k + size, ("s", *map(tuple, words[k : k + size]))) for k in range(len(parts) - size + 1)
                      if starts[k + size] - starts[k] >= least]
        flat = [w for p in words for w in p]
        places = [(starts[a], starts[b], key) for a, b, key in spans]
        places += [(k, k + sd.RUN, ("w", *flat[k : k + sd.RUN])) for k in range(len(flat) - sd.RUN + 1)]
        drop = [False] * len(flat)
        for a, b, key in places:
            first = seen.setdefault(key, (doc_id, a))
            if first != (doc_id, a):
                drop[a:b] = [True] * (b - a)
        tokens = [m for m in re.finditer(r"\S+\s*", text)]
        kept = (text[: tokens[0].start()] if tokens and not drop[0] else "") + "".join(t[0] for t, d in zip(tokens, drop) if not d)
        cleaned[doc_id] = (kept if any(drop) else text, sum(drop))
    return cleaned


def test_the_registered_form_matches_brute_force(make_docs):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    short = [" ".join(rng.sample(words, rng.randint(1, 9))) + "." for _ in range(30)]
    passages = [" ".join(rng.sample(words, n)) for n in (30, 50, 51, 52, 80, 120)]
    docs = []
    for k in range(160):
        parts = [rng.choice(short) for _ in range(rng.randint(0, 8))]
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(passages).split()
            cut = rng.choice([0, 0, 3])
            parts.insert(rng.randrange(len(parts) + 1), " ".join(rng.sample(words, 3) + passage[cut:]) + rng.choice([".", "", "!"]))
        docs.append((k, rng.choice([" ", "\n", "  "]).join(parts)))
    docs += [(200, docs[3][1]), (201, docs[4][1].upper()), (202, "Short one."), (203, "short  one."), (204, "")]
    found = sd.substring_dedup(make_docs(docs), whole_texts=True, least_words=sd.LEAST_WORDS).collect()
    want = brute_registered(docs)
    assert sum(n for _, n in want.values()) > 500
    assert {r["doc_id"]: (r["text"], r["n_words_removed"]) for r in found} == want


def test_the_query_takes_spans_of_few_words(spark, make_docs, tmp_path):
    """Runs of two short sentences repeat, too; beyond them a text of two short sentences is one."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    short = [" ".join(rng.sample(words, rng.randint(1, 8))) + rng.choice([".", "!", "?"]) for _ in range(12)]
    passage = " ".join(rng.sample(words, 60))
    docs = []
    for k in range(120):
        parts = [rng.choice(short) for _ in range(rng.randint(0, 6))]
        parts += [" ".join(rng.sample(words, rng.randint(1, 40))) + "."] * (k % 3)
        parts += [passage] * (k % 10 == 0)
        docs.append((k, rng.choice([" ", "\n"]).join(parts)))
    docs += [(200, "One copy. Of few words."), (201, "one  COPY. of few words."), (202, "Own one. Of few words.")]
    make_docs(docs).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op8_substring_dedup(spark, str(tmp_path)).collect()
    want = brute_registered(docs, least=0)
    assert want[200] == (docs[-3][1], 0) and want[201] == ("", 5) and want[202] == (docs[-1][1], 0)
    assert sum(n > 0 for _, n in want.values()) > sum(n > 0 for _, n in brute_registered(docs).values()) + 20
    assert {r["doc_id"]: (r["text"], r["n_words_removed"]) for r in found} == want


def test_rows_with_a_null_id_stay_whole():
    """Also where the filter of ids lets them through."""
    text = "One two. Three four. One two. Three four."
    columns = [pa.array([None, 1], pa.int64()), pa.array([text, text]), pa.array([None, []], pa.list_(pa.int64())), pa.array([None, False])]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "known", "inner_run"])
    (found,) = sd._cleaned(2, True, 0)([batch])
    assert found.column("text").to_pylist() == [text, "One two. Three four. "]
    assert found.column("n_removed").to_pylist() == [0, 2]


def test_whole_sentences_go_as_their_words_do():
    rng = random.Random(12)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "b c", ".", "!", "? ", "\n", " ", "\n\n", "\x1c", "\u3000", "Σ.", "İ"]) for _ in range(rng.randint(1, 20)))
        counts = sd.hashed_words(text)[0]
        whole = np.array([rng.random() < 0.5 for _ in counts])
        if text.strip() and whole.any():
            assert sd._without_sentences(text, whole) == sd._without(text, np.repeat(whole, counts).astype(np.int8))


def test_sentences_cover_the_text():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "b c", ".", "!", "? ", "\n", " ", "\n\n"]) for _ in range(rng.randint(0, 20)))
        assert "".join(sd.sentences(text)) == text


def brute_overlap(doc, item, least=dc.MIN_WORDS, share=dc.MIN_EQUAL):
    a, b = re.findall(r"\w+", doc.lower()), re.findall(r"\w+", item.lower())
    if len(b) < 2:
        return bool(b) and a == b
    size = min(least, len(b))
    share = 1.0 if size < dc.SPAN else share
    return any(
        sum(x == y for x, y in zip(a[i : i + size], b[j : j + size])) >= share * size
        for i in range(len(a) - size + 1) for j in range(len(b) - size + 1)
    )


def test_decontamination_finds_substituted_passages(spark, make_docs):
    rng = random.Random(4)
    words = [f"v{k}" for k in range(3000)]
    items = [" ".join(rng.sample(words, n)) for n in (5, 9, 12, 15, 30, 60)]
    docs = []
    for k in range(120):
        text = rng.sample(words, 40)
        if k % 3:
            part = rng.choice(items).split()
            start = rng.randrange(max(1, len(part) - 20))
            part = part[start : start + 25]
            for at in range(rng.randrange(5), len(part), rng.choice([5, 7, 9, 100])):
                part[at] = "other"  # one word in five at most
            at = rng.randrange(40)
            text[at:at] = [w.upper() for w in part]
        docs.append((k, ", ".join(text)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {r["doc_id"]: r["contaminated"] for r in dc.decontaminate(make_docs(docs), bench).collect()}
    want = {k: any(brute_overlap(t, i) for i in items) for k, t in docs}
    assert found == want and 40 < sum(want.values()) < 110


def test_short_items_have_to_occur_word_for_word(spark, make_docs):
    items = ["Zebra", "red fox", "one two three four five six seven", "the cat sat", "", "red, FOX!", None]
    docs = ["zebra", "a zebra", "a red fox ran", "red old fox", "xx one two three four five six seven",
            "one two three four five six", "one two three four five other seven", "the cat sat", "the cat", "", "Zebra."]
    bench = spark.createDataFrame([*enumerate(items), (2, "the cat sat"), (None, "a red")], "item_id bigint, text string")
    rows = dc.overlaps(make_docs(list(enumerate(docs))), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["words_equal"]) for r in rows) == [
        (0, 0, 1), (2, 1, 2), (2, 5, 2), (4, 2, 7), (7, 2, 3), (7, 3, 3), (10, 0, 1)]
    found = {r["doc_id"]: r["n_items"] for r in dc.decontaminate(make_docs(list(enumerate(docs))), bench).collect()}
    assert found == {0: 1, 1: 0, 2: 2, 3: 0, 4: 1, 5: 0, 6: 0, 7: 2, 8: 0, 9: 0, 10: 1}
    kept = dc.drop_contaminated(make_docs(list(enumerate(docs))), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 8, 9]


def test_masks_ignore_each_position_and_each_pair_five_apart():
    ignored = [{p for p in range(dc.SPAN) if m[p] == "0"} for m in dc.MASKS]
    for p in range(dc.SPAN):
        assert any({x for x in (p, p + 5) if x < dc.SPAN} <= s for s in ignored)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = q.quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50 and np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.93
    assert all(r["predicted"] == 1 for r in held if r["quality"] == 1)
    kept = {r["doc_id"] for r in q.keep_accepted(docs, labels).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in q.quality(docs, labels).filter("predicted = 1").collect()}


def test_labels_other_than_the_sample_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    flipped = labels.withColumn("quality", q.F.when(q.held_out(q.F.col("doc_id")), 1 - q.F.col("quality")).otherwise(q.F.col("quality")))
    assert (q.train(docs, labels) == pytest.approx(q.train(docs, flipped), abs=1e-12))


@pytest.mark.parametrize("rows", [0, 1, 7, 500, 4999, 5000, 9000])
def test_the_sample_is_that_of_the_smallest_hashes(spark, rows, monkeypatch):
    monkeypatch.setattr(q, "_LOOK_BITS", 3)  # several looks
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    want = [r[0] for r in ids.orderBy(q.F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    assert [r[0] for r in q.smallest_hashes(ids, rows).collect()] == want


def test_sharded_training_matches_a_plain_loop(spark, make_docs):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(words[: 40 if k % 2 else 60], k=rng.randint(0, 30)))) for k in range(150)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in docs], "doc_id bigint, quality int")
    made = spark.createDataFrame([(k,) for k, _ in docs], "doc_id bigint")
    dealt = made.select("doc_id", q.F.expr(f"pmod(xxhash64(doc_id, -1), {q.SHARDS})").alias("shard"),
                        *[q.F.xxhash64("doc_id", q.F.lit(r)).alias(f"r{r}") for r in range(q.ROUNDS)]).collect()
    rows = {k: (*q.features(t, WordHashes()), k % 2) for k, t in docs if zlib.crc32(str(k).encode()) % 5}
    z, n = np.zeros(q.WIDTH), np.zeros(q.WIDTH)
    for r in range(q.ROUNDS):
        states = []
        for shard in range(q.SHARDS):
            mine = sorted((d[f"r{r}"], d["doc_id"]) for d in dealt if d["shard"] == shard and d["doc_id"] in rows)
            if mine:
                own = z.copy(), n.copy()
                for _, k in mine:
                    index, value, label = rows[k]
                    w = q.weights(own[0][index], own[1][index])
                    slope = (1 / (1 + np.exp(-(w @ value))) - label) * value
                    step = (np.sqrt(own[1][index] + slope**2) - np.sqrt(own[1][index])) / q.ALPHA
                    own[0][index] += slope - step * w
                    own[1][index] += slope**2
                states.append(own)
        z, n = (np.mean([s[k] for s in states], axis=0) for k in (0, 1))
    assert np.allclose(q.train(make_docs(docs), labels), q.weights(z, n), atol=1e-9)


def test_ftrl_learns_a_separable_problem():
    rng = np.random.default_rng(0)
    rows = [(np.array([0, 1 + int(y)]), np.array([1.0, 1.0]), int(y)) for y in rng.integers(0, 2, 200)]
    z, n = np.zeros(q.WIDTH), np.zeros(q.WIDTH)
    q.ftrl(rows, z, n)
    w = q.weights(z, n)
    assert w[2] > 1 and w[1] < -1 and not w[3:].any()


def test_passages_of_51_words_go_wherever_they_begin_and_end(make_docs):
    rng = random.Random(5)

    def own(n):
        return [f"u{rng.randrange(10**9)}" for _ in range(n)]

    docs, want = [], {}
    for n_words in (50, 51, 60, 90):
        for cuts in ((), (20,), (15, 35)):  # the passage lies in one, two and three sentences
            for whole in (False, True):  # ends inside sentences or at their ends
                passage = own(n_words)
                for at in cuts:
                    passage[at] += "."
                if whole:
                    passage[-1] += "."
                for later in (False, True):
                    head, tail = own(30), own(30)
                    if whole:
                        head[-1] += "."
                    docs.append((len(docs), " ".join(head + passage + tail) + "."))
                    gone = later and (n_words > 50 or whole and cuts)
                    # ends at the ends of sentences, or the run of words is long enough
                    kept = head + ([] if gone else passage) + tail
                    want[docs[-1][0]] = " ".join(kept) + "."
    found = {r["doc_id"]: r["text"] for r in sd.substring_dedup(make_docs(docs)).collect()}
    # a passage of 50 words with one whole sentence inside is no span
    assert found == want


def test_whole_short_texts_are_spans(make_docs):
    long = " ".join(f"w{k}" for k in range(51)) + "."
    docs = [(1, "One short text."), (2, "one  short text."), (3, "One short text. And more."), (4, ""), (5, " "),
            (6, "A first. " + long), (7, long), (8, "A first."), (9, "Another. " + long + " Last.")]
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in sd.substring_dedup(make_docs(docs), whole_texts=True).collect()}
    assert found == {1: (docs[0][1], 0), 2: ("", 1), 3: (docs[2][1], 0), 4: ("", 0), 5: (" ", 0), 6: (docs[5][1], 0),
                     7: ("", 1), 8: ("A first.", 0), 9: ("Another. Last.", 1)}


def test_any_two_words_of_an_item_may_differ(spark, make_docs):
    items = {n: [f"i{n}_{k}" for k in range(n)] for n in (8, 9, 10, 11, 12, 13)}
    docs, want = [], {}
    for n, words in items.items():
        for a in range(n):
            for b in range(a, n):
                text = [w if k not in (a, b) else "other" for k, w in enumerate(words)]
                docs.append((len(docs), " ".join(["before", *text, "after"])))
                want[docs[-1][0]] = n >= 10 or a == b
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id bigint, text string")
    found = {r["doc_id"]: r["contaminated"] for r in dc.decontaminate(make_docs(docs), bench).collect()}
    assert found == want


def test_training_deals_the_shards_once(spark, make_docs, monkeypatch):
    """One shuffle of the vectors serves all rounds, and nothing stays on the executors' disks."""
    docs = make_docs([(k, f"word{k % 7} text{k % 2} more") for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, quality int")
    dealt, plain = [], type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, *a: dealt.append(a) or plain(self, *a))
    assert q.train(docs, labels).any()
    assert len(dealt) == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_sentences_are_told_apart_by_their_words_hashed_once():
    """One pass over a text gives words and sentences; spans are equal where the words are."""
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "Σ", "İ", ".", "!", " ", "\n", "\t", "\x1c", "\xa0", "b. "]) for _ in range(60))
        parts = [p.lower().split() for p in sd.sentences(text)]
        counts, words = sd.hashed_words(text)
        assert counts == [len(p) for p in parts] and len(words) == len(text.split())
        first, length, hashes = sd.spans(counts, words, 2)
        pairs = [tuple(map(tuple, parts[k : k + 2])) for k in first.tolist()]
        assert len(set(pairs)) == len(set(hashes.tolist())) == len(set(zip(pairs, hashes.tolist())))

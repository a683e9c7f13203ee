"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sitefold.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, most_words, least, top, covered=50):
    count, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for n in range(1, most_words + 1):
                for k in range(len(words) - n + 1):
                    count[lang, tuple(words[k : k + n])] += 1
    frequent = {k: v for k, v in count.items() if v >= least}
    out = []
    for lang in total:
        rated = []
        for (of, words), a in frequent.items():
            if of != lang or len(words) < 2:
                continue
            cuts = []
            for k in range(1, len(words)):
                l, r = frequent[lang, words[:k]], frequent[lang, words[k:]]
                cuts.append((1_000_000 * a * a // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            longer = [
                v for (o, w), v in frequent.items()
                if o == lang and len(w) > len(words) and any(w[k : k + len(words)] == words for k in range(len(w)))
            ]
            if not any(100 * v >= covered * a for v in longer):
                rated.append((-score, -a, " ".join(words).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def texts(seed, count):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "City", "a", "b", "ß", "中文", "x-y", "É", "Z'"]
    out = []
    for i in range(count):
        picked = rng.choices(words, weights=[9, 7, 3, 3, 2, 5, 5, 1, 1, 1, 1, 1], k=rng.randint(0, 60))
        joined = "".join(w + rng.choice([" ", " ", " ", "\t ", "  ", ". ", ",", "\n", "\r\n", "\x0b", "! "]) for w in picked)
        out.append((i, joined, rng.choice(["en", "de", None, "und"])))
    return out


@pytest.fixture(scope="session")
def make_phrases(spark):
    schema = "doc_id bigint, text string, lang string, words string, phrase string, n int, hash string, a int, rank int, key string"

    def make(rows):
        df = spark.createDataFrame([(*r, "w", "p", 1, "h", 2, 3, "k") for r in rows], schema)
        return df.repartition(4) if rows else df

    return make


def mined(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


# everything, some and nothing is proposed
@pytest.mark.parametrize("sample, most_words, least, top", [(1, 3, 10, 2000), (3, 4, 3, 25), (10**9, 3, 4, 2000), (3, 2, 2, 5)])
def test_equals_plain_counting(make_phrases, sample, most_words, least, top):
    rows = texts(most_words, 150)
    found = co.collocations(make_phrases(rows), most_words, least, top, sample=sample)
    assert mined(found) == brute(rows, most_words, least, top)


def test_a_small_filter_only_costs_time(make_phrases, monkeypatch):
    monkeypatch.setattr(co, "LEAST_BITS", 16)  # most phrases pass by chance
    monkeypatch.setattr(co, "MOST_BITS", 16)
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 3000}" for _ in range(400)), "en") for i in range(120)]
    assert mined(co.collocations(make_phrases(rows), 3, 4, 400)) == brute(rows, 3, 4, 400)


def test_odd_texts(make_phrases):
    long = "alpha beta " * 40_000
    rows = [(1, None, "en"), (2, "", None), (3, " \t ..,", "en"), (4, long, "en"), (None, "no id here " * 12, "en"),
            (5, "One" + "\x0c" + "two", "de"), (6, "w" * 50_000, "de"), (6, "w" * 50_000, "de"), (7, "ÀÉ Straße\x00x " * 15, "")]
    assert mined(co.collocations(make_phrases(rows))) == brute(rows, 3, 10, 2000)


def test_nothing_frequent(make_phrases):
    assert co.collocations(make_phrases([])).collect() == []
    assert co.collocations(make_phrases([(1, "one two three", "en"), (2, None, None)])).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_001, 3_000_000_007, 3_000_000_011
    counts = spark.createDataFrame(
        [("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)], "lang string, words int, phrase string, n long"
    )
    row = co.scored(counts).first()
    assert (row["a"], row["l"], row["r"], row["score"]) == (a, l, r, 1_000_000 * a * a // (l * r))


def test_ties_of_cuts_go_to_the_first(spark):
    counts = spark.createDataFrame(
        [("en", 1, "x", 20), ("en", 1, "y", 30), ("en", 1, "z", 20), ("en", 2, "x y", 12), ("en", 2, "y z", 12), ("en", 3, "x y z", 10)],
        "lang string, words int, phrase string, n long",
    )
    row = co.scored(counts).filter("words = 3").first()
    assert (row["l"], row["r"], row["score"]) == (20, 12, 1_000_000 * 100 // 240)


def test_words_of_a_chunk():
    grams = co.Grams(pa.array(["en", "de"]), pa.array(["A b, a\tb  c", "a b"]))
    assert [grams.words[int(k)].as_py() for k in grams.word_of] == ["a", "b", "a", "b", "c", "a", "b"]
    grams.grow(np.ones(len(grams.hash), bool))
    langs, phrases = grams.phrases(np.arange(len(grams.hash)))
    assert dict(zip(zip(langs.to_pylist(), phrases.to_pylist()), grams.counts().tolist())) == {
        ("en", "a b"): 2, ("en", "b c"): 1, ("de", "a b"): 1,
    }


class Value:
    def __init__(self, value):
        self.value = value


def batches(rows):
    half = len(rows) // 2
    for some in (rows[:half], rows[half:]):
        yield pa.record_batch([pa.array([r[2] or "und" for r in some]), pa.array([r[1] or "" for r in some])], names=["lang", "text"])


def test_one_pass_counts_what_the_sample_missed(make_phrases, monkeypatch):
    """Each failure may grow by a word; passes over all texts do not add up with the length."""
    written = []
    materialize = co.materialize
    monkeypatch.setattr(co, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    rows = texts(7, 120)
    assert mined(co.collocations(make_phrases(rows), 4, 3, 500, sample=10**9)) == brute(rows, 4, 3, 500)
    assert written.count("frequent") == 2


@pytest.mark.parametrize("pending", [1, 10**6])
def test_counts_leave_a_task_by_ranges(monkeypatch, pending):
    """Rows of a task are ranges of hashes, not phrases; their totals are exact up to the least count."""
    monkeypatch.setattr(co, "PENDING", pending)
    rows = [r for r in texts(9, 400) if r[1]]
    out = list(co._count_hashes(3, 1000, 4)(batches(rows)))
    if pending > 1:
        assert sum(b.num_rows for b in out) <= 3 * 16
    total = sum(int((np.frombuffer(c, np.uint64) & co._low(1000)).sum()) for b in out for c in b.column(2).to_pylist() if b.num_rows)
    plain = Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            plain.update((lang or "und", *words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1))
    if pending > 1:
        assert total == sum(min(n, 1000) for n in plain.values())
    else:
        assert total == sum(plain.values())


def test_languages_with_odd_names(make_phrases):
    rows = [(k, "one two three " * 12, lang) for k, lang in enumerate(["", "a\nb", "a", "\n", "en us", None])]
    assert mined(co.collocations(make_phrases(rows))) == brute(rows, 3, 10, 2000)


def test_ranges_follow_the_partitions(spark):
    """Rows between tasks are tasks times ranges: about as many as a shuffle has blocks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, bits in ((4, 7), (128, 7), (211, 8), (3000, 12)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            assert co._part_bits(spark) == bits
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

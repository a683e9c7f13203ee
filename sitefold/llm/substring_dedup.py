"""Removal of repeated passages by sliding sentence spans and word runs.

Every run of two consecutive sentences is hashed, as is every sentence of over 50 words.
Hashes meet in one global join; the first document (by id) that has a span keeps it, and
everywhere else the sentences it covers are removed, as are later repeats inside a document.

Passages whose ends lie inside sentences are found by their words: every run of 51 words
is a span, too, and later repeats lose just these words. A run can only be repeated if the
least hash among its runs of 26 words is, so those come first: there are few of them. A
bit filter of fixed size over the repeated ones is tested where the texts lie, and only
runs of 51 that may be repeated go through the join. It is exact: what the filter lets
through by chance meets no partner there.
"""

from __future__ import annotations

import re
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sitefold.llm.common import arrow_batch, combine, id_texts, texts
from sitefold.session import materialize, split_rows

SPAN = 2
#: A bound for callers who want to keep pairs of short stock sentences, which recur by chance; the
#: registered query sets none.
LEAST_WORDS = 26
#: Words of the shortest repeat that is removed whatever its sentences.
RUN = 51
SEED = (RUN + 1) // 2
FILTER_BITS = 27
_BITMAP = 32768  # bits of one bitmap of bitmap_construct_agg
_END = re.compile(r"[.!?\n](?:(?<=\n)|\s)\s*")
#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_TOKEN = re.compile(r"\S+")


def sentences(text: str) -> list[str]:
    """Sentences with the white space after them; together they are the text."""
    cuts = [m.end() for m in _END.finditer(text)]
    if cuts and not text[: cuts[0]].strip():
        del cuts[0]  # white space before the first sentence is its own
    if not cuts:
        return [text]
    if cuts[-1] < len(text):
        cuts.append(len(text))
    return [text[a:b] for a, b in zip([0, *cuts], cuts)]


def hashed_words(text: str) -> tuple[list[int], np.ndarray]:
    """Numbers of words of the sentences, and the hashes of all words; case and spacing are ignored.

    A text has the same sentences in lower case.
    """
    words, counts = [], []
    for sentence in sentences(text.lower()):
        before = len(words)
        words += sentence.split()
        counts.append(len(words) - before)
    return counts, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _powers(base: int, count: int) -> np.ndarray:
    powers = np.full(count, base, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def _sentence_keys(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of the sentences from those of their words: polynomials modulo 2**64, moved to power 0."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, len(words)), dtype=np.uint64)))
    ends = np.cumsum(counts)
    starts = ends - counts
    back = _powers(pow(_BASE, -1, 1 << 64), len(words) + 1)
    return combine([(sums[ends] - sums[starts]) * back[starts], counts.astype(np.uint64)])


def spans(counts: list[int], words: np.ndarray, size: int, whole_texts: bool = False, least_words: int = 0):
    """``(first sentence, number of sentences, hash)`` of the spans of a text, see :func:`hashed_words`.

    Spans are the runs of ``size`` sentences with ``least_words`` words or more, sentences of
    ``RUN`` words or more, and, if ``whole_texts``, all sentences of a text of fewer than ``size``.
    """
    n = len(counts)
    counts = np.array(counts, np.int64)
    keys = _sentence_keys(counts, words)
    at = np.flatnonzero(counts >= RUN) if size > 1 else np.empty(0, np.int64)
    found = [(at, np.ones(len(at), np.int64), combine([keys[at]]))]
    if n < size and whole_texts and len(words):
        size, least_words = n, 0
    # a text of one long sentence is a span already, and one span must not count twice
    last = 0 if n == size == 1 and len(at) else n - size + 1
    if last > 0:
        before = np.concatenate(([0], np.cumsum(counts)))
        at = np.flatnonzero(before[size:] - before[:last] >= least_words)
        found.append((at, np.full(len(at), size), combine([keys[k : k + last] for k in range(size)])[at]))
    first, length, hashes = (np.concatenate(x) for x in zip(*found))
    return first, length, hashes.astype(np.int64)


def _slide(values: np.ndarray, size: int, join) -> np.ndarray:
    """``join`` over all runs of ``size`` values, by doubling; shorter runs may overlap in it."""
    have = 1
    while have < size and len(values):
        step = min(have, size - have)
        values = join(values[:-step], values[step:])
        have += step
    return values


def runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``RUN`` words, of their hashes, and the least hash of the ``SEED`` words in each."""
    if len(words) < RUN:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pair = lambda a, b: combine([a, b])
    seeds = _slide(words, SEED, pair)
    step = RUN - SEED
    least = _slide(seeds, step + 1, np.minimum)
    # mixed again: the least ones are no even sample of all hashes
    return pair(seeds[:-step], seeds[step:]).astype(np.int64), combine([least]).astype(np.int64)


def changes(values: np.ndarray) -> np.ndarray:
    """``values`` without those that equal the one before: a seed is the least of many runs in a row."""
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def _spans(size: int, whole_texts: bool, least_words: int):
    """Spans and seeds of every text, and whether it repeats a span, and a run, of its own."""

    def run(batches):
        schema = pa.schema(
            [("doc_id", pa.int64()), ("spans", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64())), ("inner", pa.bool_()),
             ("inner_run", pa.bool_())]
        )
        for rows in id_texts(batches):
            out = []
            for doc_id, text in rows:
                counts, words = hashed_words(text)
                of_sentences = spans(counts, words, size, whole_texts, least_words)[2]
                of_words, seeds = runs(words)
                found = np.unique(of_sentences)
                inner_run = len(pd.unique(of_words)) < len(of_words)
                inner = inner_run or len(found) < len(of_sentences)
                out.append((doc_id, found.tolist(), np.unique(changes(seeds)).tolist(), inner, inner_run))
            yield arrow_batch(schema, list(zip(*out)))

    return run


def _runs(bit_filter):
    def run(batches):
        bits = bit_filter.value
        schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.int64()))])
        for rows in id_texts(batches):
            out = []
            for doc_id, text in rows:
                words = text.lower().split()
                found, seeds = runs(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
                bit = seeds.astype(np.uint64) >> np.uint64(64 - FILTER_BITS)
                byte = bits[(bit >> np.uint64(3)).astype(np.int64)]
                maybe = found[(byte >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                if len(maybe):
                    out.append((doc_id, np.unique(maybe).tolist()))
            if out:
                yield arrow_batch(schema, list(zip(*out)))

    return run


def _bit_filter(hashes: DataFrame):
    """The set bits of the hashes, broadcast; at most 16 MB whatever the data."""
    bit = F.shiftrightunsigned("span", 64 - FILTER_BITS)
    parts = (
        hashes.select(bit.alias("bit"))
        .groupBy(F.shiftright("bit", 15).cast("int").alias("part"))
        .agg(F.bitmap_construct_agg(F.col("bit") % _BITMAP).alias("bits"))
    )
    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = _BITMAP // 8
    for row in parts.toLocalIterator():
        table[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(table)


def _again(found: np.ndarray, known: list[int]) -> list[int]:
    """Places of spans that an earlier document or an earlier place has."""
    seen, again = set(known), []
    for place, span in enumerate(found.tolist()):
        if span in seen:
            again.append(place)
        else:
            seen.add(span)
    return again


def _without(text: str, drop: np.ndarray) -> str:
    """``text`` without the words of ``drop`` and the white space after each of them."""
    places = [m.start() for m in _TOKEN.finditer(text)]
    places.append(len(text))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], drop, [0]))))
    out, start = [], 0
    for first, stop in edges.reshape(-1, 2).tolist():
        out.append(text[start : places[first]])
        start = places[stop]
    return "".join(out) + text[start:]


def _without_sentences(text: str, drop: np.ndarray) -> str:
    """The same where whole sentences are dropped."""
    before = text[: len(text) - len(text.lstrip())] if drop[0] else ""
    return before + "".join(compress(sentences(text), (~drop).tolist()))


_CLEANED = pa.schema(
    [("doc_id", pa.int64()), ("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()),
     ("n_words_removed", pa.int64())]
)


def _untouched(batches):
    """Texts without a span that repeats: only their sentences are counted."""
    for rows in id_texts(batches):
        out = [(d, t, len(sentences(t)) if t.strip() else 0, 0, 0) for d, t in rows]
        yield arrow_batch(_CLEANED, list(zip(*out)))


def _cleaned(size: int, whole_texts: bool, least_words: int):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = []
                for doc_id, text, known, inner_run in zip(*[part.column(k).to_pylist() for k in range(4)]):
                    if inner_run is None:  # a null id, which stays whole, or one let through by chance
                        out.append((doc_id, text, len(sentences(text)) if text.strip() else 0, 0, 0))
                        continue
                    counts, words = hashed_words(text)
                    count = len(counts) if len(words) else 0
                    first, length, found = spans(counts, words, size, whole_texts, least_words)
                    again = _again(found, known)
                    words_again = []
                    if inner_run or not set(known) <= set(found.tolist()):
                        words_again = _again(runs(words)[0], known)
                    if not again and not words_again:
                        out.append((doc_id, text, count, 0, 0))
                        continue
                    n_words = np.array(counts)
                    whole = np.zeros(len(counts), bool)
                    for k in again:
                        whole[first[k] : first[k] + length[k]] = True
                    drop = np.repeat(whole, n_words).astype(np.int8)
                    for k in words_again:
                        drop[k : k + RUN] = 1
                    total, ends = np.concatenate(([0], np.cumsum(drop))), np.cumsum(n_words)
                    gone = (total[ends] - total[ends - n_words] == n_words).sum()
                    left = _without(text, drop) if words_again else _without_sentences(text, whole)
                    out.append((doc_id, left, count, int(gone), int(drop.sum())))
                yield arrow_batch(_CLEANED, list(zip(*out)))

    return run


def _later(flat: DataFrame) -> DataFrame:
    """The spans that an earlier document has, too."""
    # both sides of the join read one shuffle, so they have to filter nulls alike before it
    dealt = flat.filter("doc_id is not null and span is not null").repartition("span")
    repeated = (
        dealt.groupBy("span")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .filter("first_doc <> last_doc")
        .select("span", "first_doc")
    )
    return dealt.join(repeated, "span").filter("doc_id <> first_doc").select("doc_id", "span")


def substring_dedup(
    docs: DataFrame, size: int = SPAN, whole_texts: bool = False, least_words: int = 0
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, cleaned ``text``, ``n_sentences, n_removed, n_words_removed``.

    A sentence ends at ``.``, ``!`` or ``?`` before white space, or at a line's end; words
    are what white space separates. Spans are runs of ``size`` sentences that hold
    ``least_words`` words, sentences of ``RUN`` words or more, and runs of ``RUN`` words
    wherever they begin and end; of these just the words are removed. With ``whole_texts``
    a text of fewer than ``size`` sentences is one span that other such texts may repeat, else
    it has none of sentences. ``n_removed`` counts sentences of which no word is left. A row
    with a null id stays whole; null texts are empty. Rows that repeat an id are one document.
    Of a run of equal spans inside a document the first place stays. Other columns are not
    read. Texts without a repeated span are passed on where they lie.
    """
    rows = texts(docs)
    named = rows.filter("doc_id is not null")
    per_doc = materialize(
        named.mapInArrow(
            _spans(size, whole_texts, least_words),
            "doc_id long, spans array<long>, seeds array<long>, inner boolean, inner_run boolean",
        ),
        "sentence-spans",
    )
    seeds = per_doc.select("doc_id", F.explode("seeds").alias("span"))
    several = seeds.groupBy("span").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b")
    per_run = materialize(
        named.mapInArrow(_runs(_bit_filter(several)), "doc_id long, runs array<long>"), "word-runs"
    )
    of_sentences = per_doc.select("doc_id", F.explode("spans").alias("span"))
    of_words = per_run.select("doc_id", F.explode("runs").alias("span"))
    later = materialize(
        _later(of_sentences.union(of_words))
        .groupBy("doc_id")
        .agg(F.collect_set("span").alias("known"), F.lit(False).alias("inner_run"))  # spans of one text
        .unionByName(
            per_doc.filter("inner").select("doc_id", F.array().cast("array<long>").alias("known"), "inner_run")
        )
        .groupBy("doc_id")
        .agg(F.flatten(F.collect_list("known")).alias("known"), F.bool_or("inner_run").alias("inner_run")),
        "later-spans",
    )
    touched, others = split_rows(rows, later, "doc_id")
    kinds = "doc_id long, text string, n_sentences long, n_removed long, n_words_removed long"
    cleaned = (
        touched.join(later, "doc_id", "left")
        .select("doc_id", "text", "known", "inner_run")
        .mapInArrow(_cleaned(size, whole_texts, least_words), kinds)
    )
    return cleaned if others is None else cleaned.union(others.mapInArrow(_untouched, kinds))

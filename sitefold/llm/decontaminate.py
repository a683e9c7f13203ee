"""Benchmark decontamination by spaced seeds.

A mask of eight word positions ignores two of them, so windows that differ by one or two
substituted words still share a hash under one of the masks. The hashes of all windows of
the training texts are joined to those of the benchmark, and around each hit the words
are compared one by one, mismatches allowed. Items too short for a mask have one window of
all their words. Items of the same words are one class until their ids are asked for.

A bit filter of fixed size over the benchmark's hashes is tested where the texts lie, so
only windows that may match are joined. It is exact: what it lets through by chance falls
out in the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitefold.llm.common import WordHashes, arrow_batch, combine, id_texts, parts, texts, word_hashes
from sitefold.session import drop_rows, materialize

#: Fixed masks over eight words. Each single position, and each pair five apart, is ignored by one of the
#: first four; with the fifth, any two words of a run of 13 may differ, with all of them any two of 10 to 12.
MASKS = (
    "01111011", "10111101", "11011110", "11100111", "01011111",
    "00111111", "10111011", "11011011", "11101011", "11110011",
)
#: Masks that runs of ``MIN_WORDS`` need; the rest serve shorter items only.
LONG_MASKS = 5
SPAN = 8
#: An overlap is a run of so many words (or a whole shorter item) of which so many are equal.
MIN_WORDS, MIN_EQUAL = 13, 0.8
#: Words kept on either side of hits for verification; hits closer than this share a region.
MARGIN = 32
FILTER_BITS = 25
_BITMAP = 32768  # bits of one bitmap of bitmap_construct_agg


def windows(words: np.ndarray, masks=range(len(MASKS))):
    """``(mask number, hashes of all windows)`` for each of the masks of these numbers.

    Mask ``-n`` is that of all ``n`` consecutive words; a single word is no window of a longer text.
    """
    for k in masks:
        if k < 0:
            last = len(words) + k + 1
            if last == 1 or (last > 1 and k < -1):
                yield k, combine([words[p : p + last] for p in range(-k)]) ^ np.uint64(2**64 + k)
            continue
        last = len(words) - SPAN + 1
        if last < 1:
            continue
        kept = [words[p : p + last] for p in range(SPAN) if MASKS[k][p] == "1"]
        yield k, combine(kept) ^ np.uint64(k)


def _item_windows(min_words: int):
    def run(batches):
        schema = pa.schema([("item_key", pa.int64()), ("mask", pa.int32()), ("at", pa.int32()), ("hash", pa.int64())])
        for batch in batches:
            out = []
            for item_key, item_words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.frombuffer(item_words, "<u8")
                masks = range(LONG_MASKS if min(min_words, len(words)) >= MIN_WORDS else len(MASKS))
                for k, found in windows(words, masks if len(words) >= SPAN else [-len(words)]):
                    out += [(item_key, k, at, h) for at, h in enumerate(found.astype(np.int64).tolist())]
            yield arrow_batch(schema, list(zip(*out)) if out else [[], [], [], []])

    return run


def _words(batches):
    memo = WordHashes()
    schema = pa.schema([("item_id", pa.int64()), ("item_words", pa.binary())])
    for rows in id_texts(batches):
        yield arrow_batch(
            schema, [[i for i, _ in rows], [word_hashes(t, memo).astype("<u8").tobytes() for _, t in rows]]
        )


def _regions(bit_filter, used: list[int]):
    def run(batches):
        memo, bits = WordHashes(), bit_filter.value
        schema = pa.schema(
            [("doc_id", pa.int64()), ("start", pa.int64()), ("words", pa.binary()),
             ("hits", pa.list_(pa.struct([("mask", pa.int32()), ("at", pa.int32()), ("hash", pa.int64())])))]
        )
        for rows in id_texts(batches):
            out = []
            for doc_id, text in rows:
                words = word_hashes(text, memo)
                places, masks, hashes = [], [], []
                for k, found in windows(words, used):
                    bit = found >> np.uint64(64 - FILTER_BITS)
                    byte = bits[(bit >> np.uint64(3)).astype(np.int64)]
                    at = np.flatnonzero((byte >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                    places.append(at)
                    masks.append(np.full(len(at), k))
                    hashes.append(found[at].astype(np.int64))
                if not places or not sum(map(len, places)):
                    continue
                places = np.concatenate(places)
                order = np.argsort(places, kind="stable")
                places = places[order]
                masks, hashes = np.concatenate(masks)[order], np.concatenate(hashes)[order]
                cuts = np.flatnonzero(np.diff(places) > MARGIN) + 1
                for part in np.split(np.arange(len(places)), cuts):
                    start = max(0, int(places[part[0]]) - MARGIN)
                    end = int(places[part[-1]]) + SPAN + MARGIN
                    hits = [
                        {"mask": m, "at": p - start, "hash": h}
                        for m, p, h in zip(masks[part].tolist(), places[part].tolist(), hashes[part].tolist())
                    ]
                    out.append((doc_id, start, words[start:end].astype("<u8").tobytes(), hits))
            if out:
                yield arrow_batch(schema, list(zip(*out)))

    return run


def overlap(region: np.ndarray, item: np.ndarray, shift: int, min_words: int, min_equal: float) -> int:
    """Equal words of the longest part where ``item`` lies at ``shift`` in ``region`` and enough agree; else 0.

    Agreeing windows of ``min_words`` words (or of the whole item, if shorter) count. Of an
    item of fewer than ``SPAN`` words all have to agree.
    """
    low, high = max(0, -shift), min(len(item), len(region) - shift)
    size = min(min_words, len(item))
    if high - low < size:
        return 0
    if len(item) < SPAN:
        min_equal = 1.0
    equal = region[low + shift : high + shift] == item[low:high]
    total = np.concatenate(([0], np.cumsum(equal)))
    good = np.flatnonzero(total[size:] - total[:-size] >= min_equal * size - 1e-9)
    if not len(good):
        return 0
    covered = np.zeros(len(equal), bool)
    for k in good.tolist():
        covered[k : k + size] = True
    return int((covered & equal).sum())


def _verify(min_words: int, min_equal: float):
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("item_key", pa.int64()), ("words_equal", pa.int64())])
        for part in parts(batches):
            out = []
            for r in part.to_pylist():
                region, item = np.frombuffer(r["words"], "<u8"), np.frombuffer(r["item_words"], "<u8")
                equal = overlap(region, item, r["shift"], min_words, min_equal)
                if equal:
                    out.append((r["doc_id"], r["item_key"], equal))
            if out:
                yield arrow_batch(schema, list(zip(*out)))

    return run


def _bit_filter(hashes: DataFrame):
    """The set bits of the hashes, broadcast; at most 4 MB whatever the data."""
    bit = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    parts = (
        hashes.select(bit.alias("bit"))
        .groupBy((F.col("bit") / F.lit(_BITMAP)).cast("int").alias("part"))
        .agg(F.bitmap_construct_agg((F.col("bit") % _BITMAP)).alias("bits"))
        .collect()
    )
    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = _BITMAP // 8
    for row in parts:
        table[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(table)


def _classes(benchmark: DataFrame) -> DataFrame:
    """``(item_id, item_key, item_words)`` of the items that have words; the key is that of the words."""
    items = texts(benchmark, "item_id").filter("doc_id is not null")
    words = items.mapInArrow(_words, "item_id long, item_words binary").filter("length(item_words) > 0")
    return materialize(words.dropDuplicates().withColumn("item_key", F.xxhash64("item_words")), "items")


def _class_overlaps(docs: DataFrame, items: DataFrame, min_words: int, min_equal: float) -> DataFrame:
    """``(doc_id, item_key, words_equal)`` of verified overlaps."""
    classes = items.select("item_key", "item_words").dropDuplicates(["item_key"])
    hashes = materialize(
        classes.mapInArrow(_item_windows(min_words), "item_key long, mask int, at int, hash long"), "item-windows"
    )
    used = sorted(hashes.agg(F.collect_set("mask")).first()[0])
    regions = materialize(
        texts(docs).filter("doc_id is not null").mapInArrow(
            _regions(_bit_filter(hashes), used),
            "doc_id long, start long, words binary, hits array<struct<mask:int,at:int,hash:long>>",
        ),
        "regions",
    )
    hits = regions.select("doc_id", "start", F.explode("hits").alias("h")).select(
        "doc_id", "start", "h.mask", "h.hash", F.col("h.at").alias("doc_at")
    )
    diagonals = (
        hits.join(hashes, ["mask", "hash"])
        .select("doc_id", "start", "item_key", (F.col("doc_at") - F.col("at")).alias("shift"))
        .distinct()
    )
    checked = (
        diagonals.join(regions.select("doc_id", "start", "words"), ["doc_id", "start"])
        .join(classes, "item_key")
        .mapInArrow(_verify(min_words, min_equal), "doc_id long, item_key long, words_equal long")
    )
    return checked.groupBy("doc_id", "item_key").agg(F.max("words_equal").alias("words_equal"))


def overlaps(
    docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_equal: float = MIN_EQUAL
) -> DataFrame:
    """``(doc_id, item_id, words_equal)`` of verified overlaps, one row per pair.

    An overlap is a run of ``min_words`` consecutive words, or a whole item of fewer, of
    which ``min_equal`` are equal in place; an item of two to seven words has to occur word
    for word, and an item of one word is only overlapped by texts of that word alone (a
    word by itself tells nothing). Words are runs of letters, digits and ``_``, lower-cased.
    Items without words overlap nothing. Null ids on either side take no part; null texts
    are empty; repeated rows change nothing; an id with several texts overlaps what any of
    them does.
    """
    items = _classes(benchmark)
    found = _class_overlaps(docs, items, min_words, min_equal)
    return (
        found.join(items.select("item_id", "item_key"), "item_key")
        .groupBy("doc_id", "item_id")  # an id of several texts is in several classes
        .agg(F.max("words_equal").alias("words_equal"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_items, words_equal, contaminated``.

    See :func:`overlaps`. A document is contaminated if it overlaps any item. Rows with
    null ids are clean. Other columns of either table are not read.
    """
    found = overlaps(docs, benchmark).groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.max("words_equal").alias("words_equal")
    )
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id",
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("words_equal", F.lit(0)).cast("long").alias("words_equal"),
        F.col("n_items").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all columns, of documents without an overlap."""
    found = _class_overlaps(docs, _classes(benchmark), MIN_WORDS, MIN_EQUAL)
    bad = materialize(found.select("doc_id").distinct(), "leaks")
    return drop_rows(docs, bad, "doc_id")

"""Join of documents whose word n-gram sets have a Jaccard similarity of 0.8 or more.

Candidates share a band of MinHash values. For each candidate pair the values are
compared a chunk at a time; the pair is dropped once the posterior probability that its
similarity reaches the threshold falls below a tolerance. The rest is verified exactly
on the shingle sets.

How it scales:

* Texts with the same shingle set are one class; only its row of the smallest id takes part.
* Bands with the same members are compared once, in the first of them.
* A bucket with many members is cut into blocks, and each pair of blocks is a task's
  work: pairs exist only inside that task, counts and a spanning tree leave it. No
  bucket is skipped or cut short.
* A pair that shares several bands is counted in the first one only.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sitefold.llm.common import WordHashes, arrow_batch, id_texts, parts, shingles, texts, word_hashes
from sitefold.session import drop_rows, materialize, pick_rows

WORDS = 5
THRESHOLD = 0.8
#: 32 bands of 5 values miss a pair of similarity 0.8 with a probability of 3e-6.
BANDS, ROWS = 32, 5
CHUNK = 32
TOLERANCE = 1e-6
#: Members and shingles of a block; larger buckets are cut.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 2_000_000

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def posterior_reaches(matches: int, compared: int, threshold: float = THRESHOLD) -> float:
    """P(similarity >= threshold) after ``matches`` of ``compared`` equal MinHash values.

    Uniform prior, so the posterior is Beta(matches + 1, compared - matches + 1); its upper
    tail equals the probability of at most ``matches`` successes in ``compared + 1`` trials.
    """
    n = compared + 1
    return sum(comb(n, k) * threshold**k * (1 - threshold) ** (n - k) for k in range(matches + 1))


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """For each number of values compared, the least matches that keep a pair."""
    steps = [*range(CHUNK, BANDS * ROWS + 1, CHUNK)]
    return [
        (n, next(m for m in range(n + 1) if posterior_reaches(m, n, threshold) >= tolerance))
        for n in steps
    ]


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The smallest value under each hash function; blocks keep long texts in cache."""
    out = np.full(BANDS * ROWS, 2**32 - 1, np.uint64)
    for start in range(0, len(hashes), 1024):
        part = hashes[start : start + 1024]
        np.minimum(out, ((part[None, :] * _FACTORS[:, None]) >> np.uint64(32)).min(1), out=out)
    return out.astype("<u4")


def _class_key(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _sign(batches):
    memo = WordHashes()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("class_key", pa.binary()), ("n_shingles", pa.int64()),
         ("bands", pa.list_(pa.int64())), ("digest", pa.int64())]
    )
    for part in parts(batches):
        ids, found, digests = (part.column(k).to_pylist() for k in range(3))
        keys, sizes, bands = [], [], []
        for text in found:
            grams = shingles(word_hashes(text, memo), WORDS)
            sizes.append(len(grams))
            keys.append(_class_key(grams) if len(grams) else None)
            values = min_hashes(grams).reshape(BANDS, ROWS)
            bands.append([xxhash.xxh3_64_intdigest(v.tobytes()) - 2**63 for v in values])
        yield arrow_batch(schema, [ids, keys, sizes, bands, digests])


def _shingle_sets(batches):
    memo = WordHashes()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("class_key", pa.binary()), ("sig", pa.binary()), ("grams", pa.binary())]
    )
    for rows in id_texts(batches):
        ids, keys, sigs, sets = [], [], [], []
        for doc_id, text in rows:
            found = shingles(word_hashes(text, memo), WORDS)
            ids.append(doc_id)
            keys.append(_class_key(found))
            sigs.append(min_hashes(found).tobytes())
            sets.append(found.astype("<u8").tobytes())
        yield arrow_batch(schema, [ids, keys, sigs, sets])


def _root(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


class _Block:
    """The members of one pair of blocks of a bucket, and their links."""

    def __init__(self, band, low, high, rows):
        rows.sort(key=lambda r: (r["doc_id"], r["class_key"]))
        self.band, self.crossing = band, low != high
        self.nodes = [{"doc_id": r["doc_id"], "class_key": r["class_key"]} for r in rows]
        self.copies = [r["copies"] for r in rows]
        self.low = np.array([r["block"] == low for r in rows])
        self.sig = np.frombuffer(b"".join(r["sig"] for r in rows), "<u4").reshape(len(rows), -1)
        self.bands = self.sig.reshape(len(rows), BANDS, ROWS)
        self.sets = [np.frombuffer(r["grams"], "<u8") for r in rows]
        self.sizes = np.array([len(s) for s in self.sets])
        self.index = None

    def candidates(self, i: int) -> np.ndarray:
        if self.crossing:
            others = np.flatnonzero(~self.low) if self.low[i] else np.empty(0, int)
        else:
            others = np.arange(i + 1, len(self.nodes))
        here = (self.bands[others, self.band] == self.bands[i, self.band]).all(1)
        others = others[here]
        earlier = (self.bands[others, : self.band] == self.bands[i, : self.band]).all(2).any(1)
        return others[~earlier]

    def prune(self, i: int, others: np.ndarray, least) -> np.ndarray:
        """Compares values chunk by chunk and drops pairs that cannot reach the threshold."""
        matches, done = np.zeros(len(others), int), 0
        for upto, need in least:
            if not len(others):
                break
            matches += (self.sig[others, done:upto] == self.sig[i, done:upto]).sum(1)
            keep = matches >= need
            others, matches, done = others[keep], matches[keep], upto
        return others

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """Exact numbers of shared shingles."""
        if len(others) < 8:
            own = self.sets[i]
            return np.array(
                [len(np.intersect1d(own, self.sets[j], assume_unique=True)) for j in others], int
            )
        if self.index is None:  # shingles by number, and where each member's begin
            numbers = np.unique(np.concatenate(self.sets), return_inverse=True)[1]
            self.index = numbers, np.concatenate(([0], np.cumsum(self.sizes)))
        numbers, starts = self.index
        own = np.zeros(numbers.max() + 1, np.int64)
        own[numbers[starts[i] : starts[i + 1]]] = 1
        return np.add.reduceat(own[numbers], starts[:-1])[others]

    def links(self, threshold: float, least):
        """``(node, linked rows, smallest node reached here)`` of the linked members."""
        n = len(self.nodes)
        weight, parent = [0] * n, list(range(n))
        for i in range(n):
            others = self.prune(i, self.candidates(i), least)
            if not len(others):
                continue
            shared = self.common(i, others)
            either = self.sizes[i] + self.sizes[others] - shared
            for j in others[shared * 10**6 >= round(threshold * 10**6) * either].tolist():
                weight[i] += self.copies[j]
                weight[j] += self.copies[i]
                a, b = _root(parent, i), _root(parent, j)
                parent[max(a, b)] = min(a, b)
        return [(self.nodes[k], weight[k], self.nodes[_root(parent, k)]) for k in range(n) if weight[k]]


def _compare(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)
    node = pa.struct([("doc_id", pa.int64()), ("class_key", pa.binary())])
    schema = pa.schema([("node", node), ("links", pa.int64()), ("root", node)])

    def run(batches):
        key, rows, out = None, [], []
        for part in parts(batches):
            for row in part.to_pylist():
                this = (row["band"], row["bucket"], row["low"], row["high"])
                if this != key:
                    if len(rows) > 1:
                        out += _Block(key[0], key[2], key[3], rows).links(threshold, least)
                    key, rows = this, []
                rows.append(row)
            if len(out) > 10_000:
                yield arrow_batch(schema, list(zip(*out)))
                out = []
        if len(rows) > 1:
            out += _Block(key[0], key[2], key[3], rows).links(threshold, least)
        if out:
            yield arrow_batch(schema, list(zip(*out)))

    return run


def connected(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node of each connected component of edges ``a > b``.

    Alternating large-star and small-star steps; each step is a few joins on node ids
    and is written, so a lost executor costs one step. Neighbours are never collected.
    """
    edges = materialize(edges.select("a", "b").distinct(), "edges")

    def state(e):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = materialize(small, "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    ends = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(ends)


def _joined(
    docs: DataFrame, threshold: float, tolerance: float, block_members: int, block_shingles: int
) -> DataFrame:
    """The columns of :func:`ngram_join` and the ``digest`` of each row's text, without null ids.

    A class is known by its key, not by an id: rows of one id may have different texts. As a
    node it has its smallest id in front, so the smallest node of a group has its smallest id.
    """
    known = texts(docs).filter(F.col("doc_id").isNotNull())
    signed = materialize(
        known.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(
            _sign,
            "doc_id long, class_key binary, n_shingles long, bands array<long>, digest long",
        ),
        "signed",
    )
    with_words = signed.filter(F.col("class_key").isNotNull())
    classes = with_words.groupBy("class_key").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies")
    )
    reps = (
        with_words.select("doc_id", "class_key", "n_shingles", "bands")
        .join(classes.select("class_key", F.col("rep").alias("doc_id"), "copies"), ["class_key", "doc_id"])
        .dropDuplicates(["class_key", "doc_id"])
    )
    keys = reps.select(
        "doc_id", "class_key", "copies", "n_shingles", F.posexplode("bands").alias("band", "bucket")
    )
    buckets = (
        keys.groupBy("band", "bucket")
        .agg(
            F.count("*").alias("members"),
            F.sum("n_shingles").alias("size"),
            F.bit_xor(F.xxhash64("class_key")).alias("set_1"),
            F.bit_xor(F.xxhash64("class_key", F.lit(1))).alias("set_2"),
        )
        .filter("members > 1")
        # bands with the same members: the first is enough
        .groupBy("members", "size", "set_1", "set_2")
        .agg(F.min(F.struct("band", "bucket")).alias("first"))
        .select(
            "first.band",
            "first.bucket",
            F.greatest(
                F.ceil(F.col("members") / block_members), F.ceil(F.col("size") / block_shingles)
            ).alias("blocks"),
        )
    )
    members = materialize(
        keys.join(buckets, ["band", "bucket"])
        .withColumn("block", F.pmod(F.xxhash64("class_key", "bucket"), F.col("blocks")))
        .select("band", "bucket", "doc_id", "class_key", "copies", "block", "blocks"),
        "members",
    )
    # the texts of candidates are found where they lie; others that pass drop out in the join
    sets = (
        pick_rows(known, members.select("doc_id").distinct(), "doc_id")
        .mapInArrow(_shingle_sets, "doc_id long, class_key binary, sig binary, grams binary")
        .dropDuplicates(["doc_id", "class_key"])
    )
    pairs_of_blocks = members.withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    ).select(
        "band",
        "bucket",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "doc_id",
        "class_key",
        "copies",
        "block",
    )
    work = ["band", "bucket", "low", "high"]
    node = "struct<doc_id:long,class_key:binary>"
    found = materialize(
        pairs_of_blocks.join(sets, ["doc_id", "class_key"])
        .repartition(*work)
        .sortWithinPartitions(*work)
        .mapInArrow(_compare(threshold, tolerance), f"node {node}, links long, root {node}"),
        "found",
    )
    links = found.groupBy(F.col("node.class_key").alias("class_key")).agg(F.sum("links").alias("links"))
    labels = connected(
        found.filter("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b"))
    ).select(F.col("node.class_key").alias("class_key"), F.col("label.doc_id").alias("first"))
    by_class = (
        classes.join(links, "class_key", "left")
        .join(labels, "class_key", "left")
        .select(
            "class_key",
            F.col("rep").alias("copy_of"),
            F.coalesce("first", "rep").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    joined = signed.select("doc_id", "class_key", "n_shingles", "digest").join(by_class, "class_key", "left")
    return joined.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copy_of", "doc_id").alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "n_shingles",
        "digest",
    )


def ngram_join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    block_members: int = BLOCK_MEMBERS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``) with its links and its group.

    ``copy_of``: smallest id with the same shingle set. ``n_links``: other rows of
    similarity ``threshold`` or more, copies included. ``class_id``: smallest id reached
    over links, the near-duplicate group. Words are runs of letters, digits and ``_`` in
    lower case; a text of fewer than five words is one shingle. A text without words
    (null, empty) links to nothing and is its own group. Rows that repeat an id and text
    count as copies; rows that repeat an id with another text are told apart, each has
    the links and the group of its own text. Rows with a null id come back with nulls and
    no links. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    unlinked = docs.filter(F.col("doc_id").isNull())
    return (
        _joined(docs, threshold, tolerance, block_members, block_shingles)
        .drop("digest")
        .union(
            unlinked.select(
                F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long"),
                F.lit(0).cast("long"), F.lit(None).cast("long"),
            )
        )
    )


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose document is the first of its near-duplicate group.

    Rows are dropped by id and digest of the text: of an id with several texts only those go
    that belong to another document's group. Ids of dropped rows are few against the texts;
    rows with a null id stay.
    """
    others = materialize(
        _joined(docs, THRESHOLD, TOLERANCE, BLOCK_MEMBERS, BLOCK_SHINGLES)
        .filter("class_id <> doc_id")
        .select("doc_id", F.col("digest").alias("_digest"))
        .distinct(),
        "near-copies",
    )
    # the digest is computed only for rows that may have to go
    marked = docs.withColumn("_digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    return drop_rows(marked, others, "doc_id").drop("_digest")

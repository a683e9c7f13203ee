"""Quality score: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Training takes a bounded sample of labelled documents (``max_rows``, by hash of the id),
dealt over a fixed number of shards. In each round every shard runs follow-the-
regularised-leader updates from the common state; Spark averages the shards' states by
weight index. The model has a fixed number of weights, so what the driver holds and sends
does not grow with data. Scores are sparse dot products over whole texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from sitefold.llm.common import WordHashes, arrow_batch, combine, id_texts, parts, texts
from sitefold.session import materialize

BITS = 17
WIDTH = 1 << BITS
MAX_ROWS = 20_000
SHARDS, ROUNDS = 6, 5
ALPHA, BETA, L1, L2 = 5.0, 1.0, 0.0001, 0.001
THRESHOLD = 0.3
FOLDS = 5
_LOOK_BITS = 12

#: Words, and runs of other visible characters as words of their own.
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def features(text: str, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Weight indexes and values of a text's one- and two-word grams; 0 is the bias.

    A word that repeats the one before counts as one common word, so that repetition
    is a gram that all texts share. Values are square roots of counts, of length 1.
    """
    words = _TOKEN.findall(text.lower())
    ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(ids) > 1:
        again = np.append(False, ids[1:] == ids[:-1])
        ids = np.where(again, np.uint64(1), ids)
    grams = np.concatenate([combine([ids]), combine([ids[:-1], ids[1:]])]) if len(ids) else ids
    index = (grams >> np.uint64(64 - BITS)).astype(np.int64)
    index, counts = np.unique(index[index > 0], return_counts=True)
    values = np.sqrt(counts) / max(1.0, np.sqrt(counts.sum()))
    return np.append(0, index), np.append(1.0, values)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The proximal solution for each coordinate's state."""
    shrunk = z - np.sign(z) * L1
    return np.where(np.abs(z) <= L1, 0.0, -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def ftrl(rows, z: np.ndarray, n: np.ndarray) -> None:
    """One pass of updates over ``(index, value, label)`` rows, in place."""
    for index, value, label in rows:
        w = weights(z[index], n[index])
        gradient = (_sigmoid(w @ value) - label) * value
        grown = n[index] + gradient * gradient
        z[index] += gradient - (np.sqrt(grown) - np.sqrt(n[index])) / ALPHA * w
        n[index] = grown


def _vectors(batches):
    memo = WordHashes()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("label", pa.int32()), ("index", pa.binary()), ("value", pa.binary())]
    )
    for part in parts(batches):
        ids, found, labels = (part.column(k).to_pylist() for k in range(3))
        made = [features(t, memo) for t in found]
        yield arrow_batch(
            schema,
            [ids, labels, [i.astype("<i4").tobytes() for i, _ in made], [v.astype("<f8").tobytes() for _, v in made]],
        )


def _shard_states(state):
    """The states of the shards of a task after a pass; shards are of bounded size."""

    def run(batches):
        shards: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                shards.setdefault(row["shard"], []).append(row)
        schema = pa.schema([("at", pa.int32()), ("z", pa.float64()), ("n", pa.float64())])
        for rows in shards.values():
            z, n = state.value[0].copy(), state.value[1].copy()
            rows.sort(key=lambda r: (r["place"], r["doc_id"]))
            ftrl(
                (
                    (np.frombuffer(r["index"], "<i4"), np.frombuffer(r["value"], "<f8"), r["label"])
                    for r in rows
                ),
                z,
                n,
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(WIDTH, dtype=np.int32)), pa.array(z), pa.array(n)], schema=schema
            )

    return run


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from (a null id is not in it)."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(False))


def smallest_hashes(ids: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` rows of smallest hash of ``doc_id``.

    Counts by the upper bits of the hash, 4,096 numbers for each look, find a bound under which at
    most twice as many rows lie; only these are sorted. No task or driver holds more.
    """
    hashed = ids.withColumn("_h", F.xxhash64("doc_id"))
    upper = F.col("_h").bitwiseXOR(F.lit(-(2**63)))  # unsigned bits in the order of the signed hash
    below, inside = 0, hashed
    for bits in range(_LOOK_BITS, 64, _LOOK_BITS):
        part = F.shiftrightunsigned(upper, 64 - bits)
        counts = sorted(inside.groupBy(part.alias("part")).count().collect())
        for last, count in counts:
            if below + count > rows:
                break
            below += count
        else:
            break  # all rows are wanted
        if count <= rows:
            hashed = hashed.filter(part <= last)
            break
        inside = hashed.filter(part == last)
    return hashed.orderBy("_h", "doc_id").limit(rows).drop("_h")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights learnt from labelled rows of ``docs`` outside the held-out fold.

    At most ``max_rows`` labelled documents are used, those of the smallest id hashes.
    Null ids or labels are left out, of several labels of a document the smallest counts.
    Without labels all weights are 0 and all scores 0.5.
    """
    spark = docs.sparkSession
    labelled = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"))
    )
    sample = smallest_hashes(labelled, max_rows)
    # bounded by max_rows ids
    rows = texts(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    vectors = materialize(
        rows.mapInArrow(_vectors, "doc_id long, label int, index binary, value binary"), "vectors"
    )
    # dealt once: every round reads the same shards from the executors' disks
    dealt = (
        vectors.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(-1)), F.lit(SHARDS)))
        .repartition(SHARDS, "shard")
        .persist(StorageLevel.DISK_ONLY)
    )
    z, n = np.zeros(WIDTH), np.zeros(WIDTH)
    try:
        for round_no in range(ROUNDS):
            state = spark.sparkContext.broadcast((z, n))
            place = F.xxhash64("doc_id", F.lit(round_no))
            averaged = (
                dealt.withColumn("place", place)
                .select("doc_id", "place", "shard", "label", "index", "value")
                .mapInArrow(_shard_states(state), "at int, z double, n double")
                .groupBy("at")
                .agg(F.avg("z").alias("z"), F.avg("n").alias("n"))
                .filter("z <> 0 or n <> 0")
                .toPandas()  # the model: a fixed number of weights
            )
            z, n = np.zeros(WIDTH), np.zeros(WIDTH)
            z[averaged["at"]], n[averaged["at"]] = averaged["z"], averaged["n"]
    finally:
        dealt.unpersist(blocking=True)
    return weights(z, n)


def _scores(model):
    def run(batches):
        memo, w = WordHashes(), model.value
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for rows in id_texts(batches):
            scores = []
            for _, text in rows:
                index, value = features(text, memo)
                scores.append(_sigmoid(w[index] @ value))
            yield arrow_batch(schema, [[d for d, _ in rows], scores])

    return run


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    ``score`` (0 to 1) is higher where label 1 is likelier; ``predicted`` is 1 from 0.3 on.
    Null and empty texts are scored by the bias alone. Ids may be null or repeat. Only
    ``doc_id`` and ``text`` are read, and the text alone makes the score. An empty table
    gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows))
    scored = texts(docs).mapInArrow(_scores(model), "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def _accepted(model, text_at: int, threshold: float):
    def run(batches):
        memo, w = WordHashes(), model.value
        for part in parts(batches):
            keep = []
            for text in part.column(text_at).to_pylist():
                index, value = features(text or "", memo)
                keep.append(_sigmoid(w[index] @ value) >= threshold)
            yield part.filter(pa.array(keep, pa.bool_()))

    return run


def keep_accepted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Rows of ``docs`` with all columns that the classifier accepts; nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows))
    run = _accepted(model, docs.columns.index("text"), THRESHOLD)
    return docs.mapInArrow(run, docs.schema)

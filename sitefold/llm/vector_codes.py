"""Vector code compression: a product quantiser in whole numbers, fitted by active-entry Lloyd rounds.

Each vector is cut into equal parts, each part is replaced by the index of the nearest entry
of its position's codebook. Between two rounds only some entries move. A part whose own
entry stayed where it was keeps its exact distance, and every entry that did not move was
already no better: so it is compared with the moved entries only. The other parts are
compared with all entries. Ties go to the lower index in both cases, so the result is
that of a complete scan.

How it scales: a round is a map over the written rows and a sum of one row per task, entry
and component; codebooks (entries x dimension numbers) are all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitefold.session import left_join_salted, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows that are compared with the entries at a time.
CHUNK = 4096

_ROW = "vec_id long, label string, comps array<int>"
_STATE = _ROW + ", codes binary, dists array<long>"


def component_limit(dimension: int) -> int:
    """The largest whole number with which squared distances still fit into 64 bits."""
    return min(2**30, isqrt(2**62 // max(1, dimension)) // 2)


def _list_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values of a list column as doubles (null: nan), and where each row starts and ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values, offsets[:-1], offsets[1:]


def _quantise(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, starts, ends = _list_rows(batch.column(2))
            present = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            keep, comps = [], []
            for row in np.flatnonzero(present).tolist():
                own = values[starts[row] : ends[row]]
                if not np.isfinite(own).all():
                    continue
                keep.append(row)
                with np.errstate(over="ignore"):
                    whole = np.floor(own * scale)
                fits = len(own) and np.abs(whole).max() <= component_limit(len(own))
                comps.append(whole.astype(np.int32) if fits else None)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(comps, pa.list_(pa.int32()))],
                names=["vec_id", "label", "comps"],
            )

    return run


@dataclass
class Codebooks:
    """Entries by part and index, and which of them moved in the last round."""

    entries: np.ndarray  # part, entry, position within the part
    moved: np.ndarray  # part, entry

    def nearest(self, comps: np.ndarray, part: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest of ``among`` (ascending: ties to the lowest)."""
        gaps = comps[:, part, None, :] - self.entries[part][among][None]
        found = np.einsum("nek,nek->ne", gaps, gaps)
        best = found.argmin(1)
        return among[best], found[np.arange(len(comps)), best]

    def scan(self, comps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and distances of all parts, every entry compared."""
        every = np.arange(self.entries.shape[1])
        found = [self.nearest(comps, part, every) for part in range(len(self.entries))]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def update(self, comps: np.ndarray, codes: np.ndarray, dists: np.ndarray):
        """The same result as :meth:`scan`, from codes and distances before the entries moved."""
        codes, dists = codes.copy(), dists.copy()
        every = np.arange(self.entries.shape[1])
        for part in range(len(self.entries)):
            active = np.flatnonzero(self.moved[part])
            lost = self.moved[part][codes[:, part]]
            if lost.any():
                codes[lost, part], dists[lost, part] = self.nearest(comps[lost], part, every)
            stayed = np.flatnonzero(~lost)
            if len(stayed) and len(active):
                entry, dist = self.nearest(comps[stayed], part, active)
                old, own = dists[stayed, part], codes[stayed, part]
                better = (dist < old) | ((dist == old) & (entry < own))
                codes[stayed[better], part], dists[stayed[better], part] = entry[better], dist[better]
        return codes, dists


def _shaped(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    values = batch.column("comps").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(batch.num_rows, parts, -1)


def _old(batch: pa.RecordBatch, parts: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8)
    dists = batch.column("dists").flatten().to_numpy(zero_copy_only=False)
    return codes.reshape(-1, parts).astype(np.int64), dists.reshape(-1, parts)


def _assign(books: Codebooks, first: bool):
    parts = len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                comps = _shaped(batch, parts)
                codes, dists = books.scan(comps) if first else books.update(comps, *_old(batch, parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(name) for name in ("vec_id", "label", "comps")]
                    + [
                        pa.array([row.tobytes() for row in codes.astype(np.uint8)], pa.binary()),
                        pa.array(list(dists), pa.list_(pa.int64())),
                    ],
                    names=["vec_id", "label", "comps", "codes", "dists"],
                )

    return run


def _sums(parts: int, entries: int):
    """Count and sum of every used entry's parts, by component: one set of rows per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = total = None
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                comps, (codes, _) = _shaped(batch, parts), _old(batch, parts)
                if total is None:
                    count = np.zeros((parts, entries), np.int64)
                    total = np.zeros((parts, entries, comps.shape[2]), np.int64)
                for part in range(parts):
                    count[part] += np.bincount(codes[:, part], minlength=entries)
                    np.add.at(total[part], codes[:, part], comps[:, part])
        if total is not None:
            used = np.broadcast_to(count[..., None] > 0, total.shape)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.flatnonzero(used)),
                    pa.array(np.broadcast_to(count[..., None], total.shape)[used]),
                    pa.array(total[used]),
                ],
                names=["slot", "n", "total"],
            )

    return run


def _moved_entries(state: DataFrame, entries: np.ndarray) -> Codebooks:
    """Every used entry becomes the floor of the mean of its parts, in whole numbers."""
    parts, count, _ = entries.shape
    sums = (
        state.select("comps", "codes", "dists")
        .mapInArrow(_sums(parts, count), "slot long, n long, total long")
        .groupBy("slot")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )
    after = entries.copy().reshape(-1)
    for row in sums.collect():  # entries x dimension rows at most
        after[row["slot"]] = row["total"] // row["n"]
    after = after.reshape(entries.shape)
    return Codebooks(after, (after != entries).any(2))


def _first_entries(rows: DataFrame, parts: int, entries: int) -> tuple[int, np.ndarray] | None:
    """Dimension, and the parts of the first vectors by id, as the codebooks to begin with."""
    usable = rows.filter(F.col("comps").isNotNull() & (F.size("comps") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), F.col("comps").asc()]
    first = usable.orderBy(*order).limit(1).collect()
    if not first:
        return None
    dimension = len(first[0]["comps"])
    chosen = usable.filter(F.size("comps") == dimension).orderBy(*order).limit(entries).collect()
    books = np.array([r["comps"] for r in chosen], np.int64).reshape(len(chosen), parts, -1)
    return dimension, books.transpose(1, 0, 2).copy()


def codebook_digest(entries: np.ndarray) -> str:
    text = ",".join(map(str, entries.reshape(-1).tolist()))
    return hashlib.sha256(text.encode()).hexdigest()


def _hex_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [c.hex() for c in batch.column("codes").to_pylist()]
        lists = batch.column("dists")
        dists = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(dists.sum(1), pa.int64())],
            names=["vec_id", "label", "code", "error"],
        )


def vector_codes(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """One row per kept row of ``vectors`` (``vec_id``, ``embedding``, ``label``) with its code.

    Components become ``floor(scale * x)``. Rows whose vector is null or holds null or
    non-finite components are dropped. The codebooks begin with the parts of the ``entries``
    smallest ids (a null id comes last; of equal ids the smaller vector first; fewer
    vectors make smaller codebooks). ``code``: two hex digits for each part; ``error``: squared
    distances to the chosen entries, summed; ``label_error``: errors summed over rows of the
    same label, nulls together; ``codebooks_sha256``: digest of the final entries.

    The dimension is that of the smallest id whose length is a multiple of ``parts``. Kept
    vectors of another length, empty ones, and ones beyond :func:`component_limit` have no
    code: their ``code`` and ``error`` are null and they take no part in the fit. Repeated
    rows count each. Other columns are not read. Without rows there is no result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: entries must be 1 to 256")
    rows = materialize(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("label").cast("string").alias("label"),
            "embedding",
        ).mapInArrow(_quantise(scale), _ROW),
        "quantised",
    )
    start = _first_entries(rows, parts, entries)
    if start is None:
        coded = rows.select(
            "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")
        )
        digest = codebook_digest(np.empty(0, np.int64))
    else:
        dimension, first = start
        fits = F.col("comps").isNotNull() & (F.size("comps") == dimension)
        books = Codebooks(first, np.ones(first.shape[:2], bool))
        state = materialize(rows.filter(fits).mapInArrow(_assign(books, True), _STATE), "codes")
        for _ in range(rounds):
            books = _moved_entries(state, books.entries)
            state = materialize(state.mapInArrow(_assign(books, False), _STATE), "codes")
        coded = state.select("vec_id", "label", "codes", "dists").mapInArrow(
            _hex_codes, "vec_id long, label string, code string, error long"
        )
        others = rows.filter(~F.coalesce(fits, F.lit(False)))
        coded = coded.unionByName(others.select("vec_id", "label"), allowMissingColumns=True)
        digest = codebook_digest(books.entries)
    # one text for each label, and one for none
    key = F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit("none"))
    coded = materialize(coded.withColumn("label_key", key), "coded")
    totals = coded.groupBy("label_key").agg(F.sum("error").alias("label_error"))
    return left_join_salted(coded, totals, "label_key", spread_by="vec_id").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )

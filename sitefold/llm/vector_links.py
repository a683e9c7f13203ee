"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction of a random product code: the rotated space is cut into blocks, each
with its own random codewords, and every combination of one codeword per block is a
direction. A vector passes the filters whose caps hold it, that is, whose direction it
exceeds a bound with; they are listed block by block without looking at the others. Vectors
that share a filter are compared exactly. Bound and number of codes are fitted by dimension,
so that two vectors at the threshold meet but for a share of ``MISSED``; recall is measured
in the tests.

How it scales:

* Equal vectors are one class, represented by its smallest id.
* Classes whose best direction is the same and that lie within half the threshold angle of
  a common leader are a ball. All of them are linked with each other, which needs no
  comparison, so a large group of near copies becomes a few balls. A cell with many classes
  is cut into slices, and a ball lies within one slice.
* Filters are joined as ids; those with the same balls count once. A filter with many balls
  is cut into blocks, and a task's work is a pair of blocks. Only pairs of balls that can
  hold a link leave it.
* From the angle of two leaders and the radii it follows for most pairs of balls that all or
  none of their members are linked. The members of the rest are compared in one task for
  each pair of balls.
* The number of directions grows with the number of vectors, so that chance meetings stay
  a constant share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sitefold.llm.ngram_join import connected
from sitefold.session import hot_slices, left_join_salted, materialize

THRESHOLD = 0.93
#: Share of pairs at the threshold that meet in no filter.
MISSED = 2e-4
#: Directions of a code for each vector of the largest label.
DIRECTIONS = 52
LEAST_BLOCKS, MOST_CODEWORDS = 2, 2048
#: Least probability of meeting in one code; smaller codes are taken below it.
LEAST_SHARE = 0.2
OWN_ROTATION = 256
#: Classes of a cell that are set against each other, and balls of a block.
SLICE_ROWS, BLOCK_BALLS = 4096, 2048
#: Radians that angles are kept clear of each other, far above their rounding.
MARGIN = 1e-6
CHUNK = 512


class CapFilters:
    """Product codes of one dimension and the bound that a vector has to exceed.

    Each code has its own rotation, deal of the components to its blocks, and codewords. With
    more than ``OWN_ROTATION`` components the deal mixes enough and one rotation is shared.
    """

    def __init__(self, dimension: int, blocks: int, codewords: int, codes: int, bound: float, seed: int = 13):
        rng = np.random.default_rng([seed, dimension, blocks, codewords])
        self.directions, self.bound, self.codes, rotation = 0, bound, [], None
        for _ in range(codes):
            if rotation is None or dimension <= OWN_ROTATION:
                rotation = np.linalg.qr(rng.normal(size=(dimension, dimension)))[0]
            code = []
            for part in np.array_split(rng.permutation(dimension), min(blocks, dimension)):
                words = rng.normal(size=(len(part), codewords)) if len(part) > 1 else np.array([[1.0, -1.0]])
                code.append((part, words / np.linalg.norm(words, axis=0)))
            self.codes.append((rotation, code))
            self.directions = int(np.prod([words.shape[1] for _, words in code]))

    def scores(self, units: np.ndarray):
        """For each code the inner products with the codewords, block by block."""
        for rotation, code in self.codes:
            turned = units @ rotation
            yield [turned[:, part] @ words for part, words in code]

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and filter number of every cap that holds a row."""
        found = []
        for number, scores in enumerate(self.scores(units)):
            # what the blocks that are still to come can add at most
            ahead = [np.zeros(len(units))]
            for block in reversed(scores[1:]):
                ahead.append(ahead[-1] + block.max(1))
            rows, sums = np.arange(len(units)), np.zeros(len(units))
            filters = np.full(len(units), number, np.int64)
            for block, rest in zip(scores, reversed(ahead)):
                grown = sums[:, None] + block[rows]
                at, word = np.nonzero(grown >= (self.bound - rest[rows])[:, None])
                rows, filters, sums = rows[at], filters[at] * block.shape[1] + word, grown[at, word]
            found.append((rows, filters))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def best(self, units: np.ndarray) -> np.ndarray:
        """Number of the direction of the first code that is nearest to each row."""
        found = np.zeros(len(units), np.int64)
        for block in next(self.scores(units)):
            found = found * block.shape[1] + block.argmax(1)
        return found


def pairs_at(threshold: float, dimension: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors, and partners whose cosine to them is ``threshold``."""
    rng = np.random.default_rng([seed, dimension])
    first = rng.normal(size=(count, dimension))
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    if dimension == 1:
        return first, first
    side = rng.normal(size=(count, dimension))
    side -= (side * first).sum(1, keepdims=True) * first
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return first, threshold * first + np.sqrt(1 - threshold**2) * side


def shared_filters(filters: CapFilters, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each pair of rows the number of filters that hold both."""
    size = filters.directions * len(filters.codes)
    numbers = [rows * size + found for rows, found in (filters.decode(first), filters.decode(second))]
    both = np.intersect1d(*numbers, assume_unique=True)
    return np.bincount(both // size, minlength=len(first))


def fit_filters(dimension: int, vectors: int, threshold: float, missed: float) -> tuple[int, int, int, float]:
    """Blocks, codewords, codes and bound for a label of so many ``vectors``.

    The bound is what a random vector reaches with its best direction on average. Pairs at
    the threshold share a filter of one code with a probability that is measured on
    random ones; as many codes are taken as leave ``missed`` of them. Few dimensions have room
    for few caps, so there the codes are smaller.
    """
    blocks = min(dimension, LEAST_BLOCKS)
    while True:
        codewords = max(2, int(np.ceil((DIRECTIONS * vectors) ** (1 / blocks))))
        if codewords <= MOST_CODEWORDS or blocks == dimension:
            break
        blocks += 1
    codewords = min(codewords, MOST_CODEWORDS, 4 * 2 ** min(dimension // blocks, 20))
    first, second = pairs_at(threshold, dimension, 1000, seed=1)
    while True:
        one = CapFilters(dimension, blocks, codewords, 1, 0.0)
        one.bound = float(np.mean(sum(block.max(1) for block in next(one.scores(first)))))
        share = (shared_filters(one, first, second) > 0).mean()
        if share >= LEAST_SHARE or codewords == 2:
            share = min(max(share, 0.01), 1 - 1e-9)
            codes = int(np.ceil(np.log(missed) / np.log(1 - share)))
            return blocks, codewords, max(1, codes), one.bound
        codewords = max(2, codewords // 2)


def _doubles(column: pa.Array) -> np.ndarray:
    """Equally long binary rows of doubles as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key of the class and the unit vector of every row that can be linked."""
    names = ["vec_id", "space", "key", "unit"]
    for batch in batches:
        keys, units = [], []
        for row in batch.select(["vec_id", "space", "embedding"]).to_pylist():
            key = unit = None
            if None not in (row["vec_id"], row["space"], row["embedding"]) and None not in row["embedding"]:
                values = np.array(row["embedding"], np.float64) + 0.0
                most = np.abs(values).max(initial=0)
                if np.isfinite(values).all() and most > 0:
                    scaled = values / most
                    key = xxhash.xxh3_128_digest(row["space"].encode() + b"\0" + values.tobytes())
                    unit = (scaled / np.linalg.norm(scaled)).tobytes()
            keys.append(key)
            units.append(unit)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("space"), pa.array(keys, pa.binary()), pa.array(units, pa.binary())],
            names=names,
        )


def _list_filters(codes: dict[int, tuple[int, int, int, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, CapFilters] = {}
        for whole in batches:
            sizes = np.array([len(u) // 8 for u in whole.column("unit").to_pylist()], int)
            for dimension in np.unique(sizes).tolist():
                if dimension not in made:
                    made[dimension] = CapFilters(dimension, *codes[dimension])
                code = made[dimension]
                same = whole.take(pa.array(np.flatnonzero(sizes == dimension)))
                for start in range(0, same.num_rows, CHUNK):
                    batch = same.slice(start, CHUNK)
                    units = _doubles(batch.column("unit"))
                    rows, filters = code.decode(units)
                    order = np.argsort(rows, kind="stable")
                    filters = filters[order]
                    counts = np.bincount(rows, minlength=len(units))
                    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(code.best(units)), pa.ListArray.from_arrays(offsets, pa.array(filters))],
                        names=[*batch.schema.names, "cell", "filters"],
                    )

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """Rows with equal ``keys``, which follow each other."""

    def rows():
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                yield from batch.slice(start, CHUNK).to_pylist()

    for _, group in groupby(rows(), key=lambda r: tuple(r[k] for k in keys)):
        yield list(group)


def _matrix(rows: list[dict], column: str = "unit") -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), np.float64).reshape(len(rows), -1)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _make_balls(threshold: float):
    radius = float(np.arccos(threshold)) / 2 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _groups(batches, ["cell_key", "slice"]):
            units, left = _matrix(rows), np.arange(len(rows))
            while len(left):  # the first that is left leads those near to it
                angles = _angles(units[left] @ units[left[0]])
                angles[0] = 0
                near = angles <= radius
                leader = rows[left[0]]
                for k, angle in zip(left[near].tolist(), angles[near].tolist()):
                    row = rows[k]
                    out.append((
                        row["space"], row["rep"], row["key"], row["copies"], row["unit"], row["filters"],
                        leader["rep"], leader["key"], angle,
                    ))
                left = left[~near]
            if len(out) >= 4 * CHUNK:
                yield _record(out, _BALL_FIELDS)
                out = []
        if out:
            yield _record(out, _BALL_FIELDS)

    return run


_BALL_FIELDS = pa.schema([
    ("space", pa.string()), ("rep", pa.int64()), ("key", pa.binary()), ("copies", pa.int64()),
    ("unit", pa.binary()), ("filters", pa.list_(pa.int64())), ("ball_rep", pa.int64()),
    ("ball_key", pa.binary()), ("angle", pa.float64()),
])
_PAIR_FIELDS = pa.schema([
    ("a_rep", pa.int64()), ("a_key", pa.binary()), ("b_rep", pa.int64()), ("b_key", pa.binary()),
    ("whole", pa.bool_()),
])
_LINK_FIELDS = pa.schema([
    ("rep", pa.int64()), ("key", pa.binary()), ("links", pa.int64()),
    ("to_rep", pa.int64()), ("to_key", pa.binary()),
])


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema
    )


def _ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "long", "double": "double", "bool": "boolean", "list<item: int64>": "array<long>"}
    return ", ".join(f"{f.name} {kinds.get(str(f.type), str(f.type))}" for f in schema)


def _pair_balls(threshold: float):
    """Pairs of balls of one block that hold links (``whole``) or may hold some."""
    widest = float(np.arccos(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _groups(batches, ["space", "filter", "low", "high"]):
            rows.sort(key=lambda r: (r["ball"]["id"], r["ball"]["key"]))
            units, radii = _matrix(rows), np.array([r["radius"] for r in rows])
            low = np.array([r["block"] == r["low"] for r in rows])
            crossing = rows[0]["low"] != rows[0]["high"]
            for i in range(len(rows) - 1):
                others = np.arange(i + 1, len(rows))
                if crossing:
                    others = others[low[others] != low[i]]
                cosines = units[others] @ units[i]
                angles, reach = _angles(cosines), radii[others] + radii[i]
                single = reach == 0
                whole = np.where(single, cosines >= threshold, angles + reach <= widest - MARGIN)
                maybe = ~single & (angles - reach <= widest + MARGIN)
                for k in np.flatnonzero(whole | maybe).tolist():
                    a, b = rows[others[k]]["ball"], rows[i]["ball"]
                    out.append((a["id"], a["key"], b["id"], b["key"], bool(whole[k])))
                if len(out) >= 8 * CHUNK:
                    yield _record(out, _PAIR_FIELDS)
                    out = []
        if out:
            yield _record(out, _PAIR_FIELDS)

    return run


def _compare_members(threshold: float):
    """Links of the members of two balls, and the edge between the balls if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["a", "b"]):
            sides = [[r for r in rows if r["side"] == side] for side in (0, 1)]
            units = [_matrix(side) for side in sides]
            copies = [np.array([r["copies"] for r in side]) for side in sides]
            links = [np.zeros(len(side), np.int64) for side in sides]
            for start in range(0, len(sides[0]), CHUNK):
                part = slice(start, start + CHUNK)
                linked = (units[0][part] @ units[1].T >= threshold).astype(np.int64)
                links[0][part] = linked @ copies[1]
                links[1] += copies[0][part] @ linked
            if links[0].any():
                out = [
                    (r["rep"], r["key"], n, None, None)
                    for side, counts in zip(sides, links)
                    for r, n in zip(side, counts.tolist())
                    if n
                ]
                a, b = rows[0]["a"], rows[0]["b"]
                yield _record([*out, (a["id"], a["key"], 0, b["id"], b["key"])], _LINK_FIELDS)

    return run


def _node(rep: str, key: str) -> Column:
    return F.struct(F.col(rep).alias("id"), F.col(key).alias("key"))


def candidate_pairs(members: DataFrame, threshold: float, block_balls: int) -> tuple[DataFrame, DataFrame]:
    """The balls, and the distinct pairs of them that share a filter and can hold a link."""
    balls = materialize(
        members.groupBy("space", "ball").agg(
            F.sum("copies").alias("size"),
            F.max("angle").alias("radius"),
            F.max(F.when(F.col("node") == F.col("ball"), F.col("unit"))).alias("unit"),
        ),
        "balls",
    )
    held = members.select("space", "ball", F.explode("filters").alias("filter")).distinct()
    buckets = (
        held.groupBy("space", "filter")
        .agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("ball")).alias("set_1"),
            F.bit_xor(F.xxhash64("ball", F.lit(1))).alias("set_2"),
        )
        .filter("n > 1")
        # filters with the same balls: the first is enough
        .groupBy("space", "n", "set_1", "set_2")
        .agg(F.min("filter").alias("filter"))
        .select("space", "filter", F.ceil(F.col("n") / block_balls).alias("blocks"))
    )
    work = ["space", "filter", "low", "high"]
    meeting = (
        held.join(buckets, ["space", "filter"])
        .withColumn("block", F.pmod(F.xxhash64("ball", "filter"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .select(*work, "ball", "block")
        .join(balls.select("ball", "radius", "unit"), "ball")
    )
    pairs = (
        meeting.repartition(*work)
        .sortWithinPartitions(*work)
        .mapInArrow(_pair_balls(threshold), _ddl(_PAIR_FIELDS))
        .select(_node("a_rep", "a_key").alias("a"), _node("b_rep", "b_key").alias("b"), "whole")
        .distinct()
    )
    return balls, materialize(pairs, "ball-pairs")


@dataclass(frozen=True)
class Links:
    """Members with their links, and the edges between balls."""

    members: DataFrame
    edges: DataFrame


def count_links(members: DataFrame, balls: DataFrame, pairs: DataFrame, threshold: float) -> Links:
    """``links`` of every member to vectors of other classes, and which balls are linked."""
    whole, rest = pairs.filter("whole"), pairs.filter("not whole")
    size = balls.select("ball", "size")
    to_ball = (
        whole.select(F.col("a").alias("ball"), F.col("b").alias("other"))
        .union(whole.select(F.col("b").alias("ball"), F.col("a").alias("other")))
        .join(size.select(F.col("ball").alias("other"), F.col("size").alias("others")), "other")
        .groupBy("ball")
        .agg(F.sum("others").alias("to_ball"))
    )
    sides = rest.select(
        "a", "b", F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("a").alias("ball")),
            F.struct(F.lit(1).alias("side"), F.col("b").alias("ball")),
        )).alias("s")
    ).select("a", "b", "s.side", "s.ball")
    compared = materialize(
        sides.join(members.select("ball", "rep", "key", "copies", "unit"), "ball")
        .select("a", "b", "side", "rep", "key", "copies", "unit")
        .repartition("a", "b")
        .sortWithinPartitions("a", "b")
        .mapInArrow(_compare_members(threshold), _ddl(_LINK_FIELDS)),
        "member-links",
    )
    own = compared.filter("to_rep IS NULL").groupBy("key").agg(F.sum("links").alias("own"))
    none = F.lit(0)
    linked = (
        members.select("ball", "key", "copies")
        .join(size, "ball")
        .join(to_ball, "ball", "left")
        .join(own, "key", "left")
        .select(
            "ball", "key",
            (F.col("size") - 1 + F.coalesce("to_ball", none) + F.coalesce("own", none)).alias("links"),
        )
    )
    edges = whole.select("a", "b").union(
        compared.filter("to_rep IS NOT NULL").select(
            _node("rep", "key").alias("a"), _node("to_rep", "to_key").alias("b")
        )
    )
    return Links(linked, edges)


def vector_links(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    missed: float = MISSED,
    slice_rows: int = SLICE_ROWS,
    block_balls: int = BLOCK_BALLS,
) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id``, ``embedding``, ``label``) with its links.

    Two rows are linked if they have the same label and length and a cosine of ``threshold``
    or more. ``n_links``: other rows linked directly, copies and rows that repeat an id
    included; ``component_id``: the smallest id reachable over links; ``kept``: this is the
    smallest. Rows without an id or label, and vectors that are null, empty, zero or hold
    null or non-finite components, link with nothing: ``component_id`` is their own id and
    they are kept. Rows that repeat an id with another vector are vectors of their own. Other
    columns are not read. An empty table gives no rows.

    Every link reported is exact; of links at the threshold ``missed`` are not found, of
    closer ones fewer.
    """
    space = F.concat(F.col("label").cast("string"), F.lit(":"), F.size("embedding"))
    rows = materialize(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), space.alias("space"), "embedding")
        .mapInArrow(_unit_vectors, "vec_id long, space string, key binary, unit binary"),
        "unit-vectors",
    )
    classes = materialize(
        rows.filter(F.col("key").isNotNull())
        .groupBy("space", "key")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit")),
        "vector-classes",
    )
    dimension = (F.length("unit") / 8).cast("int")
    largest = classes.groupBy(dimension.alias("dimension"), "space").count()
    codes = {}
    for found in largest.groupBy("dimension").agg(F.max("count").alias("n")).collect():  # one row per length
        codes[found["dimension"]] = fit_filters(found["dimension"], found["n"], threshold, missed)
    listed = materialize(
        classes.mapInArrow(
            _list_filters(codes),
            "space string, key binary, rep long, copies long, unit binary, cell long, filters array<long>",
        ).withColumn("cell_key", F.concat("space", F.lit("/"), F.col("cell").cast("string"))),
        "listed",
    )
    # rows of one cell, a slice at a time
    hot = hot_slices(listed, "cell_key", slice_rows)
    slice_no = F.coalesce(F.pmod(F.xxhash64("key"), F.col("_slices")), F.lit(0).cast("long"))
    members = materialize(
        listed.join(hot, "cell_key", "left")
        .withColumn("slice", slice_no)
        .select("cell_key", "slice", "space", "rep", "key", "copies", "unit", "filters")
        .repartition("cell_key", "slice")
        .sortWithinPartitions("cell_key", "slice", "rep", "key")
        .mapInArrow(_make_balls(threshold), _ddl(_BALL_FIELDS))
        .withColumn("node", _node("rep", "key"))
        .withColumn("ball", _node("ball_rep", "ball_key")),
        "members",
    )
    balls, pairs = candidate_pairs(members, threshold, block_balls)
    links = count_links(members, balls, pairs, threshold)
    labels = connected(links.edges).withColumnRenamed("node", "ball")
    by_class = links.members.join(labels, "ball", "left").select(
        "key", "links", F.coalesce(F.col("label.id"), F.col("ball.id")).alias("component_id")
    )
    joined = left_join_salted(rows.select("vec_id", "key"), by_class, "key", spread_by="vec_id")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )

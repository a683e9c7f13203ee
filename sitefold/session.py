"""Session settings, scratch tables and skew-safe joins shared by all steps."""

from __future__ import annotations

import contextlib
import hashlib
import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Parsing is heavy per byte: keep all cores busy even when a shuffle is small.
    # Large shuffles are not affected, their partitions are far above this.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # wanted ids are given to page scans as lists, see sources/layout.py
    "spark.sql.parquet.pushdown.inFilterThreshold": "500",
    # the page job turns one batch of HTML into Python strings at a time
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def build_session(app_name: str = "sitefold", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_scratch: str | None = None
_runs: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder for written intermediate tables, one that all executors share.

    It is the one of ``spark.checkpoint.dir``, else the one of ``setCheckpointDir``. A
    ``file:`` path given there is taken as a mount that all nodes have. Only a local
    master, whose executors share this machine's disk, may do without.
    """
    global _local_scratch
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _local_scratch = _local_scratch or tempfile.mkdtemp(prefix="sitefold-")
    return _local_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below :func:`scratch_root`, in the folder of the current run."""
    run = _runs[-1] if _runs else spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/sitefold/{run}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch_run(spark: SparkSession):
    """Deletes the tables that were written inside the block when it ends.

    Results that read them have to be written or collected before.
    """
    run = f"run-{uuid.uuid4().hex}"
    _runs.append(run)
    try:
        yield
    finally:
        _runs.remove(run)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{scratch_root(spark)}/sitefold/{run}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of one Arrow batch on its way to a Python worker; batches of wide rows at the
#: default size are held by JVM and worker at once and cost an executor hundreds of MB.
ARROW_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where several later steps read the same rows and recomputing them would
    parse HTML again. A written table survives lost executors, cuts the lineage,
    and is read back with only the columns each step needs. Python steps get small Arrow
    batches meanwhile. Inside :func:`resumable_run` the table is a stage of the run.
    """
    if _resumable:
        return _resumable[-1].stage(df, name)
    path = scratch_path(df.sparkSession, name)
    with _settings(df.sparkSession, ARROW_BATCH):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> str:
    """Digest of the schema and of all rows, whatever their order; one scan, no shuffle of rows."""
    parts = [F.col(c) for c in df.columns] + [F.col(c).isNull() for c in df.columns]
    totals = df.agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64(*parts)).alias("x"),
        F.sum(F.xxhash64(F.lit(1), *parts).cast("decimal(38,0)")).alias("s"),
    ).first()
    text = json.dumps([df.schema.jsonValue(), totals["n"], totals["x"], str(totals["s"])])
    return hashlib.sha256(text.encode()).hexdigest()


def _file(spark: SparkSession, path: str):
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), file


def exists(spark: SparkSession, path: str) -> bool:
    fs, file = _file(spark, path)
    return fs.exists(file)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any store that Spark knows; None if there is none."""
    if not exists(spark, path):
        return None
    fs, file = _file(spark, path)
    stream = fs.open(file)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside and renames it, so that it is there whole or not at all."""
    fs, new = _file(spark, f"{path}.new")
    stream = fs.create(new, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    file = _file(spark, path)[1]
    fs.delete(file, False)
    if not fs.rename(new, file):
        raise OSError(f"cannot write {path}")


class Run:
    """The written tables of one run: ``<root>/<key>/<place>-<name>`` and an entry beside each.

    An entry is made, by renaming, when its table is complete: stage, key, schema and path.
    A table without one is what a lost driver left behind; it is written anew.
    """

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.key, self.path = spark, key, f"{root.rstrip('/')}/{key}"
        self.place, self.taken_up = 0, []

    def entry(self, path: str) -> dict | None:
        text = read_text(self.spark, f"{path}.json")
        return text and json.loads(text)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.place += 1
        path = f"{self.path}/{self.place:02d}-{name}"
        entry = {"stage": name, "key": self.key, "path": path, "schema": df.schema.json()}
        if self.entry(path) == entry:
            self.taken_up.append(name)
        else:
            with _settings(self.spark, ARROW_BATCH):
                df.write.mode("overwrite").parquet(path)
            write_text(self.spark, f"{path}.json", json.dumps(entry))
        return self.spark.read.schema(df.schema).parquet(path)


_resumable: list[Run] = []


@contextlib.contextmanager
def resumable_run(spark: SparkSession, root: str, key: str):
    """Tables written inside the block are kept under ``root`` and taken up by a later run.

    ``key`` has to tell all inputs and parameters, see :func:`fingerprint`; another key is
    another run. The steps inside must write the same tables in the same order every time.
    One run of a key may be active. Delete ``<root>/<key>`` when its result is not needed.
    """
    run = Run(spark, root, key)
    _resumable.append(run)
    try:
        yield run
    finally:
        _resumable.remove(run)


# A blocked Bloom filter: an id sets PROBES bits of one block, and a block is one bitmap.
BLOCK_BITS = 32768  # bits of one bitmap of bitmap_construct_agg, 4 KB
PROBES = 3
#: 16 bits for each id let one in 200 others pass, 12 bits one in 90.
BITS_PER_ID, LEAST_BITS_PER_ID = 16, 12
#: 64 MB, the most that is broadcast.
MOST_BLOCKS = 1 << 14
MOST_FILTERED_IDS = MOST_BLOCKS * BLOCK_BITS // LEAST_BITS_PER_ID


def filter_blocks(ids: int, most_blocks: int = MOST_BLOCKS) -> int | None:
    """Blocks of a filter for so many ids, a power of two; None if it would be too large."""
    if ids * LEAST_BITS_PER_ID > most_blocks * BLOCK_BITS:
        return None
    wanted = max(2, -(-ids * BITS_PER_ID // BLOCK_BITS))
    return min(most_blocks, 1 << (wanted - 1).bit_length())


def _mark_rows(df: DataFrame, ids: DataFrame, key: str, blocks: int) -> DataFrame:
    """``df`` with ``_maybe``: false only where ``key`` is certainly not in ``ids``.

    One hash of the id gives its block (the upper bits) and its bits there (15 each from
    below), so a row looks up one bitmap, in a broadcast join on the block.
    """

    def block(value: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(value), 64 - blocks.bit_length() + 1).cast("int")

    def bits(value: Column) -> list[Column]:
        hashed = F.xxhash64(value)
        return [F.shiftrightunsigned(hashed, 15 * k).bitwiseAND(BLOCK_BITS - 1).cast("int") for k in range(PROBES)]

    filled = (
        ids.select(block(F.col(key)).alias("_block"), F.explode(F.array(*bits(F.col(key)))).alias("_bit"))
        .groupBy("_block")
        .agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    )

    def is_set(bit: Column) -> Column:
        byte = F.substring(F.col("_bits"), F.shiftright(bit, 3) + 1, F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        return F.getbit(value, bit.bitwiseAND(7)) == 1

    found = F.lit(True)
    for bit in bits(F.col(key)):
        found = found & is_set(bit)
    return (
        df.withColumn("_block", block(F.col(key)))
        .join(F.broadcast(filled), "_block", "left")
        .select(*df.columns, F.coalesce(F.col("_bits").isNotNull() & found, F.lit(False)).alias("_maybe"))
    )


def _blocks_for(ids: DataFrame, key: str, most_blocks: int) -> int | None:
    # the estimate may be a few percent low, which the bits for each id have room for
    return filter_blocks(ids.agg(F.approx_count_distinct(key, 0.02)).first()[0], most_blocks)


def pick_rows(df: DataFrame, ids: DataFrame, key: str, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``ids``, and at most a few more.

    The ids become a Bloom filter that is sized by their approximate number, so rows are
    picked where they lie, without a shuffle of ``df``, and about one in 200 others passes by
    chance. Such a row is to fall out in a later join by id, when ``df`` has been reduced to
    what is needed of it. ``ids`` is read twice.

    Beyond ``MOST_FILTERED_IDS`` (some 44 million) the filter would outgrow what should be
    broadcast: then the ids are joined exactly, which shuffles ``df`` once unless it is
    bucketed by ``key``.
    """
    blocks = _blocks_for(ids, key, most_blocks)
    if blocks is None:
        return df.join(ids.select(key).distinct().hint("merge"), key, "left_semi").select(*df.columns)
    return _mark_rows(df, ids, key, blocks).filter("_maybe").drop("_maybe")


def split_rows(
    df: DataFrame, ids: DataFrame, key: str, most_blocks: int = MOST_BLOCKS
) -> tuple[DataFrame, DataFrame | None]:
    """The rows that :func:`pick_rows` picks, and the others, whose ``key`` is certainly not in
    ``ids``. With too many ids for a filter all rows are picked and the others are None."""
    blocks = _blocks_for(ids, key, most_blocks)
    if blocks is None:
        return df, None
    marked = _mark_rows(df, ids, key, blocks)
    return marked.filter("_maybe").drop("_maybe"), marked.filter("not _maybe").drop("_maybe")


def drop_rows(df: DataFrame, gone: DataFrame, key: str, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """The rows of ``df`` without a partner in ``gone``, whose columns are all compared.

    ``key`` is one of the columns. Rows whose key is certainly not there are passed on
    where they lie; only the others are set against ``gone`` in an exact anti-join. Nulls
    equal nulls there. With too many keys for a filter, see :func:`pick_rows`, all rows are.
    """
    names = gone.columns
    renamed = gone.select(*[F.col(c).alias(f"_gone_{c}") for c in names])

    def rest(rows: DataFrame) -> DataFrame:
        same = [rows[c].eqNullSafe(renamed[f"_gone_{c}"]) for c in names]
        return rows.join(renamed, same, "left_anti")

    maybe, sure = split_rows(df, gone, key, most_blocks)
    return rest(maybe) if sure is None else sure.union(rest(maybe))


SLICE_ROWS = 50_000


def hot_slices(left: DataFrame, key: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``key`` and the number of slices of every key with more than ``slice_rows`` rows."""
    return (
        left.filter(F.col(key).isNotNull())
        .groupBy(key)
        .count()
        .filter(F.col("count") > slice_rows)
        .select(key, F.ceil(F.col("count") / slice_rows).cast("bigint").alias("_slices"))
    )


def _crowded(left: DataFrame, key: str, slice_rows: int) -> tuple[bool, bool]:
    """Whether a key has more than ``slice_rows`` rows, and whether the null keys have."""
    large = left.groupBy(key).count().filter(F.col("count") > slice_rows)
    null = F.col(key).isNull()
    keys, nulls = large.agg(F.count_if(~null), F.count_if(null)).first()
    return keys > 0, nulls > 0


def left_join_salted(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: str,
    slice_rows: int = SLICE_ROWS,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """Left join of ``left`` to a ``right`` that has one row per ``key`` (and ``also``).

    A key may hold a large share of ``left``. Every key with more than ``slice_rows`` rows
    is cut into slices of about that size by a hash of ``spread_by``, and only its row of
    ``right`` is repeated, once per slice. Such keys number at most rows / ``slice_rows``;
    whether their list is broadcast is the optimizer's decision from its size. The keys are
    counted when this is called: without such a key each side moves once, in a plain join, and many
    null keys, which match nothing, stay where they lie. ``left`` is read more than once and should be
    a table, not a costly plan. The result equals the plain left join.
    """
    on = [key, *also]
    hot_keys, many_nulls = _crowded(left, key, slice_rows)
    if not hot_keys and not many_nulls:
        return left.join(right, on, "left")
    if not hot_keys:
        found = left.filter(F.col(key).isNotNull()).join(right, on, "left")
        absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name not in on]
        return found.unionByName(left.filter(F.col(key).isNull()).select("*", *absent))
    hot = hot_slices(left, key, slice_rows)
    zero = F.lit(0).cast("bigint")
    spread = F.xxhash64(spread_by)
    slice_of_row = (
        F.when(F.col(key).isNull(), spread)  # matches nothing, but must not pile up
        .when(F.col("_slices").isNotNull(), F.pmod(spread, F.col("_slices")))
        .otherwise(zero)
    )
    all_slices = F.when(
        F.col("_slices").isNotNull(), F.sequence(zero, F.col("_slices") - 1)
    ).otherwise(F.array(zero))
    sliced_left = left.join(hot, key, "left").withColumn("_slice", slice_of_row).drop("_slices")
    sliced_right = right.join(hot, key, "left").withColumn("_slice", F.explode(all_slices)).drop(
        "_slices"
    )
    return sliced_left.join(sliced_right, [*on, "_slice"], "left").drop("_slice")

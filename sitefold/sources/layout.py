"""Where a crawl gets its pages: a plain table, or a stored layout that prunes.

A source answers two questions. ``index()``: which page stands for each canonical URL, as
narrow rows of ``page_key`` and ``id_columns``. ``pick(ids)``: the wanted pages with their
HTML, and maybe a few more.

The layout is Parquet in shards of neighbouring page keys. Pages of one site have neighbouring
keys, so the pages that some seeds want lie in few shards, and only those are opened. Rows
are sorted within a shard, row groups are small, and both ids have Parquet bloom filters, so
a few wanted ids skip row groups without reading HTML. The index is stored beside the
pages and is not computed again for each crawl.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sitefold.functions import urls
from sitefold.session import pick_rows

_STORED = "page_key string, page_id long, url string, status_code int, html string, shard int"
_INDEX = "page_key string, page_id long, shard int"

ROW_GROUP_BYTES = 16 << 20
#: Up to so many wanted ids are given to the scan as literals.
PUSHED_IDS = 500


def _status(pages: DataFrame) -> Column:
    known = F.col("status_code") if "status_code" in pages.columns else F.lit(None).cast("int")
    return F.coalesce(known, F.lit(200)).cast("int").alias("status_code")


def _key() -> Column:
    return urls.page_key(urls.canonical_url(F.col("url"))).alias("page_key")


def standing_pages(keyed: DataFrame, id_columns: list[str]) -> DataFrame:
    """``page_key`` and the ids of the page that stands for it.

    Of several copies the smallest id that was served without an error, else the smallest.
    Copies of one URL may be a large share of the pages. They are told apart here on
    narrow columns, combined before the shuffle, and never meet in one task.
    """
    if id_columns == ["page_id"]:  # numbers are combined by hash, structs would be sorted
        served = F.col("status_code") < 400

        def least(of: Column) -> Column:  # a null id comes first
            return F.when(F.count_if(of & F.col("page_id").isNull()) == 0, F.min(F.when(of, F.col("page_id"))))

        best = F.when(F.count_if(served) > 0, least(served)).otherwise(least(F.lit(True)))
        return keyed.groupBy("page_key").agg(best.alias("page_id"))
    ids = F.struct(*id_columns)
    served = F.when(F.col("status_code") < 400, ids)
    best = F.coalesce(F.min(served), F.min(ids)).alias("best")
    return keyed.groupBy("page_key").agg(best).select("page_key", *[f"best.{c}" for c in id_columns])


class PageTable:
    """Pages of any table with a unique ``page_id``, ``url``, ``html`` and maybe ``status_code``."""

    id_columns = ["page_id"]

    def __init__(self, pages: DataFrame):
        self.rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _status(pages))

    def index(self) -> DataFrame:
        return standing_pages(self.rows.select(_key(), "page_id", "status_code"), self.id_columns)

    def pick(self, ids: DataFrame) -> DataFrame:
        return pick_rows(self.rows, ids, "page_id")


class StoredPages:
    """Pages written by :func:`write_pages`."""

    id_columns = ["page_id", "shard"]

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @cached_property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(_STORED).parquet(f"{self.path}/pages")

    def index(self) -> DataFrame:
        return self.spark.read.schema(_INDEX).parquet(f"{self.path}/index")

    def pick(self, ids: DataFrame) -> DataFrame:
        """Only the shards that hold a wanted id are read; their number bounds what is collected."""
        shards = [r["shard"] for r in ids.select("shard").distinct().collect()]
        near = self.rows.filter(F.col("shard").isin(shards))
        few = ids.select("page_id").distinct().limit(PUSHED_IDS + 1).collect()
        if len(few) <= PUSHED_IDS:
            return near.filter(F.col("page_id").isin([r["page_id"] for r in few]))
        return pick_rows(near, ids, "page_id")


def write_pages(
    pages: DataFrame, path: str, shards: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES
) -> StoredPages:
    """Stores ``pages`` (see :class:`PageTable`) as a layout in a new folder.

    One shuffle moves the HTML, once for all later crawls. The range is cut by key and id, so
    many copies of one URL spread over shards. ``shards`` is the number of shuffle partitions
    unless given; a shard should be a few hundred MB. A failed write leaves no index.
    """
    spark = pages.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = PageTable(pages).rows
    (
        table.select(_key(), "page_id", "url", "status_code", "html")
        .repartitionByRange(shards, "page_key", "page_id")
        .withColumn("shard", F.spark_partition_id())
        .sortWithinPartitions("shard", "page_key", "page_id")
        .write.partitionBy("shard")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.bloom.filter.enabled#page_id", "true")
        .option("parquet.bloom.filter.enabled#page_key", "true")
        .parquet(f"{path.rstrip('/')}/pages")
    )
    stored = StoredPages(spark, path)
    narrow = stored.rows.select("page_key", "page_id", "status_code", "shard")
    standing_pages(narrow, stored.id_columns).write.parquet(f"{stored.path}/index")
    return stored

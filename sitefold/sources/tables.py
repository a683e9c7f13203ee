"""Scans. Every schema is declared; a scan reads only the columns it names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sitefold import schemas
from sitefold.session import materialize


def seed_list(spark: SparkSession, domains: Iterable[str]) -> DataFrame:
    """A short list given in code; order and repeats are kept."""
    return spark.createDataFrame(list(enumerate(domains)), schemas.SEEDS)


def seed_table(df: DataFrame, domain_col: str, order_by: str) -> DataFrame:
    """Seeds from a table with its own ordinal; repeats are kept."""
    return df.select(
        F.col(order_by).cast("bigint").alias("seed_no"), F.col(domain_col).alias("domain")
    )


def seed_file(spark: SparkSession, path: str) -> DataFrame:
    """One domain per line, of a file, a folder or a pattern; ``seed_no`` counts from 0.

    The order is that of the files one after the other by name, however they are split.
    A line's number is its place in its split plus the lines of all splits before it. Only
    the counts of splits, one row for some 100 MB, are sorted; the lines are not.
    """
    lines = materialize(
        spark.read.text(path).select(
            F.col("value").alias("domain"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("place"),  # grows by one within a split
        ),
        "seed-lines",
    )
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "file", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    return lines.join(starts, ["file", "split"]).select(
        (F.col("place") + F.col("shift")).alias("seed_no"), "domain"
    )


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)


def knowledge_base(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schemas.KNOWLEDGE_BASE).format(fmt).load(path)


def model_prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MODEL_PRICES).parquet(path)


def search_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SEARCH_RESULTS).parquet(path)


def responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESPONSES).parquet(path)

"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch of documents is first reduced
to one row per digest, then set against the index in a sort-merge anti-join (the index
side is read bucket by bucket and never shuffled) and what is new is appended.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from sitefold.session import drop_rows, exists, materialize, read_text, scratch_path, write_text

_SCHEMA = "digest binary, keep_id bigint, group_size bigint"


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the SHA-256 of the whole text in UTF-8 (null counts as empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """Digests seen so far, in a folder that all executors share.

    ``buckets`` is the number for a new folder. It is kept there, and an existing folder is
    read with its own number: with another one its files would be taken for other buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path = spark, path.rstrip("/")
        path = self.path
        kept = read_text(spark, f"{path}/_buckets")
        if kept is None:
            if exists(spark, path) and not self.plain_entries().isEmpty():
                raise ValueError(f"{path} holds digests but not their number of buckets")
            write_text(spark, f"{path}/_buckets", str(buckets))
        else:
            buckets = int(kept)
        self.buckets = buckets
        self.table = f"digest_index_{xxhash.xxh3_64_hexdigest(path)}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def new(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` whose digest is not in the index."""
        return groups.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, docs: DataFrame) -> None:
        """Append the digests of ``docs`` that are new, one entry per digest.

        Of equal texts in the batch the largest ``doc_id`` is the one that stays; a text
        that an earlier batch brought keeps its entry.
        """
        groups = digests(docs).groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
        )
        new = self.new(groups).select("digest", "keep_id", "group_size")
        new.write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def plain_entries(self) -> DataFrame:
        """The entries without their bucketing.

        For joins to all rows: a digest may hold a third of them, and such a partition
        can be split only if both sides are shuffled.
        """
        return self.spark.read.schema(_SCHEMA).parquet(self.path)


def exact_dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One decision per row of ``docs`` (``doc_id``, ``text``), after adding it to ``index``.

    ``keep_id``: the document that stays for this text, the largest id of the batch that
    brought it; ``group_size``: rows of that batch with the text; ``kept``: this row stays.
    Null texts are empty texts. Of rows that share id and text all are ``kept`` here, as
    the id stays; :func:`drop_copies` leaves one of them. A null id stays only where no
    row of the text has one. An empty table gives no rows. Other columns are not read.
    """
    index.add(docs)
    return decisions(docs, index)


def decisions(docs: DataFrame, index: DigestIndex) -> DataFrame:
    return digests(docs).join(index.plain_entries(), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared scratch folder."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, scratch_path(spark, "digest-index"), buckets)


def drop_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, whole; of rows that repeat an id and text, one.

    Texts are not shuffled unless rows repeat an id: what goes is found on ids.
    """
    index.add(docs)
    marked = materialize(
        decisions(docs, index)
        .groupBy("doc_id", "text_sha256")
        .agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
        .filter("not kept or n > 1"),
        "dedup-marks",
    )
    rows = docs.withColumn("_sha", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    marks = marked.withColumnRenamed("text_sha256", "_sha")
    stay = drop_rows(rows, marks.select("doc_id", "_sha"), "doc_id")
    repeated = marks.filter("kept").select("doc_id", "_sha")
    if not repeated.isEmpty():
        same = [rows[c].eqNullSafe(repeated[c]) for c in ("doc_id", "_sha")]
        once = rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_sha"])
        stay = stay.unionByName(once)
    return stay.select(*docs.columns)

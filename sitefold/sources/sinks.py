"""JSON and CSV sinks, written by the executors in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sitefold import schemas
from sitefold.operators.costs import batch_summary
from sitefold.operators.leads import report


def write_json(records: DataFrame, path: str) -> None:
    """One nested JSON object per record and line, nulls included."""
    records.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LEAD).json(path)


def write_report(records: DataFrame, path: str, by_line: bool = False) -> None:
    """Ten flat columns with a header and doubled quotes.

    Fields may hold line ends, as they are; such a file can only be read as a whole. With
    ``by_line`` every record is one line: backslashes and line ends are written as ``\\\\``,
    ``\\n`` and ``\\r``, so that :func:`read_report` can split a large file.
    """
    flat = report(records)
    if by_line:
        flat = flat.select(*[
            _escaped(F.col(f.name)).alias(f.name) if f.dataType == T.StringType() else f.name
            for f in flat.schema.fields
        ])
    (
        flat.write.mode("errorifexists")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def _escaped(field: Column) -> Column:
    for plain, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        field = F.replace(field, F.lit(plain), F.lit(written))
    return field


def _plain(field: Column) -> Column:
    """The inverse of :func:`_escaped`: pairs of backslashes are cut out first, so that what
    is left of a backslash begins an escape."""
    pieces = F.split(field, r"\\\\", -1)
    ends = F.transform(
        pieces, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    )
    return F.array_join(ends, "\\")


def write_summary(records: DataFrame, path: str) -> None:
    """The totals of a batch: one JSON object in one line."""
    batch_summary(records).write.mode("errorifexists").json(path)


def write_failures(records: DataFrame, path: str) -> None:
    """The seeds whose record failed, with the reason, one JSON object per line."""
    failed = records.filter(F.col("error").isNotNull()).select("seed_no", "domain", "error")
    failed.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


_REPORT = T.StructType([
    T.StructField(name, T.DoubleType() if name in ("data_confidence_score", "estimated_cost_usd")
                  else T.LongType() if name in ("input_tokens", "output_tokens") else T.StringType())
    for name in schemas.REPORT_COLUMNS
])


def read_report(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """A written report. Files written ``by_line`` are split among tasks; others are not."""
    rows = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", not by_line)
        .schema(_REPORT)
        .csv(path)
    )
    if not by_line:
        return rows
    return rows.select(*[
        _plain(F.col(f.name)).alias(f.name) if f.dataType == T.StringType() else f.name for f in _REPORT.fields
    ])

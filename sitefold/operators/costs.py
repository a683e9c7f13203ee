"""Token and cost accounting over a table of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sitefold import schemas
from sitefold.functions import scores

# --- fixed values: thousandths of a USD per million tokens (input, output) ---
PRICES = (
    ("gpt-4o-mini", 150, 600),
    ("gpt-4o", 2500, 10000),
    ("gemini-2.5-flash", 75, 300),
    ("gemini-1.5-flash", 75, 300),
    ("claude-3-5-sonnet", 3000, 15000),
    ("groq-llama-3.3-70b", 590, 790),
    ("default", 150, 600),
)
# ----------------------------------------------------------------------------


def model_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, schemas.MODEL_PRICES)


def attach_prices(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``in_milli`` and ``out_milli``; unlisted models get the ``default`` row.

    A model listed twice counts once. The join is left to the optimizer, which
    broadcasts ``prices`` after checking its size; past that, AQE splits the calls of
    a frequent model. The default prices are scalar subqueries, evaluated once.
    """
    listed = prices.groupBy(F.col("model").alias("_model")).agg(
        F.min("in_milli").alias("_in"), F.min("out_milli").alias("_out")
    )

    default = _lookup(prices, "default")

    def price(column: str, name: str) -> Column:
        return F.coalesce(F.col(column), default[name]).cast("bigint").alias(name)

    return calls.join(listed, F.lower(calls["model"]) == F.col("_model"), "left").select(
        *[calls[c] for c in calls.columns], price("_in", "in_milli"), price("_out", "out_milli")
    )


def _lookup(prices: DataFrame, *models: str) -> Column:
    """Both prices of the first of ``models`` that is listed, in one scalar subquery."""

    def price(column: str) -> Column:
        found = [F.min(F.when(F.col("model") == m, F.col(column))) for m in models]
        return F.coalesce(*found).alias(column)

    return prices.agg(F.struct(price("in_milli"), price("out_milli"))).scalar()


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Add the ``cost`` of each call, a decimal rounded to 6 places."""
    cost = scores.call_cost(
        F.col("input_tokens"), F.col("output_tokens"), F.col("in_milli"), F.col("out_milli")
    )
    return attach_prices(calls, prices).withColumn("cost", cost).drop("in_milli", "out_milli")


def price_one_model(calls: DataFrame, prices: DataFrame, model: str) -> DataFrame:
    """:func:`price_calls` where all calls use one model: scalar lookups, no join."""

    price = _lookup(prices, model.lower(), "default")
    return calls.withColumn(
        "cost",
        scores.call_cost(
            F.col("input_tokens"), F.col("output_tokens"), price["in_milli"], price["out_milli"]
        ),
    )


def _totals() -> list[Column]:
    tokens_in = F.sum("input_tokens").cast("bigint")
    tokens_out = F.sum("output_tokens").cast("bigint")
    return [
        F.count("*").alias("calls"),
        tokens_in.alias("input_tokens"),
        tokens_out.alias("output_tokens"),
        (tokens_in + tokens_out).alias("total_tokens"),
        F.round(F.sum("cost"), 6).cast("double").alias("estimated_cost_usd"),
    ]


def cost_totals(priced: DataFrame) -> DataFrame:
    """Totals of all calls, from costs that are already rounded per call."""
    return priced.agg(*_totals())


def cost_totals_by_model(priced: DataFrame) -> DataFrame:
    return priced.groupBy(F.lower("model").alias("model")).agg(*_totals())


def cost_metrics(input_tokens: Column, output_tokens: Column, cost: Column) -> Column:
    return F.struct(
        input_tokens.cast("bigint").alias("input_tokens"),
        output_tokens.cast("bigint").alias("output_tokens"),
        (input_tokens + output_tokens).cast("bigint").alias("total_tokens"),
        cost.cast("double").alias("estimated_cost_usd"),
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """Counts and totals over finished records; ``error`` marks a failed domain.

    A domain that failed after its call still adds that call's cost.
    """
    ok = F.col("error").isNull()
    c = "cost_metrics"
    return results.agg(
        F.count("*").alias("total_domains"),
        F.count_if(ok).alias("successful_domains"),
        F.count_if(~ok).alias("failed_domains"),
        F.coalesce(F.sum(f"{c}.input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(f"{c}.output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum(f"{c}.total_tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(
            F.round(F.sum(F.col(f"{c}.estimated_cost_usd").cast("decimal(18,6)")), 6).cast("double"),
            F.lit(0.0),
        ).alias("estimated_cost_usd"),
    )

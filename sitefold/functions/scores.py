"""Scores and exact costs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0))


def completeness(overview: Column, audience: Column, leaders: Column, contacts: Column) -> Column:
    """0.50 to 1.00, added up in whole hundredths so the result is exact."""
    hundredths = (
        F.lit(50)
        + _points(F.length(overview) > 30, 20)
        + _points(F.length(audience) > 15, 15)
        + _points(F.size(leaders) > 0, 10)
        + _points(F.size(contacts) > 0, 5)
    )
    return F.least(F.lit(100), hundredths) / F.lit(100)


def extraction_confidence(in_kb: Column, contacts: Column, leaders: Column) -> Column:
    return (
        F.when(in_kb, F.lit(0.95))
        .when((F.size(contacts) > 0) | (F.size(leaders) > 0), F.lit(0.70))
        .otherwise(F.lit(0.50))
    )


def call_cost(
    input_tokens: Column, output_tokens: Column, in_milli: Column, out_milli: Column
) -> Column:
    """USD of one call, rounded half up to 6 places, as a decimal.

    Prices are whole thousandths of a USD per million tokens, so the product is an
    integer number of 1e-9 USD. Decimals are multiplied, never divided.
    """
    nano = (input_tokens * in_milli + output_tokens * out_milli).cast("decimal(18,0)")
    return F.round(nano * F.lit("0.000000001").cast("decimal(10,9)"), 6)

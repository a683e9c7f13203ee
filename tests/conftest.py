import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sitefold.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "sitefold-tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Apply a column function to a list of strings and return the results in order."""
    from pyspark.sql import functions as F

    def apply(values, fn):
        rows = spark.createDataFrame(list(enumerate(values)), "i bigint, v string").repartition(4)
        return [r["r"] for r in rows.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]

    return apply

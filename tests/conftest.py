import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tidepool-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


# Limits so low that every operator takes its way for large tables.
LIMITS = {
    "broadcastRows": 0,
    "percentileDistinct": 0,
    "bracketRows": 5,
    "windowGroupRows": 0,
    "pointBytes": 0,
    "pivots": 9,
    "neighborChunk": 40,
}


@pytest.fixture
def large_paths(spark):
    for name, value in LIMITS.items():
        spark.conf.set(f"tidepool.{name}", str(value))
    yield
    for name in LIMITS:
        spark.conf.unset(f"tidepool.{name}")


@pytest.fixture
def nulls(spark):
    return spark.createDataFrame(
        [
            ("a", 1.0, "2024-01-06 10:00:00"),
            ("b", float("nan"), "2024-01-08 00:00:00"),
            (None, 0.0, None),
            ("a", None, "2024-02-29 23:59:59"),
            ("c", -4.0, "2023-12-31 00:00:00"),
        ],
        "k string, x double, s string",
    ).selectExpr("k", "x", "cast(s as timestamp_ntz) as t")

"""Bounds, texts and types that the queries do not reach."""

from pyspark.sql import functions as F

from tidepool.operators import prepare, profile
from tidepool.session import measure
from tidepool.sources import files, typing

HARD = ["a\nb", 'q"uo\nte"', " lead and trail ", "a,b", "\\", "é😀", '""', "last\n"]


def test_csv_keeps_texts(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "i int, t string")
    files.write_csv(df, f"{tmp_path}/a")
    got = files.read_csv(spark, f"{tmp_path}/a", df.schema).orderBy("i").collect()
    assert [r["t"] for r in got] == HARD


def test_nested_cells_are_measured(spark):
    long = "x" * 500
    df = spark.range(3).select(
        F.struct(F.lit(long).alias("s")).alias("a"), F.array(F.struct(F.lit(long).alias("s"))).alias("b"),
        F.create_map(F.lit("k"), F.lit(long)).alias("c"),
    )
    rows, size = measure(df)
    assert rows == 3 and size >= 3 * 1500


def test_nan_text_is_missing(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("2",)], "x string")
    assert [r["x"] for r in typing.promote_types(df).collect()] == [1.5, None, 2.0]


def test_problem_type_bounds(spark):
    for n, whole, want in ((10, False, "classification"), (11, False, "regression"), (20, True, "classification"), (21, True, "regression")):
        df = spark.range(100).select((F.col("id") % n).cast("long" if whole else "double").alias("x"))
        assert prepare.problem_type(df, "x") == want


def test_value_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "x string")
    got = [(r["x"], r["count"], r["pct"], r["distinct_values"]) for r in profile.value_counts(df, "x").collect()]
    assert got == [("a", 2, 50.0, 2), ("b", 1, 25.0, 2)]

"""Filters, joins, features and profiles on hand-made tables."""

import datetime as dt
import math
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepool.columns import classify, require
from tidepool.functions import dates, text
from tidepool.functions import predicates as P
from tidepool.operators import (
    charts, encoders, filters, joins, numeric, prepare, profile, sampling,
)
from tidepool.operators.lookup import attach
from tidepool.sources import files, typing
from tidepool.sources.catalog import Catalog


def keys(df, name="k"):
    return sorted((r[name] or "") for r in df.collect())


def test_classes(nulls):
    got = classify(nulls)
    assert (got["numeric"], got["text"], got["datetime"]) == (["x"], ["k"], ["t"])
    with pytest.raises(ValueError, match="not found"):
        require(nulls, ["nope"])
    with pytest.raises(ValueError, match="must be numeric"):
        require(nulls, ["k"], "numeric")


def test_nan_becomes_null(nulls):
    assert typing.nan_to_null(nulls).filter("x is null").count() == 2


def test_value_set(nulls):
    assert keys(filters.value_set(nulls, "k", ["a"])) == ["a", "a"]
    assert keys(filters.value_set(nulls, "k", ["b", None])) == ["", "b"]
    assert filters.value_set(nulls, "k", None).count() == 5
    assert filters.value_set(nulls, "k", []).count() == 0


def test_not_equal_passes_missing(nulls):
    assert keys(filters.where(nulls, [("k", "!=", "a")])) == ["", "b", "c"]


def test_condition_precedence_and_skipping(nulls):
    rows = typing.nan_to_null(nulls)
    got = filters.where(rows, [("k", "==", "c", "or"), ("k", "==", "a", "and"), ("x", ">", 0)])
    assert keys(got) == ["a", "c"]
    assert filters.where(rows, [("k", "==", "", "and")]).count() == 5
    with pytest.raises(ValueError):
        filters.where(rows, [("k", ">", "a")])
    with pytest.raises(ValueError):
        P.build([("x", ">", 1)] * 6, rows.schema)


def test_values_never_become_sql(spark):
    df = spark.createDataFrame([("it's",), ("x",)], "k string")
    assert filters.where(df, [("k", "==", "it's")]).count() == 1
    assert filters.where(df, [("k", "==", "x' or '1'='1")]).count() == 0


def test_ranges(nulls):
    rows = typing.nan_to_null(nulls)
    assert filters.numeric_range(rows, "x").count() == 5
    assert filters.numeric_range(rows, "x", -4, 0).count() == 2
    assert filters.numeric_range(rows, "x", low=0).count() == 2
    with pytest.raises(ValueError):
        filters.numeric_range(rows, "x", 2, 1)
    got = filters.date_range(rows, "t", dt.date(2024, 1, 6), dt.date(2024, 2, 29))
    assert got.count() == 3


def test_complete_rows(nulls):
    assert filters.complete_rows(nulls, ["k", "t"]).count() == 4
    with pytest.raises(ValueError):
        filters.complete_rows(nulls, ["k"], at_least=5)


def test_filter_report_of_nothing(nulls):
    row = filters.filter_report(nulls.limit(0), [F.col("x") > 0]).first()
    assert (row["original_rows"], row["reduction_pct"]) == (0, 0.0)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_join_like_pandas(spark, how):
    left = pd.DataFrame({"k": ["a", None, "b", "b"], "v": [1, 2, 3, 4]})
    right = pd.DataFrame({"k": ["b", None, "z"], "v": [10, 20, 30], "w": [1, 2, 3]})
    want = left.merge(right, on="k", how=how, suffixes=("_left", "_right"))
    got = joins.join(
        spark.createDataFrame(left, "k string, v long"),
        spark.createDataFrame(right, "k string, v long, w long"), "k", "k", how,
    )
    assert got.columns == list(want.columns)

    def cells(rows):
        return sorted(str([None if pd.isna(x) else x for x in r]) for r in rows)

    floats = want.astype({"v_left": float, "v_right": float, "w": float})
    assert cells(floats.values.tolist()) == cells(
        [[r[0], *[None if x is None else float(x) for x in r[1:]]] for r in got.collect()]
    )


def test_join_clashing_key_and_types(spark):
    a = spark.createDataFrame([(1, "x")], "i int, j string")
    b = spark.createDataFrame([("1", 2.0)], "j string, i double")
    got = joins.join(a, b, "i", "j")
    assert got.columns == ["i_left", "j_left", "j_right", "i_right"] and got.count() == 1
    none = joins.join(
        spark.createDataFrame([(None,)], "a int"), spark.createDataFrame([(None,)], "b int"),
        "a", "b", null_keys_match=False,
    )
    assert none.count() == 0


def test_promote(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "1", "1.5", "x", None), ("2024-02-01 10:00:00", "2", "3", "1", None)],
        "d string, i string, f string, m string, n string",
    )
    types = dict(typing.promote_types(df).dtypes)
    assert types == {
        "d": "timestamp_ntz", "i": "bigint", "f": "double", "m": "string", "n": "string"
    }
    assert dict(typing.promote_types(df, numeric=False).dtypes)["i"] == "string"


def test_catalog(spark, nulls):
    names = Catalog(spark)
    names.add("A b", nulls)
    names.add("a_b", nulls.limit(1))
    assert names.get("A b").count() == 5 and names.get("a_b").count() == 1
    names.remove("A b")
    assert names.names() == ["a_b"]
    with pytest.raises(ValueError):
        names.get("A b")


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "latin1"])
def test_csv_round_trip(spark, tmp_path, encoding):
    df = spark.createDataFrame([(2, "é, \"q\""), (1, "ü")], "i long, s string")
    path = str(tmp_path / encoding)
    files.write_csv(df, path, order_by=["i"], row_number="n", encoding=encoding)
    got = files.read_csv(spark, path, "n long, i long, s string", encoding).orderBy("n").collect()
    assert [tuple(r) for r in got] == [(0, 1, "ü"), (1, 2, "é, \"q\"")]
    with pytest.raises(ValueError):
        files.write_csv(df, path, row_number="n")


def test_missing_features_are_named(nulls):
    with pytest.raises(ValueError, match="p, q"):
        files.check_features(nulls, ["x", "p", "q"])


def test_constant_columns_are_refused(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    for kind in ("standard", "minmax", "robust"):
        with pytest.raises(ValueError):
            numeric.transform(df, "x", kind)
    assert numeric.transform(df, "x", "bins").first()["x_quantile_binning"] is None
    assert profile.correlations(df.withColumn("y", F.lit(2.0))).filter("r is not null").count() == 0


def test_reciprocal_ratio_and_log(nulls):
    rows = typing.nan_to_null(nulls)
    got = {r["k"]: r for r in numeric.transform(rows, "x", "reciprocal").filter("t is not null").collect()}
    assert got["c"]["x_reciprocal"] == -0.25
    assert numeric.transform(rows, "x", "reciprocal").filter("x = 0").first()["x_reciprocal"] is None
    logs = numeric.transform(rows, "x", "log").filter("x = -4").first()["x_log_transform"]
    assert logs == pytest.approx(math.log(1.0))
    small = numeric.ratio(rows.withColumn("z", F.lit(0.0)), "x", "z", "small_value", "r")
    assert small.filter("x = 1").first()["r"] == pytest.approx(1e10)


@pytest.mark.parametrize("q", [2, 4, 5])
def test_bins_like_pandas(spark, q):
    values = [1, 1, 1, 1, 2, 3, 5, 8, 8, 9, 20, 4.5, 7.25]
    want = pd.qcut(pd.Series(values), q=q, labels=False, duplicates="drop")
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, x double")
    got = numeric.transform(df, "x", "bins", "b", n_bins=q).orderBy("i").collect()
    assert [r["b"] for r in got] == want.tolist()


def test_encoders(nulls):
    got = encoders.label(nulls, "k", ["x", "t"]).collect()
    assert {r["k"]: r["k_label_encoded"] for r in got} == {None: -1, "a": 0, "c": 1, "b": 2}
    hot = encoders.one_hot(nulls, "k")
    assert hot.columns[-4:] == ["k_a", "k_b", "k_c", "k_nan"]
    assert hot.filter("k_nan").count() == 1
    freq = encoders.frequency(nulls, "k").collect()
    assert {r["k"]: r["k_frequency"] for r in freq} == {"a": 2, "b": 1, "c": 1, None: None}


def test_text_of_nothing(spark):
    df = spark.createDataFrame([(None,), ("Aé 1\t!b",)], "c string")
    rows = text.add_features(df, "c").orderBy(F.col("c").asc_nulls_first()).collect()
    assert list(rows[0])[1:] == [0] * 6
    assert list(rows[1])[1:] == [7, 3, 6, 1, 1, 2]


def test_dates(nulls):
    rows = {r["k"]: r for r in dates.add_features(nulls.filter("x is null or x <> 1"), "t").collect()}
    assert rows["a"]["t_day"] == 29 and rows["a"]["t_hour"] == 23
    assert rows["c"]["t_dayofweek"] == 6 and rows["c"]["t_is_weekend"] == 1
    assert rows[None]["t_is_weekend"] == 0 and rows[None]["t_year"] is None


def test_duplicates_with_nulls_and_long_texts(spark):
    long = "x" * 100
    df = spark.createDataFrame(
        [(None, long), (None, long), ("a", long + "y"), ("a", None), ("a", None)], "a string, b string"
    )
    assert tuple(profile.duplicate_rows(df).first()) == (5, 2)
    assert tuple(profile.duplicate_rows(df.limit(0)).first()) == (0, 0)


def test_empty_table_profiles(nulls):
    empty = nulls.limit(0)
    assert profile.missing_report(empty).filter("missing_pct = 0").count() == 3
    assert profile.quality(empty).first()["quality_score"] == 100.0
    assert profile.describe(empty).first()["count"] == 0
    assert charts.histogram(empty, "x", 5).count() == 5
    assert profile.issues(empty).count() == 3


def test_shape_like_pandas(spark):
    values = [1.0, 2.0, 2.5, 9.0, 11.0, 30.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = profile.shape(df).first()
    assert row["skewness"] == pytest.approx(pd.Series(values).skew())
    assert row["kurtosis"] == pytest.approx(pd.Series(values).kurt())


def test_splits(spark):
    df = spark.range(3000).withColumn("c", (F.col("id") % 7 == 0).cast("int"))
    a, b = sampling.split(df, ["id"], 0.25)
    assert a.count() + b.count() == 3000 and a.intersect(b).count() == 0
    assert abs(b.count() / 3000 - 0.25) < 0.04
    a, b = sampling.stratified_split(df, "c", ["id"], 0.25)
    assert b.filter("c = 1").count() == round(429 * 0.25) and a.count() + b.count() == 3000
    same = sampling.stratified_split(df.repartition(3), "c", ["id"], 0.25)[1]
    assert same.exceptAll(b).count() == 0
    sizes = [r["count"] for r in sampling.folds(df, 5, ["id"], label="c").groupBy("c", "fold").count().collect()]
    assert len(sizes) == 10 and max(s for s in sizes if s < 200) - min(sizes) <= 1


@pytest.mark.parametrize("large", [False, True])
def test_strata_are_exact(spark, large, request):
    if large:
        request.getfixturevalue("large_paths")
    rows = [(i, None if i % 10 == 0 else "hot" if i % 3 else f"v{i % 50}") for i in range(900)] + [(1000, "one")]
    df = spark.createDataFrame(rows, "id long, c string")
    n = Counter(c for _, c in rows)
    for share in (0.001, 0.3, 0.999):
        train, test = sampling.stratified_split(df, "c", ["id"], share)
        got = Counter(r["c"] for r in test.collect())
        assert {c: got[c] for c in n} == {c: math.floor(v * share + 0.5) for c, v in n.items()}
        assert sorted(r["id"] for r in train.unionAll(test).collect()) == [i for i, _ in rows]
    folded = sampling.folds(df, 4, ["id"], label="c").collect()
    sizes = Counter((r["c"], r["fold"]) for r in folded)
    assert len(folded) == len(rows)
    assert all(sizes[c, f] == v // 4 + (f < v % 4) for c, v in n.items() for f in range(4))


def test_strata_neither_sort_nor_write_whole_rows(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("c"), F.lit("wide").alias("w"))
    plan = sampling.folds(df, 3, ["id"], label="c")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "rangepartitioning" not in plan and "Range (0, 500" in plan
    empty = sampling.stratified_split(df.filter("id < 0"), "c", ["id"])
    assert [p.count() for p in empty] == [0, 0]


def test_lookup_of_wide_values_of_hot_keys(spark, large_paths):
    df = spark.range(600).select((F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id"))).alias("k"), "id")
    table = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.repeat(F.lit("x"), F.lit(300)).alias("w"))
    spark.conf.set("tidepool.broadcastBytes", "3000")
    try:
        got = attach(df, table, ["k"], rows="n").groupBy("k").agg(F.count("w").alias("rows"), F.max("n").alias("n"))
        assert all(r["rows"] == r["n"] for r in got.collect()) and got.agg(F.sum("rows")).first()[0] == 600
    finally:
        spark.conf.unset("tidepool.broadcastBytes")


@pytest.mark.parametrize("unicode", [False, True])
def test_text_counts_like_patterns(spark, unicode):
    texts = ["", " ", "a", " a  b\n", "A1 b2\tC3!", "\u00a0x\u2003y", "\u0661\u0662 \u00c4\u00e4", "..\x0b..\r\n", "Z" * 5000 + " 9", None]
    flags = 0 if unicode else re.ASCII
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in text.add_features(df, "t", unicode=unicode).collect():
        t = texts[r["i"]] or ""
        assert r["t_word_count"] == len(re.findall(r"\S+", t, flags))
        assert r["t_uppercase_count"] == len(re.findall("[A-Z]", t))
        assert r["t_digit_count"] == len(re.findall(r"\d", t, flags))
        assert r["t_special_chars"] == len(re.findall(r"[^a-zA-Z0-9\s]", t, flags))


@pytest.mark.parametrize("large", [False, True])
def test_one_hot_of_many_values(spark, large, request):
    if large:
        request.getfixturevalue("large_paths")
    df = spark.range(100_000).select(F.concat(F.lit("v"), "id").alias("c")).unionAll(spark.sql("select null union all select 'v5'"))
    index = encoders.one_hot_index(df, "c")
    rows = encoders.one_hot_vector(df, "c", index)
    places = {r["c"]: r["c_index"] for r in index.filter("c in ('v0', 'v5')").collect()}
    for r in rows.filter("c in ('v0', 'v5') or c is null").collect():
        assert r["c_onehot"].size == 100_001
        assert list(r["c_onehot"].indices) == [places.get(r["c"], 100_000)]
    other = encoders.one_hot_vector(spark.createDataFrame([("new", 1)], "c string, c_onehot int"), "c", index)
    assert list(other.first()["c_onehot"].indices) == [100_000]
    counts = {r["place"]: r["rows"] for r in encoders.vector_counts(rows, "c_onehot").collect()}
    assert counts[places["v5"]] == 2 and sum(counts.values()) == 100_002
    assert encoders.one_hot_vector(df.filter("false"), "c").count() == 0


def test_bootstrap(spark):
    df = spark.range(20_000)
    with_repeats = sampling.bootstrap(df, ["id"], 1.0)
    assert abs(with_repeats.count() / 20_000 - 1) < 0.03
    assert abs(with_repeats.distinct().count() / 20_000 - (1 - math.exp(-1))) < 0.02
    once = sampling.bootstrap(df, ["id"], 0.5, replace=False)
    assert once.count() == once.distinct().count() and abs(once.count() / 20_000 - 0.5) < 0.02


def test_problem_type(spark):
    df = spark.range(100).select(
        (F.col("id") % 15).alias("whole"), (F.col("id") % 15).cast("double").alias("real"),
        F.col("id").cast("string").alias("s"), F.lit(None).cast("double").alias("none"), "id",
    )
    got = {c: prepare.problem_type(df, c) for c in df.columns}
    assert got == {
        "whole": "classification", "real": "regression", "s": "classification",
        "none": "classification", "id": "regression",
    }


def test_imputation(nulls):
    rows = typing.nan_to_null(nulls)
    fill = prepare.fit_imputation(rows, ["x", "k"], "mean")
    assert fill["x"] == pytest.approx(-1.0) and fill["k"] == "a"
    assert prepare.impute(rows, fill).filter("x is null or k is null").count() == 0
    assert prepare.fit_imputation(rows.filter("k is null"), ["k"])["k"] == "Unknown"


def test_range_filter_is_pushed_down(spark, capsys):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    got = filters.numeric_range(rows, "l_quantity", 1, 5).select("l_quantity")
    got.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(l_quantity" in plan and "ReadSchema: struct<l_quantity:double>" in plan
    days = filters.date_range(
        spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "ts",
        dt.date(2024, 1, 5), dt.date(2024, 1, 6),
    )
    days.explain("formatted")
    assert "GreaterThanOrEqual(ts" in capsys.readouterr().out

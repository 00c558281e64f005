import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepool.operators import groups, lookup, ordering, quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share key 0; some keys and values are missing."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        k = 0 if i % 3 == 0 else rng.choice([1, 2, 3, 4, None])
        v = rng.choice([None, 1.0, 2.0, 2.5, 9.0, rng.random()])
        rows.append((i, k, v, rng.randrange(200)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, k long, v double, o long").repartition(13)


def as_pandas(df):
    return df.toPandas().sort_values("id").reset_index(drop=True)


def test_positions_are_dense_and_ordered(spark, skewed):
    got = ordering.with_position(skewed, ["o", "id"]).toPandas().sort_values("_pos")
    assert got["_pos"].tolist() == list(range(900))
    assert got[["o", "id"]].values.tolist() == sorted(got[["o", "id"]].values.tolist())


def test_positions_descending_and_empty(spark, skewed):
    got = ordering.with_position(skewed, [F.desc("id")]).toPandas()
    assert (got["id"] + got["_pos"] == 899).all()
    assert ordering.with_position(skewed.limit(0), ["id"]).count() == 0


@pytest.mark.parametrize("block", [3, 50, 10_000])
def test_shift_crosses_blocks(spark, skewed, block):
    placed = ordering.with_position(skewed, ["o", "id"])
    shifts = [("back", F.col("id"), 1), ("far", F.col("id"), 17), ("ahead", F.col("id"), -5)]
    got = ordering.shift_positions(placed, shifts, block=block).toPandas().sort_values("_pos")
    assert len(got) == 900
    for name, k in (("back", 1), ("far", 17), ("ahead", -5)):
        want = got["id"].shift(k)
        pd.testing.assert_series_equal(got[name].astype(float), want, check_names=False)


def test_running_totals(spark, skewed):
    placed = ordering.with_position(skewed, ["o", "id"])
    got = ordering.running_totals(placed, {"a": F.col("o"), "n": F.lit(1)}, block=11)
    got = got.toPandas().sort_values("_pos")
    assert got["a"].tolist() == (got["o"].cumsum() - got["o"]).tolist()
    assert got["n"].tolist() == list(range(900))


def test_lags_by_key_are_the_same_on_both_ways(spark, skewed, large_paths):
    rows = skewed.filter("k is not null")
    wide = as_pandas(groups.lags(rows, "v", [1, 4, -2], ["o", "id"], ["k"]))
    for name in ("broadcastRows", "windowGroupRows"):
        spark.conf.unset(f"tidepool.{name}")
    plain = as_pandas(groups.lags(rows, "v", [1, 4, -2], ["o", "id"], ["k"]))
    pd.testing.assert_frame_equal(wide[plain.columns], plain)


def test_lag_without_key_has_no_single_partition(spark, skewed):
    got = groups.lags(skewed, "v", [1], ["o", "id"])
    assert "SinglePartition" not in got._jdf.queryExecution().toString()


def test_group_rank_large_and_small(spark, skewed, large_paths):
    large = as_pandas(groups.group_rank(skewed, "k", "v"))
    spark.conf.unset("tidepool.windowGroupRows")
    small = as_pandas(groups.group_rank(skewed, "k", "v"))
    p = as_pandas(skewed)
    want = p.groupby("k")["v"].rank()
    for got in (large, small):
        np.testing.assert_allclose(got["v_rank_in_k"], want)


def test_group_stats_large(spark, skewed, large_paths):
    got = as_pandas(groups.group_stats(skewed, "k", "v"))
    p = as_pandas(skewed)
    np.testing.assert_allclose(got["v_mean_by_k"], p["k"].map(p.groupby("k")["v"].mean()))
    np.testing.assert_allclose(got["v_std_by_k"], p["k"].map(p.groupby("k")["v"].std()))
    np.testing.assert_allclose(got["k_count"], p["k"].map(p.groupby("k").size()))


def test_quantiles_ranked(spark, skewed, large_paths):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.quantiles(skewed, ["v", "o"], probs)
    p = as_pandas(skewed)
    np.testing.assert_allclose(got["v"], np.quantile(p["v"].dropna(), probs))
    np.testing.assert_allclose(got["o"], np.quantile(p["o"], probs))
    by = quantiles.group_quantiles(skewed, ["k"], "v", probs).toPandas()
    want = p.groupby("k", dropna=False)["v"].apply(lambda s: np.quantile(s.dropna(), probs))
    assert len(by) == len(want)
    for _, row in by.iterrows():
        key = next(x for x in want.index if x == row["k"] or (x != x and row["k"] != row["k"]))
        np.testing.assert_allclose(row["q"], want[key])


def test_quantiles_of_nothing(spark, skewed):
    assert quantiles.quantiles(skewed.limit(0), ["v"], [0.5])["v"] == [None]


def test_value_ranks(spark, skewed):
    got = quantiles.value_ranks(skewed, [], "o").toPandas().sort_values("o")
    assert (got["before"] == got["n"].cumsum() - got["n"]).all() and (got["size"] == 900).all()


def test_attach_keeps_rows_with_hot_and_missing_keys(spark, skewed, large_paths):
    table = skewed.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = as_pandas(lookup.attach(skewed, table, ["k"], rows="n"))
    p = as_pandas(skewed)
    assert len(got) == 900
    np.testing.assert_allclose(got["n"], p["k"].map(p.groupby("k").size()))

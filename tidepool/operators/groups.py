"""Group and lag features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.columns import col, require
from tidepool.operators.lookup import attach
from tidepool.operators.ordering import ordered_shift, window_is_safe
from tidepool.operators.quantiles import value_ranks


def group_stats(
    df: DataFrame, group: str, value: str, kinds: Sequence[str] = ("mean", "std", "count")
) -> DataFrame:
    """Group mean, sample deviation and size on every row; NULL group gets NULL.

    The groups are aggregated first, with partial sums, and looked up after;
    a window would bring each group's rows into one task.
    """
    require(df, [group])
    require(df, [value], "numeric")
    made = {
        "mean": F.avg(col(value)).alias(f"{value}_mean_by_{group}"),
        "std": F.stddev_samp(col(value)).alias(f"{value}_std_by_{group}"),
        "count": F.count(F.lit(1)).alias(f"{group}_count"),
    }
    if not kinds or any(k not in made for k in kinds):
        raise ValueError(f"Group statistics are {', '.join(made)}")
    table = (
        df.filter(col(group).isNotNull())
        .groupBy(col(group))
        .agg(*[made[k] for k in kinds], F.count(F.lit(1)).alias("_rows"))
    )
    return attach(df, table, [group], rows="_rows").drop("_rows")


def group_rank(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rank within the group; equal values share their mean rank.

    Groups of a checked size use a window. Larger ones rank the counted values
    by a distributed sort and look the rank up.
    """
    require(df, [group])
    require(df, [value], "numeric")
    out = f"{value}_rank_in_{group}"
    if window_is_safe(df, [group]):
        present = col(value).isNotNull()
        by_value = Window.partitionBy(col(group), present).orderBy(col(value))
        ties = Window.partitionBy(col(group), present, col(value))
        mean_rank = F.rank().over(by_value) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
        return df.withColumn(out, F.when(present & col(group).isNotNull(), mean_rank))
    ranks = value_ranks(df.filter(col(group).isNotNull()).select(col(group), col(value)), [group], value)
    table = ranks.select(
        col(group),
        col(value),
        (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias(out),
        F.col("n").alias("_rows"),
    )
    return attach(df, table, [group, value], rows="_rows").drop("_rows")


def lags(
    df: DataFrame,
    name: str,
    periods: Sequence[int],
    order_by: Sequence[str | Column],
    keys: Sequence[str] = (),
) -> DataFrame:
    """``<name>_lag_k`` for k > 0, ``<name>_lead_k`` otherwise.

    ``order_by`` must be unique within ``keys``.
    """
    require(df, [name, *keys])
    shifts = [
        (f"{name}_lag_{p}" if p > 0 else f"{name}_lead_{abs(p)}", col(name), p) for p in periods
    ]
    return ordered_shift(df, shifts, order_by, keys)

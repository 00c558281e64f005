"""The tables behind charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.columns import col, require
from tidepool.operators.lookup import attach
from tidepool.operators.profile import group_aggregate
from tidepool.operators.quantiles import group_quantiles


def bar(df: DataFrame, x: str, y: str, how: str = "mean") -> DataFrame:
    """``y`` per ``x``; ``count`` counts rows and is named ``count``."""
    if how == "count":
        require(df, [x])
        return df.filter(col(x).isNotNull()).groupBy(col(x)).agg(
            F.count(F.lit(1)).alias("count")
        )
    return group_aggregate(df, x, y, how, name=y)


def mean_of_bars(bars: DataFrame, y: str) -> DataFrame:
    return bars.agg(F.avg(col(y)).alias("mean_of_bars"))


def line(df: DataFrame, x: str, y: str, how: str | None = None) -> DataFrame:
    """``y`` per ``x``, or the raw pairs."""
    if how is None:
        require(df, [x, y])
        return df.select(col(x), col(y))
    if how == "count":
        raise ValueError("A line has no count")
    return group_aggregate(df, x, y, how, name=y)


def scatter(df: DataFrame, x: str, y: str, extra: Sequence[str] = ()) -> DataFrame:
    """All points, with colour, size or hover columns."""
    names = list(dict.fromkeys([x, y, *extra]))
    require(df, names)
    return df.select(*[col(c) for c in names])


def _bin(value: Column, low: float, high: float, n: int) -> Column:
    if high == low:
        return F.when(value.isNotNull(), F.lit(0)).cast("long")
    width = (high - low) / n
    return F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(n - 1)).cast("long")


def _span(df: DataFrame, name: str) -> tuple[float | None, float | None]:
    x = col(name).cast("double")
    return tuple(df.agg(F.min(x), F.max(x)).first())


def density(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Points per cell of an equal grid, for scatters of any size."""
    require(df, [x, y], "numeric")
    both = df.select(
        col(x).cast("double").alias("_x"), col(y).cast("double").alias("_y")
    ).na.drop()
    x0, x1, y0, y1 = both.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    if x0 is None:
        x0 = x1 = y0 = y1 = 0.0
    cells = both.groupBy(
        _bin(F.col("_x"), x0, x1, bins).alias("x_bin"),
        _bin(F.col("_y"), y0, y1, bins).alias("y_bin"),
    )
    return cells.agg(F.count(F.lit(1)).alias("count"))


def histogram(df: DataFrame, name: str, bins: int = 30, group: str | None = None) -> DataFrame:
    """Exactly ``bins`` equal bins with their edges and counts, empty ones too."""
    require(df, [name], "numeric")
    low, high = _span(df, name)
    if low is None:
        low = high = 0.0
    keys = [col(group)] if group else []
    got = (
        df.filter(col(name).isNotNull())
        .groupBy(*keys, _bin(col(name).cast("double"), low, high, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # Zero rows for every bin are added before a second count: no join needed.
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")))
    if group:
        seen = got.select(col(group)).distinct()
        empty = seen.select(col(group), every.alias("bin"))
    else:
        empty = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    full = got.unionByName(empty.withColumn("count", F.lit(0).cast("long")))
    width = (high - low) / bins
    return (
        full.groupBy(*keys, "bin")
        .agg(F.sum("count").alias("count"))
        .withColumn("low", F.lit(low) + F.col("bin") * F.lit(width))
        .withColumn("high", F.lit(low) + (F.col("bin") + 1) * F.lit(width))
    )


def box(df: DataFrame, value: str, group: str, exact: bool = True) -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR, and outlier count per group."""
    require(df, [group])
    require(df, [value], "numeric")
    data = df.select(col(group), col(value).cast("double").alias("_v")).na.drop()
    table = group_quantiles(data, [group], "_v", [0.25, 0.5, 0.75], exact)
    q1, q2, q3 = (F.col("q")[i] for i in range(3))
    table = table.select(
        col(group),
        q1.alias("q1"),
        q2.alias("median"),
        q3.alias("q3"),
        (q1 - F.lit(1.5) * (q3 - q1)).alias("_low"),
        (q3 + F.lit(1.5) * (q3 - q1)).alias("_high"),
    )
    sizes = data.groupBy(col(group)).agg(F.count(F.lit(1)).alias("_rows"))
    placed = attach(data, table.join(sizes, group), [group], rows="_rows")
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    return placed.groupBy(col(group)).agg(
        F.min("_v").alias("min"),
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.max("_v").alias("max"),
        F.min(F.when(inside, F.col("_v"))).alias("low_whisker"),
        F.max(F.when(inside, F.col("_v"))).alias("high_whisker"),
        F.count_if(~inside).alias("outliers"),
        F.count(F.lit(1)).alias("count"),
    )


def time_line(
    df: DataFrame, when: str, value: str, tiebreak: str | None = None, every: str | None = None
) -> DataFrame:
    """Points sorted by date; ``every`` averages them per unit of time."""
    require(df, [when], "datetime")
    require(df, [value], "numeric")
    if every is None:
        names = [when, value] + ([tiebreak] if tiebreak else [])
        return df.select(*[col(c) for c in names]).orderBy(when, *names[2:])
    unit = F.date_trunc(every, col(when)).cast("timestamp_ntz")
    return (
        df.filter(col(when).isNotNull())
        .groupBy(unit.alias(when))
        .agg(F.avg(col(value)).alias(value))
        .orderBy(when)
    )


def shares(df: DataFrame, name: str) -> DataFrame:
    """Rows per category, and their percentage."""
    require(df, [name])
    n = df.agg(F.count(col(name))).first()[0]
    return (
        df.filter(col(name).isNotNull())
        .groupBy(col(name))
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("pct", F.round(F.col("count") * 100.0 / F.nullif(F.lit(n), F.lit(0)), 2))
    )

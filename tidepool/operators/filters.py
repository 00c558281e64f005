"""Row filters, projections and the filter report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.columns import col, require
from tidepool.functions import predicates as P


def value_set(df: DataFrame, name: str, values: Sequence[Any] | None) -> DataFrame:
    """Rows whose value is selected; ``None`` for all values, so no filter."""
    require(df, [name])
    return df if values is None else df.filter(P.one_of(name, values))


def text_search(df: DataFrame, name: str, pattern: str, literal: bool = False) -> DataFrame:
    require(df, [name], "text")
    return df if pattern == "" else df.filter(P.text_contains(name, pattern, literal))


def numeric_bounds(df: DataFrame, name: str) -> DataFrame:
    """The bounds a range filter offers."""
    require(df, [name], "numeric")
    return df.agg(
        F.min(col(name)).alias("low"),
        F.max(col(name)).alias("high"),
        F.countDistinct(col(name)).alias("distinct_values"),
    )


def numeric_range(
    df: DataFrame, name: str, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Inclusive range. Without bounds nothing is filtered, NULLs included."""
    require(df, [name], "numeric")
    if low is None and high is None:
        return df
    if low is not None and high is not None:
        return df.filter(P.in_range(name, low, high))
    return df.filter(col(name) >= low if low is not None else col(name) <= high)


def date_range(df: DataFrame, name: str, first: dt.date, last: dt.date) -> DataFrame:
    require(df, [name], "datetime")
    return df.filter(P.in_dates(name, first, last))


def all_of(df: DataFrame, tests: Sequence[Column]) -> DataFrame:
    """Several column filters at once."""
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def where(df: DataFrame, conditions: Sequence[P.Condition | tuple]) -> DataFrame:
    """The condition builder."""
    return df.filter(P.build(conditions, df.schema))


def complete_rows(df: DataFrame, cols: Sequence[str], at_least: int = 0) -> DataFrame:
    """Drop rows with a NULL in ``cols``; raise if too few are left."""
    require(df, cols)
    out = df.na.drop(subset=list(cols))
    if at_least and len(out.limit(at_least).select(F.lit(1)).collect()) < at_least:
        raise ValueError(f"Fewer than {at_least} complete rows in {', '.join(cols)}")
    return out


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    require(df, cols)
    return df.select(*[col(c) for c in cols])


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a column, replacing any column already called ``new``."""
    require(df, [old])
    if old == new:
        return df
    return df.drop(new).withColumnRenamed(old, new) if new in df.columns else (
        df.withColumnRenamed(old, new)
    )


def filter_report(df: DataFrame, tests: Sequence[Column], texts: Sequence[str] = ()) -> DataFrame:
    """Rows before and after a filter, counted in one scan of the base table."""
    test = reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
    counts = df.agg(
        F.count(F.lit(1)).alias("original_rows"), F.count_if(test).alias("filtered_rows")
    )
    removed = F.col("original_rows") - F.col("filtered_rows")
    share = F.when(F.col("original_rows") == 0, F.lit(0.0)).otherwise(
        F.try_divide(removed * 100.0, F.col("original_rows"))
    )
    return counts.select(
        "original_rows",
        "filtered_rows",
        removed.alias("rows_removed"),
        F.round(share, 2).alias("reduction_pct"),
        F.lit(len(tests)).cast("long").alias("filters"),
        F.lit("; ".join(texts)).alias("conditions"),
        F.lit("filtered" if tests else "original").alias("status"),
    )

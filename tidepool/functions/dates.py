"""Date features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.columns import col, require

# The features on offer, which are also the column suffixes.
KINDS = (
    "year",
    "month",
    "day",
    "quarter",
    "hour",
    "dayofweek",
    "is_weekend",
    "days_since_epoch",
)


def feature(name: str, kind: str) -> Column:
    c = col(name)
    simple = {
        "year": F.year,
        "month": F.month,
        "day": F.dayofmonth,
        "quarter": F.quarter,
        "hour": F.hour,
        # Monday is 0.
        "dayofweek": F.weekday,
    }
    if kind in simple:
        return simple[kind](c)
    if kind == "is_weekend":
        return F.coalesce((F.weekday(c) >= 5).cast("int"), F.lit(0))
    if kind == "days_since_epoch":
        return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    raise ValueError(f"Unknown date feature '{kind}'")


def add_features(df: DataFrame, name: str, kinds: Sequence[str] = KINDS) -> DataFrame:
    require(df, [name], "datetime")
    return df.withColumns({f"{name}_{k}": feature(name, k).cast("long") for k in kinds})

"""Type promotion of text columns and one form of missing value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.columns import classify, col


# What a text must look like to be a number. Matching is much cheaper than a
# failing cast, which raises inside for every value.
_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d{1,3})?|inf|infinity|nan)\s*$"

_WHOLE = r"^\s*[+-]?\d{1,18}\s*$"
_LONGEST = r"^\s*[+-]?\d{19}\s*$"


def _whole(name: str) -> Column:
    """Not NULL where the text is a whole number; only 19 digits may not fit."""
    longest = F.when(col(name).rlike(_LONGEST), col(name).try_cast("bigint"))
    return F.when(col(name).rlike(_WHOLE), F.lit(1).cast("bigint")).otherwise(longest)


def promote_types(
    df: DataFrame, cols: Sequence[str] | None = None, numeric: bool = True
) -> DataFrame:
    """Turn text columns into timestamps, else numbers, if every value parses.

    All columns are judged in one aggregation. Columns without any value stay.
    ``numeric=False`` tries timestamps only.
    """
    cols = list(cols) if cols is not None else classify(df)["text"]
    if not cols:
        return df
    marks = []
    for i, c in enumerate(cols):
        marks += [
            F.count(col(c)).alias(f"n{i}"),
            F.count(col(c).try_cast("timestamp_ntz")).alias(f"t{i}"),
            F.count_if(col(c).rlike(_NUMBER)).alias(f"d{i}"),
            F.count(_whole(c)).alias(f"l{i}"),
        ]
    row = df.agg(*marks).first()
    casts = {}
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        if not n:
            continue
        # Plain digits also parse as a year, yet are numbers.
        if row[f"t{i}"] == n and row[f"d{i}"] < n:
            casts[c] = col(c).cast("timestamp_ntz")
        elif numeric and row[f"l{i}"] == n:
            casts[c] = col(c).cast("bigint")
        elif numeric and row[f"d{i}"] == n:
            # The text nan is missing, like NULL.
            casts[c] = F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))
    return df.withColumns(casts) if casts else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float and double column."""
    fixes = {
        f.name: F.nanvl(col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    return df.withColumns(fixes) if fixes else df

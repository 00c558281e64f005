"""Encodings of categorical columns."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.columns import col, require
from tidepool.operators.lookup import attach
from tidepool.operators.ordering import with_position
from tidepool.session import checkpoint

MAX_ONE_HOT = 1_000


def one_hot_values(df: DataFrame, name: str) -> tuple[list[Any], bool]:
    """Distinct values in order, and whether NULL occurs."""
    found = df.select(col(name)).distinct().limit(MAX_ONE_HOT + 2).collect()
    if len(found) > MAX_ONE_HOT + 1:
        raise ValueError(f"'{name}' has more than {MAX_ONE_HOT} values; use one_hot_vector")
    values = [r[0] for r in found]
    return sorted(v for v in values if v is not None), None in values


def one_hot(
    df: DataFrame, name: str, fitted: tuple[list[Any], bool] | None = None
) -> DataFrame:
    """A boolean column per value, and ``<name>_nan`` if NULL occurs.

    More than ``MAX_ONE_HOT`` values do not make useful columns; `one_hot_vector`
    has no such bound.
    """
    require(df, [name])
    values, has_null = fitted or one_hot_values(df, name)
    new = {f"{name}_{v}": F.coalesce(col(name) == F.lit(v), F.lit(False)) for v in values}
    if has_null:
        new[f"{name}_nan"] = col(name).isNull()
    return df.withColumns(new) if new else df


def one_hot_index(df: DataFrame, name: str) -> DataFrame:
    """Table (value, ``<name>_index``, rows) of any number of values, in order from 0.

    Feed it to `one_hot_vector` to encode other rows alike.
    """
    require(df, [name])
    return checkpoint(label_codes(df, name).withColumnRenamed(f"{name}_label_encoded", f"{name}_index"))


def one_hot_vector(df: DataFrame, name: str, index: DataFrame | None = None) -> DataFrame:
    """``<name>_onehot``, a sparse vector with one 1 at the value's index.

    For as many values as there are: the index table is joined (see `attach`),
    and a row takes the space of one entry. NULL, and values that the index
    does not know, have the last place, after all values. Models take the
    vector beside other columns through Spark's assembler.
    """
    require(df, [name])
    index = one_hot_index(df, name) if index is None else index
    n = index.count()
    place, out = f"_{name}_place", f"{name}_onehot"
    coded = attach(df, index, [name], rows="_rows").drop("_rows", out)
    coded = coded.withColumn(place, F.coalesce(F.col(f"`{name}_index`"), F.lit(n)).cast("double"))
    # The encoder learns nothing but the number of places.
    places = df.sparkSession.createDataFrame([(float(n),)], f"`{place}` double")
    encoder = OneHotEncoder(inputCols=[place], outputCols=[out], dropLast=False).fit(places)
    return encoder.transform(coded).drop(place, f"{name}_index")


def vector_counts(df: DataFrame, vector: str) -> DataFrame:
    """(place, rows): rows that are not zero at each place of a vector column."""
    found = df.select(Summarizer.metrics("numNonZeros").summary(col(vector)).alias("s"))
    counts = found.select(F.posexplode(vector_to_array("s.numNonZeros")).alias("place", "rows"))
    return counts.select("place", F.col("rows").cast("long").alias("rows"))


def label_codes(
    df: DataFrame, name: str, order_by: Sequence[str | Column] | None = None
) -> DataFrame:
    """Table (value, code, rows): codes by first appearance, or by alphabet.

    ``order_by`` is the row order that defines appearance. The distinct values
    are numbered by global position, so their number does not matter.
    """
    if order_by:
        keys = [col(o) if isinstance(o, str) else o for o in order_by]
        first = F.min(F.struct(*keys))
    else:
        first = F.min(col(name))
    values = (
        df.filter(col(name).isNotNull())
        .groupBy(col(name))
        .agg(first.alias("_first"), F.count(F.lit(1)).alias("_rows"))
    )
    return with_position(values, ["_first", name], f"{name}_label_encoded").drop("_first")


def label(
    df: DataFrame, name: str, order_by: Sequence[str | Column] | None = None
) -> DataFrame:
    """``<name>_label_encoded``; NULL becomes −1."""
    require(df, [name])
    out = f"{name}_label_encoded"
    coded = attach(df, label_codes(df, name, order_by), [name], rows="_rows")
    return coded.withColumn(out, F.coalesce(col(out), F.lit(-1))).drop("_rows")


def frequency(df: DataFrame, name: str) -> DataFrame:
    """``<name>_frequency``: rows holding the same value."""
    require(df, [name])
    out = f"{name}_frequency"
    table = df.filter(col(name).isNotNull()).groupBy(col(name)).agg(F.count(F.lit(1)).alias(out))
    return attach(df, table, [name], rows=out)


def target(
    df: DataFrame, name: str, target_col: str, fit_on: DataFrame | None = None
) -> DataFrame:
    """``<name>_target_encoded``: mean target per value.

    ``fit_on`` fits the means elsewhere, for instance on the training part.
    """
    require(df, [name])
    source = fit_on if fit_on is not None else df
    require(source, [name])
    require(source, [target_col], "numeric")
    table = (
        source.filter(col(name).isNotNull())
        .groupBy(col(name))
        .agg(
            F.avg(col(target_col)).alias(f"{name}_target_encoded"),
            F.count(F.lit(1)).alias("_rows"),
        )
    )
    return attach(df, table, [name], rows="_rows").drop("_rows")

"""Getting data ready for models: problem type, imputation, scaling, checks."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.columns import classify, col, kind_of, require
from tidepool.operators.profile import correlations, high_correlations
from tidepool.operators.quantiles import quantiles

SCALINGS = ("none", "standard", "minmax", "robust")


def problem_type(df: DataFrame, target: str, threshold: int = 10, whole_numbers: int = 20) -> str:
    """``classification`` or ``regression``, from the target's type and values.

    Few distinct values, or not many distinct whole numbers, mean classes.
    """
    require(df, [target])
    if kind_of(df.schema[target].dataType) != "numeric":
        return "classification"
    # One value more than the larger bound is enough to decide.
    values = df.filter(col(target).isNotNull()).select(col(target)).distinct()
    n = values.limit(max(threshold, whole_numbers) + 1).count()
    if n <= threshold:
        return "classification"
    whole = isinstance(df.schema[target].dataType, T.IntegralType)
    return "classification" if whole and n <= whole_numbers else "regression"


def mode(df: DataFrame, name: str) -> Any:
    """The most frequent value, the smallest of equals; ``None`` if there is none."""
    row = (
        df.filter(col(name).isNotNull())
        .groupBy(col(name).alias("v"))
        .count()
        .orderBy(F.desc("count"), F.asc("v"))
        .first()
    )
    return row["v"] if row else None


def fit_imputation(
    df: DataFrame, cols: Sequence[str], strategy: str = "mean", constant: Any = None
) -> dict[str, Any]:
    """Fill values per column: mean or median of numbers, mode of the rest."""
    require(df, cols)
    if strategy not in ("mean", "median", "mode", "constant"):
        raise ValueError(f"Unknown imputation '{strategy}'")
    if strategy == "constant":
        return {c: constant for c in cols}
    numbers = [c for c in cols if kind_of(df.schema[c].dataType) == "numeric"]
    fill: dict[str, Any] = {}
    if strategy == "mean" and numbers:
        row = df.agg(*[F.avg(col(c)) for c in numbers]).first()
        fill.update(zip(numbers, row))
    elif strategy == "median" and numbers:
        fill.update({c: v[0] for c, v in quantiles(df, numbers, [0.5]).items()})
    for c in cols:
        if c not in fill:
            value = mode(df, c)
            fill[c] = "Unknown" if value is None and c not in numbers else value
    return fill


def impute(df: DataFrame, fill: dict[str, Any]) -> DataFrame:
    """Replace NULL by the fitted values."""
    new = {}
    for c, v in fill.items():
        if v is None:
            continue
        base = col(c)
        if isinstance(v, float) and kind_of(df.schema[c].dataType) == "numeric":
            base = base.cast("double")
        new[c] = F.coalesce(base, F.lit(v))
    return df.withColumns(new) if new else df


def fit_scaling(
    df: DataFrame, cols: Sequence[str], kind: str = "standard"
) -> dict[str, tuple[float, float]]:
    """(centre, width) per column; ``standard`` uses the population deviation.

    A column without spread gets width 1.
    """
    require(df, cols, "numeric")
    cols = list(cols)
    if kind == "none":
        return {c: (0.0, 1.0) for c in cols}
    if kind == "robust":
        found = quantiles(df, cols, [0.25, 0.5, 0.75])
        raw = {c: (q[1], q[2] - q[0] if q[0] is not None else None) for c, q in found.items()}
    elif kind in ("standard", "minmax"):
        marks = []
        for c in cols:
            x = col(c).cast("double")
            if kind == "standard":
                marks += [F.avg(x), F.stddev_pop(x)]
            else:
                marks += [F.min(x), F.max(x) - F.min(x)]
        row = df.agg(*marks).first()
        raw = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(cols)}
    else:
        raise ValueError(f"Unknown scaling '{kind}'")
    return {c: (m or 0.0, w or 1.0) for c, (m, w) in raw.items()}


def scaled(name: str, fitted: tuple[float, float]) -> Column:
    return (col(name).cast("double") - F.lit(fitted[0])) / F.lit(fitted[1])


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """Replace columns by their scaled values."""
    return df.withColumns({c: scaled(c, f) for c, f in fitted.items()})


def validate(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Checks of a training table: one row (check, level, detail) per finding."""
    spark = df.sparkSession
    found: list[tuple[str, str, str]] = []
    absent = [c for c in [target, *features] if c not in df.columns]
    schema = "check string, level string, detail string"
    if absent:
        return spark.createDataFrame([("missing columns", "error", ", ".join(absent))], schema)
    kinds = classify(df)
    marks = [F.count(F.lit(1)), F.count(col(target)), F.countDistinct(col(target))]
    for f in features:
        marks += [F.count(col(f)), F.min(col(f)).eqNullSafe(F.max(col(f)))]
    row = df.agg(*marks).first()
    n, present, distinct = row[0], row[1], row[2]
    if n < 10:
        found.append(("rows", "error", f"{n} rows, at least 10 needed"))
    elif n < 100:
        found.append(("rows", "warning", f"{n} rows, 100 are better"))
    if present < n:
        found.append(("missing target", "warning", f"{n - present} rows"))
    if distinct <= 1:
        found.append(("target", "error", "a single value"))
    elif distinct == present and kind_of(df.schema[target].dataType) != "numeric":
        found.append(("target", "warning", "every value is distinct"))
    for i, f in enumerate(features):
        have, constant = row[3 + 2 * i], row[4 + 2 * i]
        if have < n:
            found.append(("missing values", "warning", f"{f}: {n - have} rows"))
        if constant:
            found.append(("constant feature", "warning", f))
    others = [f for f in features if f not in kinds["numeric"]]
    found += [("feature is not numeric", "warning", f) for f in others]
    numbers = [f for f in features if f in kinds["numeric"]]
    if len(numbers) > 1:
        for r in high_correlations(correlations(df, numbers)).orderBy("a", "b").collect():
            found.append(("high correlation", "warning", f"{r['a']}, {r['b']}"))
    if not found:
        found.append(("table", "ok", "no findings"))
    return spark.createDataFrame(found, schema)

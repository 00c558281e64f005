"""Numeric features: fit gives a few numbers, the rest is a column expression."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.columns import col, require
from tidepool.operators.quantiles import quantiles

# The column suffix of each transform.
SUFFIXES = {
    "log": "log_transform",
    "sqrt": "square_root",
    "square": "square",
    "reciprocal": "reciprocal",
    "standard": "standardscaler",
    "minmax": "minmaxscaler",
    "robust": "robustscaler",
    "bins": "quantile_binning",
}


def fit(
    df: DataFrame, name: str, kind: str, n_bins: int = 5, exact: bool = True
) -> dict[str, Any]:
    """The numbers a transform needs, from one or two scans."""
    require(df, [name], "numeric")
    c = col(name).cast("double")
    if kind == "log":
        low = df.agg(F.min(c)).first()[0]
        return {"shift": abs(low) + 1.0 if low is not None and low <= 0 else 0.0}
    if kind == "standard":
        mean, std = df.agg(F.avg(c), F.stddev_samp(c)).first()
        if not std:
            raise ValueError(f"Cannot standardise '{name}': no spread")
        return {"mean": mean, "std": std}
    if kind == "minmax":
        low, high = df.agg(F.min(c), F.max(c)).first()
        if low is None or low == high:
            raise ValueError(f"Cannot scale '{name}': all values are equal")
        return {"low": low, "high": high}
    if kind == "robust":
        q1, q2, q3 = quantiles(df, [name], [0.25, 0.5, 0.75], exact)[name]
        if q1 is None or q1 == q3:
            raise ValueError(f"Cannot scale '{name}': the quartiles are equal")
        return {"median": q2, "iqr": q3 - q1}
    if kind == "bins":
        if n_bins < 2:
            raise ValueError("At least two bins")
        marks = [i / n_bins for i in range(n_bins + 1)]
        edges = quantiles(df, [name], marks, exact)[name]
        return {"edges": sorted({e for e in edges if e is not None})}
    if kind in SUFFIXES:
        return {}
    raise ValueError(f"Unknown transform '{kind}'")


def expression(name: str, kind: str, fitted: dict[str, Any]) -> Column:
    """The transform as a column; works on batch and streaming tables alike."""
    c = col(name).cast("double")
    if kind == "log":
        return F.ln(c + F.lit(fitted["shift"])) if fitted["shift"] else F.ln(c)
    if kind == "sqrt":
        return F.sqrt(F.abs(c))
    if kind == "square":
        return c * c
    if kind == "reciprocal":
        return F.lit(1.0) / F.nullif(c, F.lit(0.0))
    if kind == "standard":
        return (c - F.lit(fitted["mean"])) / F.lit(fitted["std"])
    if kind == "minmax":
        return (c - F.lit(fitted["low"])) / F.lit(fitted["high"] - fitted["low"])
    if kind == "robust":
        return (c - F.lit(fitted["median"])) / F.lit(fitted["iqr"])
    if kind == "bins":
        edges = fitted["edges"]
        if len(edges) < 2:
            return F.lit(None).cast("long")
        # Bins are closed on the right; the lowest edge is in the first bin.
        code = F.lit(0)
        for e in edges[1:-1]:
            code = code + (c > F.lit(e)).cast("int")
        return F.when(c.between(edges[0], edges[-1]), code).cast("long")
    raise ValueError(f"Unknown transform '{kind}'")


def transform(
    df: DataFrame,
    name: str,
    kind: str,
    new_name: str | None = None,
    n_bins: int = 5,
    exact: bool = True,
) -> DataFrame:
    fitted = fit(df, name, kind, n_bins, exact)
    return df.withColumn(new_name or f"{name}_{SUFFIXES[kind]}", expression(name, kind, fitted))


# The name each arithmetic feature gets.
_ARITHMETIC = {
    "multiply": "{a}_x_{b}",
    "add": "{a}_plus_{b}",
    "subtract": "{a}_minus_{b}",
    "divide": "{a}_div_{b}",
}


def arithmetic(df: DataFrame, a: str, b: str, kind: str, name: str | None = None) -> DataFrame:
    """``a`` and ``b`` combined; dividing by 0 gives a missing value."""
    if kind not in _ARITHMETIC:
        raise ValueError(f"Unknown combination '{kind}'")
    require(df, [a, b], "numeric")
    x, y = col(a).cast("double"), col(b).cast("double")
    value = {
        "multiply": x * y,
        "add": x + y,
        "subtract": x - y,
        "divide": x / F.nullif(y, F.lit(0.0)),
    }[kind]
    return df.withColumn(name or _ARITHMETIC[kind].format(a=a, b=b), value)


def ratio(
    df: DataFrame,
    numerator: str,
    denominator: str,
    zero: str = "nan",
    name: str | None = None,
) -> DataFrame:
    """A ratio; a zero denominator gives a missing value, or acts as 1e-10."""
    require(df, [numerator, denominator], "numeric")
    d = col(denominator).cast("double")
    if zero == "small_value":
        d = F.when(d == 0, F.lit(1e-10)).otherwise(d)
    elif zero in ("nan", "skip"):
        d = F.nullif(d, F.lit(0.0))
    else:
        raise ValueError(f"Unknown zero policy '{zero}'")
    return df.withColumn(
        name or f"{numerator}_to_{denominator}_ratio", col(numerator).cast("double") / d
    )


def outliers(df: DataFrame, name: str, method: str = "iqr", exact: bool = True) -> DataFrame:
    """Outlier flag with the distance beyond the fences, or with the z-score."""
    require(df, [name], "numeric")
    c = col(name).cast("double")
    if method == "iqr":
        low, high = fences(df, [name], exact)[name]
        below, above = c < F.lit(low), c > F.lit(high)
        return df.withColumns(
            {
                f"{name}_is_outlier_iqr": F.coalesce((below | above).cast("long"), F.lit(0)),
                f"{name}_outlier_distance": F.when(below, F.lit(low) - c)
                .when(above, c - F.lit(high))
                .otherwise(F.lit(0.0)),
            }
        )
    if method == "zscore":
        mean, std = df.agg(F.avg(c), F.stddev_samp(c)).first()
        z = F.abs(c - F.lit(mean)) / F.nullif(F.lit(std), F.lit(0.0))
        return df.withColumns(
            {
                f"{name}_is_outlier_zscore": F.coalesce((z > 3).cast("long"), F.lit(0)),
                f"{name}_zscore": z,
            }
        )
    raise ValueError(f"Unknown outlier method '{method}'")


def fences(
    df: DataFrame, cols: list[str], exact: bool = True
) -> dict[str, tuple[float | None, float | None]]:
    """Q1 − 1.5·IQR and Q3 + 1.5·IQR per column."""
    out = {}
    for c, (q1, q3) in quantiles(df, cols, [0.25, 0.75], exact).items():
        if q1 is None:
            out[c] = (None, None)
        else:
            out[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out


def feature_summary(base: DataFrame, featured: DataFrame) -> DataFrame:
    """One row per new column: type and non-null count, with the column totals."""
    new = [f for f in featured.schema.fields if f.name not in base.columns]
    spark = featured.sparkSession
    if not new:
        return spark.createDataFrame(
            [],
            "feature string, type string, non_null long, original long, created long, total long",
        )
    counts = featured.agg(*[F.count(col(f.name)).alias(f"c{i}") for i, f in enumerate(new)])
    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("feature"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col(f"c{i}").alias("non_null"),
            )
            for i, f in enumerate(new)
        ]
    )
    return counts.select(F.inline(rows)).select(
        "feature",
        "type",
        "non_null",
        F.lit(len(featured.columns) - len(new)).cast("long").alias("original"),
        F.lit(len(new)).cast("long").alias("created"),
        F.lit(len(featured.columns)).cast("long").alias("total"),
    )


def reset(base: DataFrame, featured: DataFrame) -> DataFrame:
    """Drop every derived column."""
    return featured.drop(*[c for c in featured.columns if c not in base.columns])

"""Profiles of whole tables. Each fact comes from one wide aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.columns import classify, col, kind_of, require, type_name
from tidepool.operators.numeric import fences
from tidepool.operators.quantiles import group_quantiles, quantiles
from tidepool.session import checkpoint

METRICS = ("mean", "sum", "count", "median", "std", "min", "max")
_LONG_TEXT = 64


def rows_from(one_row: DataFrame, records: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Turn one wide row into one row per record."""
    return one_row.select(
        F.inline(F.array(*[F.struct(*[v.alias(k) for k, v in r.items()]) for r in records]))
    )


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    """``part`` of ``whole`` in percent, 0 for nothing of nothing."""
    share = F.try_divide(part * F.lit(100.0), whole)
    return F.coalesce(F.round(share, places), F.lit(0.0))


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; missing below three values or without spread."""
    n = F.count(c).cast("double")
    g1 = F.nanvl(F.skewness(c), F.lit(None).cast("double"))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; missing below four values."""
    n = F.count(c).cast("double")
    g2 = F.nanvl(F.kurtosis(c), F.lit(None).cast("double"))
    bottom = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n > 3, (n - 1) / bottom * ((n + 1) * g2 + 6))


def _lit(value: float | None) -> Column:
    return F.lit(value).cast("double")


def _numeric(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    cols = list(cols) if cols is not None else classify(df)["numeric"]
    require(df, cols, "numeric")
    if not cols:
        raise ValueError("No numeric columns")
    return cols


def _number(name: str) -> Column:
    return col(name).cast("double")


def describe(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per numeric column."""
    cols = _numeric(df, cols)
    q = quantiles(df, cols, [0.25, 0.5, 0.75], exact)
    wide, records = [], []
    for i, c in enumerate(cols):
        x = _number(c)
        wide += [
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"m{i}"),
            F.stddev_samp(x).alias(f"s{i}"),
            F.min(x).alias(f"lo{i}"),
            F.max(x).alias(f"hi{i}"),
        ]
        records.append(
            {
                "column": F.lit(c),
                "count": F.col(f"n{i}"),
                "mean": F.col(f"m{i}"),
                "std": F.col(f"s{i}"),
                "min": F.col(f"lo{i}"),
                "p25": _lit(q[c][0]),
                "p50": _lit(q[c][1]),
                "p75": _lit(q[c][2]),
                "max": F.col(f"hi{i}"),
            }
        )
    return rows_from(df.agg(*wide), records)


def extremes(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Largest and smallest value of each numeric column."""
    cols = _numeric(df, cols)
    wide, records = [], []
    for i, c in enumerate(cols):
        wide += [F.max(_number(c)).alias(f"hi{i}"), F.min(_number(c)).alias(f"lo{i}")]
        records.append(
            {"column": F.lit(c), "max": F.col(f"hi{i}"), "min": F.col(f"lo{i}")}
        )
    return rows_from(df.agg(*wide), records)


def group_aggregate(
    df: DataFrame, group: str, value: str, metric: str, exact: bool = True, name: str | None = None
) -> DataFrame:
    """One metric of ``value`` per group, named ``<metric>_<value>``; NULL group dropped."""
    if metric not in METRICS:
        raise ValueError(f"Unknown metric '{metric}'")
    require(df, [group, value])
    name = name or f"{metric}_{value}"
    df = df.filter(col(group).isNotNull())
    if metric == "median":
        got = group_quantiles(df.select(col(group), col(value)), [group], value, [0.5], exact)
        return got.select(col(group), F.col("q")[0].alias(name))
    made = {
        "mean": F.avg,
        "sum": F.sum,
        "count": F.count,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
    }[metric]
    return df.groupBy(col(group)).agg(made(col(value)).alias(name))


def _missing(df: DataFrame) -> list[Column]:
    return [F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]


def missing_report(df: DataFrame) -> DataFrame:
    """Per column: type, missing count and share, non-null count."""
    wide = df.agg(F.count(F.lit(1)).alias("n"), *_missing(df))
    return rows_from(
        wide,
        [
            {
                "column": F.lit(f.name),
                "type": F.lit(type_name(f.dataType)),
                "missing": F.col("n") - F.col(f"c{i}"),
                "missing_pct": percent(F.col("n") - F.col(f"c{i}"), F.col("n")),
                "non_null": F.col(f"c{i}"),
            }
            for i, f in enumerate(df.schema.fields)
        ],
    )


def missing_total(df: DataFrame) -> DataFrame:
    """Missing cells of the whole table, and their share."""
    wide = df.agg(F.count(F.lit(1)).alias("n"), *_missing(df))
    cells = F.col("n") * len(df.columns)
    present = sum((F.col(f"c{i}") for i in range(len(df.columns))), F.lit(0))
    return wide.select(
        (cells - present).alias("missing_cells"),
        percent(cells - present, cells).alias("missing_pct"),
    )


def _distinct(c: Column, exact: bool) -> Column:
    return F.countDistinct(c) if exact else F.approx_count_distinct(c)


def type_summary(
    df: DataFrame, order_by: str, cols: Sequence[str] | None = None, exact: bool = True
) -> DataFrame:
    """Per column: type, class, distinct values, and the first value by ``order_by``."""
    cols = list(cols) if cols is not None else df.columns
    require(df, [*cols, order_by])
    wide, records = [], []
    for i, c in enumerate(cols):
        kind = df.schema[c].dataType
        first = F.min_by(col(c), F.when(col(c).isNotNull(), col(order_by)))
        wide += [_distinct(col(c), exact).alias(f"d{i}"), first.cast("string").alias(f"s{i}")]
        records.append(
            {
                "column": F.lit(c),
                "type": F.lit(type_name(kind)),
                "class": F.lit(kind_of(kind)),
                "distinct_values": F.col(f"d{i}"),
                "sample": F.col(f"s{i}"),
            }
        )
    return rows_from(df.agg(*wide), records)


def type_counts(summary: DataFrame) -> DataFrame:
    """Columns per class, from a type summary."""
    return summary.groupBy("class").agg(F.count(F.lit(1)).alias("columns"))


DISTRIBUTION_MARKS = (0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def distribution(
    df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True
) -> DataFrame:
    """Mean, median, deviation, skewness and percentiles per numeric column."""
    cols = _numeric(df, cols)
    q = quantiles(df, cols, DISTRIBUTION_MARKS, exact)
    wide, records = [], []
    for i, c in enumerate(cols):
        x = _number(c)
        wide += [
            F.avg(x).alias(f"m{i}"),
            F.stddev_samp(x).alias(f"s{i}"),
            sample_skewness(x).alias(f"k{i}"),
        ]
        record = {
            "column": F.lit(c),
            "mean": F.col(f"m{i}"),
            "median": _lit(q[c][2]),
            "std": F.col(f"s{i}"),
            "skewness": F.col(f"k{i}"),
        }
        for p, v in zip(DISTRIBUTION_MARKS, q[c]):
            record[f"p{round(p * 100)}"] = _lit(v)
        records.append(record)
    return rows_from(df.agg(*wide), records)


def shape(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Skewness, excess kurtosis and missing count per numeric column."""
    cols = _numeric(df, cols)
    wide, records = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(cols):
        x = _number(c)
        wide += [
            sample_skewness(x).alias(f"g{i}"),
            sample_kurtosis(x).alias(f"k{i}"),
            F.count(x).alias(f"c{i}"),
        ]
        records.append(
            {
                "column": F.lit(c),
                "skewness": F.col(f"g{i}"),
                "kurtosis": F.col(f"k{i}"),
                "missing": F.col("n") - F.col(f"c{i}"),
            }
        )
    return rows_from(df.agg(*wide), records)


def column_info(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: type, non-null, null and distinct counts."""
    wide = [F.count(F.lit(1)).alias("n"), *_missing(df)]
    wide += [_distinct(col(c), exact).alias(f"d{i}") for i, c in enumerate(df.columns)]
    return rows_from(
        df.agg(*wide),
        [
            {
                "column": F.lit(f.name),
                "type": F.lit(type_name(f.dataType)),
                "non_null": F.col(f"c{i}"),
                "nulls": F.col("n") - F.col(f"c{i}"),
                "distinct_values": F.col(f"d{i}"),
            }
            for i, f in enumerate(df.schema.fields)
        ],
    )


def numeric_summary(df: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """Counts, mean, median, extremes, deviation and range of one column."""
    require(df, [name], "numeric")
    x = _number(name)
    median = quantiles(df, [name], [0.5], exact)[name][0]
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(x).alias("non_null"),
        (F.count(F.lit(1)) - F.count(x)).alias("nulls"),
        _distinct(x, exact).alias("distinct_values"),
        F.avg(x).alias("mean"),
        _lit(median).alias("median"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.stddev_samp(x).alias("std"),
        (F.max(x) - F.min(x)).alias("range"),
    )


def value_counts(df: DataFrame, name: str, top: int = 10, share: bool = True) -> DataFrame:
    """The most frequent values; NULL is not counted, but is in the share's base.

    The grouped table is kept, so the base is scanned once; it also gives the
    count of all rows and of distinct values.
    """
    require(df, [name])
    counts = checkpoint(df.groupBy(col(name)).agg(F.count(F.lit(1)).alias("count")))
    totals = counts.agg(F.sum("count").alias("_rows"), F.count(col(name)).alias("_distinct"))
    n, distinct = totals.first()
    got = (
        counts.filter(col(name).isNotNull())
        .orderBy(F.desc("count"), F.asc(name))
        .limit(top)
    )
    if share:
        got = got.withColumn("pct", percent(F.col("count"), F.lit(n or 0)))
    return got.withColumn("distinct_values", F.lit(distinct).cast("long"))


def date_summary(df: DataFrame, name: str) -> DataFrame:
    """Earliest, latest and whole days between."""
    require(df, [name], "datetime")
    got = df.agg(F.min(col(name)).alias("earliest"), F.max(col(name)).alias("latest"))
    days = F.timestamp_diff("DAY", F.col("earliest"), F.col("latest"))
    return got.withColumn("range_days", days)


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each identical row; NULLs are equal.

    Long texts are compared by their SHA-256, so whole texts are read but only
    digests are shuffled. A digest carries a mark and is one character longer
    than any text left as it is, so the two never meet.
    """
    cols = list(cols) if cols is not None else df.columns
    require(df, cols)
    keys = []
    for c in cols:
        if isinstance(df.schema[c].dataType, T.StringType):
            digest = F.concat(F.lit("#"), F.sha2(col(c), 256))
            keys.append(F.when(F.length(col(c)) > _LONG_TEXT, digest).otherwise(col(c)).alias(c))
        else:
            keys.append(col(c))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
    )


def quality(df: DataFrame) -> DataFrame:
    """Quality score, completeness and duplicate rows of the table."""
    dup = duplicate_rows(df).first()["duplicates"]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *_missing(df))
    cells = F.col("n") * len(df.columns)
    present = sum((F.col(f"c{i}") for i in range(len(df.columns))), F.lit(0))
    bad = F.try_divide((cells - present + F.lit(dup)) * 100.0, cells)
    return wide.select(
        F.round(F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(bad, F.lit(0.0))), 2).alias(
            "quality_score"
        ),
        percent(present, cells).alias("completeness_pct"),
        (cells - present).alias("missing_cells"),
        F.lit(dup).cast("long").alias("duplicate_rows"),
    )


def issues(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: missing values, high duplication of text, numeric outliers."""
    kinds = classify(df)
    limits = fences(df, kinds["numeric"], exact) if kinds["numeric"] else {}
    wide, records = [F.count(F.lit(1)).alias("n"), *_missing(df)], []
    for i, f in enumerate(df.schema.fields):
        n = F.col("n")
        missing = n - F.col(f"c{i}")
        parts = [
            F.when(
                missing > 0,
                F.format_string("%d missing (%.1f%%)", missing, percent(missing, n, 1)),
            )
        ]
        if kind_of(f.dataType) == "text":
            wide.append(_distinct(col(f.name), exact).alias(f"d{i}"))
            rare = F.col(f"d{i}") < n * F.lit(0.5)
            copies = percent(n - F.col(f"d{i}"), n, 1)
            parts.append(F.when(rare, F.format_string("High duplication (%.1f%%)", copies)))
        if f.name in limits and limits[f.name][0] is not None:
            low, high = limits[f.name]
            x = _number(f.name)
            wide.append(F.count_if((x < F.lit(low)) | (x > F.lit(high))).alias(f"o{i}"))
            out = F.col(f"o{i}")
            parts.append(
                F.when(out > 0, F.format_string("%d outliers (%.1f%%)", out, percent(out, n, 1)))
            )
        found = F.array_compact(F.array(*parts))
        records.append(
            {
                "column": F.lit(f.name),
                "type": F.lit(type_name(f.dataType)),
                "issues": F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise(
                    F.lit("No issues")
                ),
                "issue_count": F.size(found).cast("long"),
            }
        )
    return rows_from(df.agg(*wide), records)


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns by class, missing cells and duplicate rows."""
    kinds = classify(df)
    dup = duplicate_rows(df).first()["duplicates"]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *_missing(df))
    present = sum((F.col(f"c{i}") for i in range(len(df.columns))), F.lit(0))

    def fixed(value: int) -> Column:
        return F.lit(value).cast("long")

    return wide.select(
        F.col("n").alias("rows"),
        fixed(len(df.columns)).alias("columns"),
        fixed(len(kinds["numeric"])).alias("numeric_columns"),
        fixed(len(kinds["text"])).alias("text_columns"),
        fixed(len(kinds["datetime"])).alias("date_columns"),
        (F.col("n") * len(df.columns) - present).alias("missing_cells"),
        fixed(dup).alias("duplicate_rows"),
    )


def report(df: DataFrame, order_by: str, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """The data report: the overview, and the details of each column."""
    details = column_info(df, exact).join(
        type_summary(df, order_by, exact=exact).select("column", "sample"), "column"
    )
    return overview(df), details


def insights(df: DataFrame, exact: bool = True) -> DataFrame:
    """Quick rules about size, missing data, column classes and duplicates."""
    kinds = classify(df)
    texts = kinds["text"]
    dup = duplicate_rows(df).first()["duplicates"]
    wide = [F.count(F.lit(1)).alias("n"), *_missing(df)]
    wide += [_distinct(col(c), exact).alias(f"d{i}") for i, c in enumerate(texts)]
    n = F.col("n")
    present = sum((F.col(f"c{i}") for i in range(len(df.columns))), F.lit(0))
    cells = n * len(df.columns)
    missing = F.try_divide((cells - present) * 100.0, cells)
    nothing = F.lit(None).cast("string")

    def rule(name: str, test: Column, value: Column, column: Column = nothing):
        return {
            "rule": F.when(test, F.lit(name)),
            "column": column,
            "value": value.cast("double"),
        }

    rules = [
        rule("large dataset", n > 100_000, n),
        rule("small dataset", n < 100, n),
        rule("high missing data", missing > 10, missing),
        rule("complete data", missing == 0, missing),
        rule(
            "numeric heavy",
            F.lit(len(kinds["numeric"]) > 0.8 * len(df.columns)),
            F.lit(len(kinds["numeric"])),
        ),
        rule("duplicates found", F.lit(dup > 0), F.lit(dup)),
        rule(
            "time series potential",
            F.lit(bool(kinds["datetime"])),
            F.lit(len(kinds["datetime"])),
        ),
    ]
    for i, c in enumerate(texts):
        share = F.try_divide(F.col(f"d{i}").cast("double"), n)
        rules.append(rule("high cardinality", share > 0.9, F.round(share, 6), F.lit(c)))
        rules.append(rule("low cardinality", share < 0.1, F.round(share, 6), F.lit(c)))
    return rows_from(df.agg(*wide), rules).filter(F.col("rule").isNotNull())


def pearson(x: Column, y: Column) -> Column:
    """Correlation over complete pairs; missing where either side is constant
    (the built-in divides by zero there)."""
    sx = F.stddev_pop(F.when(y.isNotNull(), x))
    sy = F.stddev_pop(F.when(x.isNotNull(), y))
    return F.covar_pop(x, y) / F.nullif(sx * sy, F.lit(0.0))


def correlations(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson matrix in long form; each pair uses rows complete in that pair."""
    cols = _numeric(df, cols)
    wide, records = [], []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            b = cols[j]
            wide.append(pearson(_number(a), _number(b)).alias(f"r{i}_{j}"))
            records.append({"a": F.lit(a), "b": F.lit(b), "r": F.col(f"r{i}_{j}")})
            if i != j:
                records.append({"a": F.lit(b), "b": F.lit(a), "r": F.col(f"r{i}_{j}")})
    return rows_from(df.agg(*wide), records)


def high_correlations(matrix: DataFrame, above: float = 0.95) -> DataFrame:
    """Pairs whose absolute correlation is above a bound, each pair once."""
    return matrix.filter((F.abs("r") > above) & (F.col("a") < F.col("b")))

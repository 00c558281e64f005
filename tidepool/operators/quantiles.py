"""Exact quantiles (linear interpolation) at any size, and value ranks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.columns import col
from tidepool.operators.lookup import attach
from tidepool.operators.ordering import running_totals, with_position
from tidepool.session import PERCENTILE_DISTINCT, limit_of

ACCURACY = 10_000
# A bracket of this many values is read as it is.
BRACKET_ROWS = 20_000


def value_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per (group, value): count ``n``, rows ``before`` it in its group,
    and the group's ``size``. NULL values are left out.

    Rows are counted before they are sorted, so copies of one value travel as
    one row, and sorting is by range, so a hot group spreads over tasks.
    """
    counts = (
        df.filter(col(value).isNotNull())
        .groupBy(*[col(b) for b in by], col(value))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = with_position(counts, [*by, value])
    placed = running_totals(placed, {"_cum": F.col("n")}).drop("_pos")
    if not by:
        size = placed.agg(F.sum("n")).first()[0] or 0
        return placed.withColumnRenamed("_cum", "before").withColumn(
            "size", F.lit(size).cast("long")
        )
    # Group keys may be NULL: compare them through a non-null stand-in.
    tags = [F.struct(col(b).isNull(), col(b)).alias(f"_k{i}") for i, b in enumerate(by)]
    placed = placed.select("*", *tags)
    names = [f"_k{i}" for i in range(len(by))]
    groups = placed.groupBy(*names).agg(
        F.min("_cum").alias("_start"),
        F.sum("n").alias("size"),
        F.count(F.lit(1)).alias("_rows"),
    )
    return (
        attach(placed, groups, names, rows="_rows")
        .withColumn("before", F.col("_cum") - F.col("_start"))
        .drop("_cum", "_start", "_rows", *names)
    )


def _at_rank(rank: Column, value: Column) -> Column:
    hit = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
    return F.max(F.when(hit, value))


def _ranked(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    ranks = value_ranks(df, by, value).withColumn("_v", col(value).cast("double"))
    parts = []
    for i, p in enumerate(probs):
        at = F.lit(p) * (F.col("size") - 1)
        parts.append(_at_rank(F.floor(at), F.col("_v")).alias(f"_l{i}"))
        parts.append(_at_rank(F.ceil(at), F.col("_v")).alias(f"_h{i}"))
    parts.append(F.max("size").alias("_n"))
    got = ranks.groupBy(*[col(b) for b in by]).agg(*parts)
    cells = []
    for i, p in enumerate(probs):
        at = F.lit(p) * (F.col("_n") - 1)
        frac = at - F.floor(at)
        cells.append(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * frac)
    return got.select(*[col(b) for b in by], F.array(*cells).alias("q"))


@dataclass
class _Target:
    """One wanted rank pair of a column, and the value bracket that holds it."""

    column: str
    prob: float
    low_rank: int
    high_rank: int
    total: int
    size: int
    low: float | None = None
    high: float | None = None
    below: int = 0

    def inside(self, x: Column) -> Column:
        return x.isNotNull() if self.low is None else x.between(self.low, self.high)

    def value(self, first: float, second: float) -> float:
        at = self.prob * (self.total - 1)
        return first + (second - first) * (at - self.low_rank)


def _number(name: str) -> Column:
    """The column as a double, NaN counting as missing."""
    x = col(name).cast("double")
    return F.when(~F.isnan(x), x)


def _narrow(df: DataFrame, targets: list[_Target]) -> None:
    """Shrink brackets by sketch quantiles, then count what they really hold.

    The sketch only proposes a bracket; the counts decide. A bracket that
    misses its ranks stays as it was and is marked by ``size`` −1.
    """
    groups: dict[tuple, list[_Target]] = {}
    for t in targets:
        groups.setdefault((t.column, t.low, t.high), []).append(t)
    sketches = []
    for held in groups.values():
        marks = []
        for t in held:
            span = max(t.size - 1, 1)
            marks.append(max(0.0, (t.low_rank - t.below) / span - 2 / ACCURACY))
            marks.append(min(1.0, (t.high_rank - t.below) / span + 2 / ACCURACY))
        x = _number(held[0].column)
        sketches.append(F.percentile_approx(F.when(held[0].inside(x), x), marks, ACCURACY))
    proposed = df.agg(*sketches).first()
    trials = []
    for held, values in zip(groups.values(), proposed):
        trials += [(t, values[2 * i], values[2 * i + 1]) for i, t in enumerate(held)]
    counts = []
    for t, a, b in trials:
        x = _number(t.column)
        counts += [F.count_if(x < F.lit(a)), F.count_if(x.between(a, b))]
    row = df.agg(*counts).first()
    for i, (t, a, b) in enumerate(trials):
        below, size = row[2 * i], row[2 * i + 1]
        if below <= t.low_rank and t.high_rank < below + size and size < t.size:
            t.low, t.high, t.below, t.size = a, b, below, size
        else:
            t.size = -1


def quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], exact: bool = True
) -> dict[str, list[float | None]]:
    """Quantiles of whole columns, as numbers.

    A column of few distinct values takes the built-in percentile. Others are
    found by narrowing: a sketch gives a bracket around each
    wanted rank, a scan counts it, and this repeats until the bracket holds few
    enough values to read. Each pass is one aggregation with a tiny result, so
    nothing is sorted or shuffled. A bracket that cannot shrink (many copies of
    few values) is settled by a distributed ranking of the value counts.
    """
    cols = list(dict.fromkeys(cols))
    if not cols:
        return {}
    if not exact:
        row = df.agg(
            *[F.percentile_approx(_number(c), list(probs), ACCURACY) for c in cols]
        ).first()
        return {c: list(row[i]) if row[i] else [None] * len(probs) for i, c in enumerate(cols)}
    df = df.select(*[col(c) for c in cols])
    few = limit_of(df.sparkSession, "bracketRows", BRACKET_ROWS)
    facts = df.agg(
        *[F.count(_number(c)) for c in cols], *[F.approx_count_distinct(_number(c)) for c in cols]
    ).first()
    found: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    # The built-in percentile holds one count per distinct value.
    plain = [c for c, values in zip(cols, facts[len(cols) :]) if 0 < values <= few]
    if plain:
        marks = F.array(*[F.lit(float(p)) for p in probs])
        row = df.agg(*[F.percentile(_number(c), marks) for c in plain]).first()
        found.update({c: list(q) for c, q in zip(plain, row)})
    every: list[tuple[int, _Target]] = []
    for c, n in zip(cols, facts):
        for i, p in enumerate(probs if c not in plain else ()):
            if n:
                at = p * (n - 1)
                every.append((i, _Target(c, p, math.floor(at), math.ceil(at), n, n)))
    while True:
        wide = [t for _, t in every if t.size > few and (t.low is None or t.low < t.high)]
        if not wide:
            break
        _narrow(df, wide)
    stuck = [(i, t) for i, t in every if t.size < 0]
    easy = [(i, t) for i, t in every if t.size >= 0 and t.low is not None and t.low == t.high]
    for i, t in easy:
        found[t.column][i] = t.low
    rest = [(i, t) for i, t in every if t.size >= 0 and not (t.low is not None and t.low == t.high)]
    if rest:
        cells = {}
        for _, t in rest:
            x = _number(t.column)
            cells[(t.column, t.low, t.high)] = F.sort_array(F.collect_list(F.when(t.inside(x), x)))
        row = dict(zip(cells, df.agg(*cells.values()).first()))
        for i, t in rest:
            held = row[(t.column, t.low, t.high)]
            found[t.column][i] = t.value(
                held[t.low_rank - t.below], held[t.high_rank - t.below]
            )
    for c in dict.fromkeys(t.column for _, t in stuck):
        mine = [(i, t) for i, t in stuck if t.column == c]
        clean = df.select(_number(c).alias("v"))
        got = _ranked(clean, (), "v", [t.prob for _, t in mine]).first()["q"]
        for (i, _), v in zip(mine, got):
            found[c][i] = v
    return found


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    exact: bool = True,
    name: str = "q",
) -> DataFrame:
    """Per group an array of quantiles, exact at any group size."""
    keys = [col(b) for b in by]
    marks = F.array(*[F.lit(float(p)) for p in probs])
    if not exact:
        return df.groupBy(*keys).agg(
            F.percentile_approx(col(value).cast("double"), list(probs), 10_000).alias(name)
        )
    bound = limit_of(df.sparkSession, "percentileDistinct", PERCENTILE_DISTINCT)
    most = (
        df.groupBy(*keys)
        .agg(F.approx_count_distinct(col(value)).alias("_d"))
        .agg(F.max("_d"))
        .first()[0]
    )
    if (most or 0) <= bound:
        return df.groupBy(*keys).agg(
            F.percentile(col(value).cast("double"), marks).alias(name)
        )
    got = _ranked(df.select(*keys, col(value)), by, value, probs).withColumnRenamed("q", name)
    # Groups whose values are all NULL have no rank; keep them with NULLs.
    empty = (
        df.groupBy(*keys)
        .agg(F.count(col(value)).alias("_n"))
        .filter("_n = 0")
        .select(*keys, F.array(*[F.lit(None).cast("double") for _ in probs]).alias(name))
    )
    return got.unionByName(empty)

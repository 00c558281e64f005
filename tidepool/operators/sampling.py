"""Heads, samples, splits and folds. Chance comes from hashes of a row key,
so results do not depend on partitions and survive recomputation."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.columns import col, require
from tidepool.operators.lookup import attach
from tidepool.session import WINDOW_GROUP_ROWS, checkpoint, limit_of

_STEPS = 1 << 30
# Bits of a hash below each level of ranges.
_SHIFTS = (52, 40, 28, 16, 4, 0)


def row_hash(keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*[col(k) for k in keys], F.lit(seed))


def uniform(keys: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) per row key."""
    return F.pmod(row_hash(keys, seed), F.lit(_STEPS)) / F.lit(float(_STEPS))


def head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*[col(o) for o in order_by]).limit(n)


def tail(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The last ``n`` rows, in order."""
    last = df.orderBy(*[F.desc(o) for o in order_by]).limit(n)
    return last.orderBy(*[col(o) for o in order_by])


def random_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, chosen by hash."""
    return df.orderBy(row_hash(keys, seed), *[col(k) for k in keys]).limit(n)


def top(df: DataFrame, by: str, k: int, tiebreak: Sequence[str]) -> DataFrame:
    """The ``k`` rows with the largest ``by``."""
    return df.orderBy(F.desc_nulls_last(by), *[col(t) for t in tiebreak]).limit(k)


def split(
    df: DataFrame, keys: Sequence[str], test_size: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test): disjoint, complete, and stable under repartitioning."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
    require(df, keys)
    is_test = uniform(keys, seed) < F.lit(test_size)
    return df.filter(~is_test), df.filter(is_test)


def _class_parts(
    df: DataFrame, label: str, keys: Sequence[str], seed: int, starts: Callable[[Column], list[Column]]
) -> DataFrame:
    """Add ``_part``: how many of the ranks ``starts(rows of the class)`` are not
    above the row's own 0-based rank by hash within its class.

    Whole rows are neither sorted nor written. The hash of each wanted rank is
    found by counting ranges of hashes, each level within the ranges that the
    one before it left, until one range of a class fits a window; then rows are
    compared with the few hashes of their class. ``keys`` must be unique.
    """
    tag = F.struct(col(label).isNull().alias("n"), col(label).alias("v"))
    place = F.struct(row_hash(keys, seed).alias("h"), *[col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    bound = limit_of(df.sparkSession, "windowGroupRows", WINDOW_GROUP_ROWS)
    rows = df.select(tag.alias("_tag"), place.alias("_key"), F.lit(0).cast("long").alias("_in"))
    sizes = targets = None
    for shift in _SHIFTS:
        rows = rows.withColumn("_at", F.shiftright(F.col("_key.h"), shift))
        within = Window.partitionBy("_tag", "_in").orderBy("_at")
        counts = rows.groupBy("_tag", "_in", "_at").agg(F.count(F.lit(1)).alias("_n"))
        counts = checkpoint(counts.withColumn("_before", F.sum("_n").over(within) - F.col("_n")))
        if targets is None:
            sizes = checkpoint(counts.groupBy("_tag").agg(F.sum("_n").alias("_rows")))
            ranks = F.array(*[r.cast("long") for r in starts(F.col("_rows"))])
            targets = sizes.select("_tag", F.lit(0).cast("long").alias("_in"), F.posexplode(ranks).alias("_j", "_rank"))
        inside = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
        targets = checkpoint(
            targets.drop("_n").join(counts, ["_tag", "_in"])
            .filter(inside)
            .select("_tag", F.col("_at").alias("_in"), "_j", (F.col("_rank") - F.col("_before")).alias("_rank"), "_n")
        )
        wanted = targets.groupBy("_tag", "_in").agg(F.max("_n").alias("_n"))
        left = rows.select("_tag", "_key", F.col("_at").alias("_in"))
        left = attach(left, wanted, ["_tag", "_in"], rows="_n").filter(F.col("_n").isNotNull())
        rows = checkpoint(left.select("_tag", "_key", "_in"))
        if (targets.agg(F.max("_n")).first()[0] or 0) <= bound:
            break
    within = Window.partitionBy("_tag", "_in").orderBy("_key")
    placed = rows.withColumn("_rank", (F.row_number().over(within) - 1).cast("long"))
    cuts = targets.join(placed, ["_tag", "_in", "_rank"]).groupBy("_tag").agg(F.collect_list("_key").alias("_cuts"))
    table = sizes.join(cuts, "_tag", "left")
    out = attach(df.withColumn("_tag", tag), table, ["_tag"], rows="_rows")
    below = F.size(F.filter(F.col("_cuts"), lambda cut: cut <= place))
    return out.withColumn("_part", F.greatest(F.coalesce(below, F.lit(0)), F.lit(0))).drop("_tag", "_rows", "_cuts")


def stratified_split(
    df: DataFrame, label: str, keys: Sequence[str], test_size: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the same share of every class, to the row."""
    require(df, [label, *keys])
    parts = _class_parts(df, label, keys, seed, lambda n: [F.round(n * F.lit(test_size))])
    is_test = F.col("_part") == 0
    return parts.filter(~is_test).drop("_part"), parts.filter(is_test).drop("_part")


def folds(
    df: DataFrame,
    k: int,
    keys: Sequence[str],
    seed: int = 42,
    label: str | None = None,
    name: str = "fold",
) -> DataFrame:
    """Add a fold number 0..k−1. With ``label`` each class is dealt out evenly."""
    if k < 2:
        raise ValueError("At least two folds")
    if label is None:
        return df.withColumn(name, F.pmod(row_hash(keys, seed), F.lit(k)).cast("int"))
    # The first (rows mod k) folds of a class hold one row more.
    starts = lambda n: [F.floor(n / k) * j + F.least(F.pmod(n, F.lit(k)), F.lit(j)) for j in range(1, k)]
    parts = _class_parts(df, label, keys, seed, starts)
    return parts.withColumn(name, F.col("_part").cast("int")).drop("_part")


def bootstrap(
    df: DataFrame,
    keys: Sequence[str],
    fraction: float = 1.0,
    replace: bool = True,
    seed: int = 42,
) -> DataFrame:
    """One sample of about ``fraction`` of the rows.

    With replacement a row is repeated a Poisson number of times, the limit of
    drawing rows one by one from a large table.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    u = uniform(keys, seed)
    if not replace:
        return df if fraction == 1.0 else df.filter(u < F.lit(fraction))
    times, term, below, i = F.lit(0), math.exp(-fraction), 0.0, 0
    while below + term < 1 - 1 / _STEPS:  # to the last step that a hash can tell apart
        below, i = below + term, i + 1
        term *= fraction / i
        times = times + (u >= F.lit(below)).cast("int")
    copies = F.explode(F.array_repeat(F.lit(True), times))
    return df.withColumn("_copy", copies).drop("_copy")

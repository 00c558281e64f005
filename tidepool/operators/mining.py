"""Itemsets, association rules, sequences and co-occurrence."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.columns import classify, col, require
from tidepool.operators.lookup import attach
from tidepool.operators.ordering import (
    ordered_shift,
    running_totals,
    shift_positions,
    with_position,
)
from tidepool.session import checkpoint, shuffle_partitions

METRICS = ("support", "confidence", "lift", "leverage", "conviction")
MAX_RULE_LENGTH = 10
# Items per tile of a co-occurrence count: a tile's counts fit in one task.
TILE = 2_048
# A context of so many values lists its pairs.
FEW = 256
# Items per array of a whole basket.
CHUNK_ITEMS = 10_000


def pairs(df: DataFrame, transaction: str, item: str) -> DataFrame:
    """Distinct (tx, item). Repeats are merged before the shuffle."""
    require(df, [transaction, item])
    return (
        df.filter(col(transaction).isNotNull() & col(item).isNotNull())
        .select(col(transaction).alias("tx"), col(item).cast("string").alias("item"))
        .distinct()
    )


def onehot_pairs(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(tx, item) from wide columns: non-zero or true means present."""
    require(df, [key, *cols])
    present = [
        F.when(F.coalesce(col(c).cast("double") != 0, F.lit(False)), F.lit(c)) for c in cols
    ]
    return df.select(
        col(key).alias("tx"), F.explode(F.array_compact(F.array(*present))).alias("item")
    )


def frequent_items(found: DataFrame, min_count: int) -> DataFrame:
    return (
        found.groupBy("item")
        .agg(F.count(F.lit(1)).alias("count"))
        .filter(F.col("count") >= min_count)
    )


def baskets(found: DataFrame, min_count: int) -> DataFrame:
    """One sorted array of items per transaction, of items in ``min_count``
    transactions or more.

    At most (pairs / min_count) items can be that frequent, which bounds both
    the table that is looked up and the longest basket, however hot a
    transaction is. ``basket_chunks`` keeps the rare items too.
    """
    kept = attach(found, frequent_items(found, min_count), ["item"], rows="count")
    kept = kept.filter(F.col("count").isNotNull())
    return kept.groupBy("tx").agg(F.array_sort(F.collect_set("item")).alias("items"))


def basket_chunks(found: DataFrame, size: int = CHUNK_ITEMS) -> DataFrame:
    """Whole baskets, rare items too: (tx, chunk, chunks, items), arrays sorted.

    A transaction of at most ``size`` items is one row, chunk 0 of 1. A larger
    one is dealt by hash of the item to chunks of about ``size`` items, so its
    items are gathered by many tasks. ``found`` is (tx, item) without repeats.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    counts = found.groupBy("tx").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > size)
    held = attach(found, counts, ["tx"], rows="_n")
    chunks = F.coalesce(F.ceil(F.col("_n") / size), F.lit(1)).cast("int")
    held = held.select("tx", "item", chunks.alias("chunks"))
    chunk = F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int")
    dealt = held.groupBy("tx", chunk.alias("chunk"), "chunks")
    return dealt.agg(F.array_sort(F.collect_list("item")).alias("items"))


def least_count(min_support: float, n: int) -> int:
    """Fewest transactions that reach a support; safe from rounding."""
    guess = max(1, math.floor(min_support * n) - 1)
    while guess / n < min_support:
        guess += 1
    return guess


def frequent_itemsets(
    found: DataFrame, min_support: float, transactions: int | None = None
) -> DataFrame:
    """Table (items, length, count, support) of every frequent itemset.

    ``transactions`` is the number of all transactions, where some may be
    empty; by default those that hold an item.
    """
    if not 0 < min_support <= 1:
        raise ValueError("min_support must be in (0, 1]")
    found = checkpoint(found)
    n = transactions
    if n is None:
        n = found.select(F.countDistinct("tx")).first()[0]
    if not n:
        return found.sparkSession.createDataFrame(
            [], "items array<string>, length int, count long, support double"
        )
    least = least_count(min_support, n)
    kept = checkpoint(baskets(found, least))
    held = kept.count()
    if not held:
        return found.sparkSession.createDataFrame(
            [], "items array<string>, length int, count long, support double"
        )
    # Half a transaction below the bound, so that rounding cannot lift it.
    miner = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / held, minConfidence=1.0)
    sets = miner.fit(kept).freqItemsets
    return sets.select(
        F.array_sort("items").alias("items"),
        F.size("items").alias("length"),
        F.col("freq").alias("count"),
        (F.col("freq") / F.lit(float(n))).alias("support"),
    )


def itemset_report(itemsets: DataFrame) -> DataFrame:
    """Total, mean support, greatest length and single items."""
    return itemsets.agg(
        F.count(F.lit(1)).alias("itemsets"),
        F.avg("support").alias("mean_support"),
        F.max("length").alias("max_length"),
        F.count_if(F.col("length") == 1).alias("single_items"),
    )


def itemset_table(itemsets: DataFrame) -> DataFrame:
    """Readable itemsets, best supported first."""
    return itemsets.select(
        F.array_join("items", ", ").alias("items"), "length", "support"
    ).orderBy(F.desc("support"), "length", "items")


def association_rules(
    itemsets: DataFrame,
    metric: str = "confidence",
    min_threshold: float = 0.5,
    max_len: int = 3,
) -> DataFrame:
    """All rules antecedent → consequent of itemsets up to ``max_len`` items.

    Each itemset is split in every way; an itemset of L items has 2^L − 2
    splits, so ``max_len`` is at most 10.
    """
    if metric not in METRICS:
        raise ValueError(f"Unknown metric '{metric}'")
    if not 2 <= max_len <= MAX_RULE_LENGTH:
        raise ValueError(f"max_len must be 2 to {MAX_RULE_LENGTH}")
    sets = checkpoint(itemsets.filter(F.col("length") <= max_len).select("items", "support"))
    splits = F.expr(
        "transform(sequence(1, shiftleft(1, size(items)) - 2), "
        "m -> filter(items, (x, i) -> (m & shiftleft(1, i)) != 0))"
    )
    ways = sets.filter(F.size("items") > 1).select(
        "items", "support", F.explode(splits).alias("antecedent")
    )
    ways = ways.withColumn("consequent", F.array_except("items", "antecedent")).drop("items")

    def side(name: str) -> DataFrame:
        return sets.select(
            F.col("items").alias(name), F.col("support").alias(f"{name}_support")
        )

    rules = ways.join(side("antecedent"), "antecedent").join(side("consequent"), "consequent")
    a, c, s = F.col("antecedent_support"), F.col("consequent_support"), F.col("support")
    rules = rules.withColumns(
        {
            "confidence": s / a,
            "lift": s / a / c,
            "leverage": s - a * c,
            "conviction": F.when(s >= a, F.lit(float("inf"))).otherwise(
                (1 - c) / F.nullif(1 - s / a, F.lit(0.0))
            ),
        }
    )
    return rules.filter(F.col(metric) >= min_threshold).select(
        "antecedent", "consequent", "antecedent_support", "consequent_support", *METRICS
    )


def _by_lift(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("lift"), "antecedent", "consequent")


def rule_report(rules: DataFrame) -> DataFrame:
    """Number of rules, mean confidence and lift, and rules that lift."""
    return rules.agg(
        F.count(F.lit(1)).alias("rules"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg("lift").alias("mean_lift"),
        F.count_if(F.col("lift") > 1).alias("lifting_rules"),
    )


def top_rules(rules: DataFrame, n: int = 10) -> DataFrame:
    """The strongest rules as text, with the direction of the association."""
    direction = (
        F.when(F.col("lift") > 1, F.lit("positive"))
        .when(F.col("lift") < 1, F.lit("negative"))
        .otherwise(F.lit("none"))
    )
    return _by_lift(rules).limit(n).select(
        F.array_join("antecedent", ", ").alias("antecedent"),
        F.array_join("consequent", ", ").alias("consequent"),
        "support",
        "confidence",
        "lift",
        direction.alias("direction"),
    )


def rule_edges(rules: DataFrame, n: int = 20) -> DataFrame:
    """Edge list of the strongest rules."""
    return _by_lift(rules).limit(n).select(
        F.array_join("antecedent", ", ").alias("source"),
        F.array_join("consequent", ", ").alias("target"),
        F.col("lift").alias("weight"),
    )


def edge_counts(edges: DataFrame) -> DataFrame:
    """Nodes and edges of an edge list."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.agg(
        F.countDistinct("node").alias("nodes"), (F.count(F.lit(1)) / 2).cast("long").alias("edges")
    )


def _timestamped(df: DataFrame, when: str) -> DataFrame:
    if when in classify(df)["text"]:
        return df.withColumn(when, col(when).cast("timestamp_ntz"))
    return df


def sequences(
    df: DataFrame,
    key: str,
    when: str,
    event: str,
    tiebreak: Sequence[str | Column],
    max_gap_hours: float | None = None,
) -> DataFrame:
    """(key, sequence, place, when, event, events): events in order, for
    sequences of at least two. A gap over ``max_gap_hours`` starts a new one.

    Sequences are found along one global order, so a hot key is no single task.
    """
    df = _timestamped(df, when)
    rows = df.filter(col(key).isNotNull()).select(
        col(key), col(when), col(event), *[t for t in tiebreak if t not in (key, when, event)]
    )
    placed = with_position(rows, [key, when, *tiebreak])
    placed = shift_positions(
        placed, [("_key", F.struct(col(key)), 1), ("_when", col(when), 1)]
    )
    starts = ~F.col("_key").eqNullSafe(F.struct(col(key)))
    if max_gap_hours is not None:
        gap = F.timestamp_diff("SECOND", F.col("_when"), col(when))
        starts = starts | (gap > F.lit(max_gap_hours * 3600))
    flag = F.coalesce(starts, F.lit(True)).cast("long")
    placed = running_totals(placed.withColumn("_flag", flag), {"_before": F.col("_flag")})
    placed = placed.withColumn("sequence", F.col("_before") + F.col("_flag"))
    sizes = placed.groupBy("sequence").agg(
        F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("events")
    )
    return (
        attach(placed, sizes, ["sequence"], rows="events")
        .filter(F.col("events") >= 2)
        .select(
            col(key),
            "sequence",
            (F.col("_pos") - F.col("_start")).alias("place"),
            col(when),
            col(event),
            "events",
        )
    )


def sequential_patterns(
    df: DataFrame,
    key: str,
    when: str,
    event: str,
    tiebreak: Sequence[str | Column],
    min_length: int = 2,
    max_length: int = 3,
    min_count: int = 2,
) -> DataFrame:
    """(pattern, length, count): contiguous runs of events, every occurrence.

    A run is read by looking ahead along the order; no sequence is collected.
    """
    if not 1 <= min_length <= max_length:
        raise ValueError("Lengths must satisfy 1 <= min <= max")
    df = _timestamped(df, when)
    extra = [t for t in tiebreak if isinstance(t, str) and t not in (key, when, event)]
    rows = df.filter(col(key).isNotNull() & col(event).isNotNull()).select(
        col(key), col(when), col(event).cast("string").alias("_e0"), *extra
    )
    ahead = [(f"_e{i}", F.col("_e0"), -i) for i in range(1, max_length)]
    if ahead:
        rows = ordered_shift(rows, ahead, [when, *tiebreak], [key])
    runs = [
        F.when(
            F.col(f"_e{n - 1}").isNotNull(), F.array(*[F.col(f"_e{i}") for i in range(n)])
        )
        for n in range(min_length, max_length + 1)
    ]
    return (
        rows.select(F.explode(F.array_compact(F.array(*runs))).alias("pattern"))
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("count"))
        .filter(F.col("count") >= min_count)
        .select("pattern", F.size("pattern").alias("length"), "count")
    )


def pattern_table(patterns: DataFrame) -> DataFrame:
    """Readable patterns, most frequent first."""
    return patterns.select(
        F.array_join("pattern", " → ").alias("pattern"), "length", "count"
    ).orderBy(F.desc("count"), "pattern")


def pattern_lengths(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("length").agg(F.count(F.lit(1)).alias("patterns"))


def cooccurrence(
    df: DataFrame, a: str, b: str, min_count: int = 1, top: int | None = None
) -> DataFrame:
    """Counts of value pairs across two columns."""
    require(df, [a, b])
    if a == b:
        raise ValueError("Use shared_context for pairs within one column")
    got = (
        df.filter(col(a).isNotNull() & col(b).isNotNull())
        .groupBy(col(a).alias("item1"), col(b).alias("item2"))
        .agg(F.count(F.lit(1)).alias("count"))
        .filter(F.col("count") >= min_count)
    )
    return got.orderBy(F.desc("count"), "item1", "item2").limit(top) if top else got


def shared_context(
    df: DataFrame, context: str, item: str, min_count: int = 2, top: int | None = None
) -> DataFrame:
    """(item1, item2, count): in how many contexts two values occur together.

    Values too rare to reach ``min_count`` go first, the rest are numbered. A
    context of up to ``FEW`` values is one row; tasks list its pairs, add up
    equal ones and send the sums. Values of larger contexts are cut into tiles
    of ``TILE`` codes, so such a context is a row per tile it has values of,
    however hot it is. Its rows meet in pairs of tiles, dealt to tasks by tiles
    and a salt; a task multiplies the incidence matrices of one pair of tiles
    after the other and sends only sums. The plan does not depend on the number
    of values.
    """
    found = checkpoint(pairs(df, context, item))
    codes = checkpoint(with_position(frequent_items(found, min_count), ["item"], "code"))
    coded = attach(found, codes, ["item"], rows="count").filter(F.col("code").isNotNull()).select("tx", "code")
    large = checkpoint(coded.groupBy("tx").agg(F.count(F.lit(1)).alias("_values")).filter(F.col("_values") > FEW))
    few, parts = coded, None
    if large.take(1):
        sized = attach(coded, large, ["tx"], rows="_values")
        few = sized.filter(F.col("_values").isNull())
        parts = _tiled(sized.filter(F.col("_values").isNotNull()), shuffle_partitions(df.sparkSession))
    lists = few.groupBy("tx").agg(F.array_sort(F.collect_list("code")).alias("codes")).filter(F.size("codes") > 1)
    listed = lists.select("codes").mapInPandas(_listed_counts, "a long, b long, n long")
    parts = listed if parts is None else parts.unionByName(listed)
    sums = parts.groupBy("a", "b").agg(F.sum("n").alias("count")).filter(F.col("count") >= min_count)
    first = codes.select(F.col("code").alias("a"), F.col("item").alias("item1"))
    second = codes.select(F.col("code").alias("b"), F.col("item").alias("item2"))
    named = sums.join(first, "a").join(second, "b").select("item1", "item2", "count")
    return named.orderBy(F.desc("count"), "item1", "item2").limit(top) if top else named


def _listed_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pair counts of contexts with few values, some contexts at a time."""
    for batch in batches:
        sizes = batch["codes"].map(len).to_numpy()
        ends = np.cumsum(sizes * (sizes - 1) // 2)
        starts = np.flatnonzero(np.diff(ends // CHUNK_PAIRS, prepend=0))
        for some in np.split(np.arange(len(batch)), starts):
            if not len(some):
                continue
            n = sizes[some]
            flat = np.concatenate(batch["codes"].iloc[some].to_list())
            at = np.arange(len(flat))
            after = np.repeat(np.cumsum(n), n) - at - 1  # values behind each one in its context
            left = np.repeat(at, after)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
            pair, count = np.unique(flat[left] * np.int64(2**31) + flat[right], return_counts=True)
            yield pd.DataFrame({"a": pair >> 31, "b": pair & (2**31 - 1), "n": count})


def _tiled(coded: DataFrame, n: int) -> DataFrame:
    """Pair counts (a, b, n) of contexts of any size, in parts."""
    tile = TILE
    coded = coded.withColumn("tile", F.floor(F.col("code") / tile).cast("long"))
    held = checkpoint(
        coded.groupBy("tx", "tile").agg(
            F.array_sort(F.collect_list((F.col("code") - F.col("tile") * tile).cast("int"))).alias("codes")
        )
    )
    other = held.select("tx", F.col("tile").alias("tile2"), F.col("codes").alias("codes2"))
    # A context in a single tile meets only itself, without a join.
    met = held.join(other.filter(F.col("tile2") > 0), "tx").filter(F.col("tile") < F.col("tile2"))
    same = held.select("*", F.col("tile").alias("tile2"), F.col("codes").alias("codes2"))
    met = met.unionByName(same).withColumn("salt", F.pmod(F.xxhash64("tx"), F.lit(n)))
    met = met.repartition(n, "tile", "tile2", "salt").sortWithinPartitions("tile", "tile2")
    return met.select("tile", "tile2", "codes", "codes2").mapInPandas(_tile_counts(tile), "a long, b long, n long")


# Rows with more pairs than this multiply as a dense matrix, others pair by pair.
DENSE_PAIRS = 8_192
# Contexts and pairs handled at once.
CHUNK_ROWS, CHUNK_PAIRS = 1_000, 4_000_000


def _add_products(total: np.ndarray, x: list[np.ndarray], y: list[np.ndarray]) -> None:
    """Add the pair counts of contexts with codes ``x`` and ``y`` to ``total``."""
    nx, ny = np.array([len(c) for c in x]), np.array([len(c) for c in y])
    if (nx * ny).sum() > DENSE_PAIRS * len(x):
        wide = []
        for lists, n in ((x, nx), (y, ny)):
            m = np.zeros((len(lists), total.shape[0]), dtype=np.float32)
            m[np.repeat(np.arange(len(lists)), n), np.concatenate(lists)] = 1.0
            wide.append(m)
        total += (wide[0].T @ wide[1]).astype(np.int64)
        return
    left, right = np.concatenate(x), np.concatenate(y)
    times = np.repeat(ny, nx)  # each left code meets all right codes of its context
    starts = np.repeat(np.repeat(np.cumsum(ny) - ny, nx), times)
    inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    np.add.at(total, (np.repeat(left, times), right[starts + inside]), 1)


def _tile_counts(tile: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pair counts of rows sorted by pair of tiles: one matrix at a time."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, np.zeros((tile, tile), dtype=np.int64)

        def sums() -> pd.DataFrame:
            a, b = np.nonzero(np.triu(total, 1) if at[0] == at[1] else total)
            return pd.DataFrame({"a": a + at[0] * tile, "b": b + at[1] * tile, "n": total[a, b]})

        for batch in batches:
            for key, rows in batch.groupby(["tile", "tile2"], sort=True):
                if at is not None and key != at:
                    yield sums()
                    total[:] = 0
                at = key
                x, y = list(rows["codes"]), list(rows["codes2"])
                s = 0
                while s < len(x):
                    e, pairs_held = s, 0
                    while e < len(x) and e - s < CHUNK_ROWS and (e == s or pairs_held < CHUNK_PAIRS):
                        pairs_held += len(x[e]) * len(y[e])
                        e += 1
                    _add_products(total, x[s:e], y[s:e])
                    s = e
        if at is not None:
            yield sums()

    return count

"""Links between items that meet in buckets, at a cost near the number of rows.

Items (texts, sets) meet in buckets, and a check tells whether two of them are
similar. Comparing all pairs of a bucket costs the square of its size, so:

- Round after round, each item is checked against one item only: the one that
  comes first, in an order of its own for each round, in most of its buckets.
  Links make components, and items of one component never meet again. A group
  of thousands of near copies is done in a few rounds.
- When few of the checks link, all pairs of a bucket that are still in different
  components are looked at, by numbers alone: sizes, places, and the parity of
  the elements by hash, whose distance is at most that of the elements. This is
  done once; only the pairs that could be similar are kept, and a block of a
  bucket that has more than FEW of them for each row gives the nearest ones and
  is looked at again later. If the pairs are many, each item is checked with the
  nearest of the others first, again while that links many, so components at
  least halve. Then all that are left between components are checked. None is
  left out.

Only keys and numbers are moved here; the check brings in texts or sets, once
for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import storage
from tidepool.llm import words as W

# Least and most bits of the parity of an item, a power of two near SPREAD times its elements.
SMALL_BITS, LARGE_BITS, SPREAD = 1024, 16384, 4
# Members of a block of a bucket; buckets of at most PACK members are compared many at a time, about PACKED rows.
BLOCK, PACK, PACKED = 1024, 32, 512
# Pairs for each row of a block that are kept at once.
FEW = 8
# Bands of sizes that similar items are at most apart.
BANDS = 2
# Edges joined in a task at a time.
EDGES = 1 << 19
# Rounds go on while one check in so many links, and those of nearest items while one in NEAREST does.
WORTH, NEAREST = 4, 2


def parities(of: np.ndarray, x: np.ndarray, n: int) -> pa.Array:
    """For each of ``n`` items the parity of its elements' hashes; ``of`` tells the item of each element, in order."""
    size = np.bincount(of, minlength=n)
    edge = W.bounds(size)[:-1]
    bits = np.clip(2 ** np.ceil(np.log2(np.maximum(SPREAD * size, 1))), SMALL_BITS, LARGE_BITS).astype(np.int64)
    out = np.empty(n, object)
    for wide in np.unique(bits).tolist():
        items = np.flatnonzero(bits == wide)
        step = (512 * SMALL_BITS) // wide
        for lo in range(0, len(items), step):
            some = items[lo : lo + step]
            low = (x[W.spread(edge[some], size[some])] & W.U(wide - 1)).astype(np.int64)
            cell = np.repeat(np.arange(len(some)) * wide, size[some]) + low
            odd = np.bincount(cell, minlength=len(some) * wide) & 1
            packed = np.packbits(odd.astype(np.uint8).reshape(-1, wide), axis=1, bitorder="little")
            for i, own in zip(some.tolist(), packed):
                out[i] = own.tobytes()
    return pa.array(out, pa.binary())


Most = Callable[[np.ndarray, np.ndarray], np.ndarray]
Near = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _folded(whole: list[np.ndarray], wide: int) -> np.ndarray:
    """Parities as rows of ``wide`` bits; narrower ones become rows of zeros."""
    words = wide // 64
    none = np.zeros(words, W.U)
    return np.stack([np.bitwise_xor.reduce(b.reshape(-1, words), axis=0) if len(b) >= words else none for b in whole])


def _earlier(cell: pa.Table) -> np.ndarray | None:
    """For each row of a cell a set, as bits, of its item's buckets before its own; those of one row are left out."""
    if "buckets" not in cell.column_names:
        return None
    lists, own = cell["buckets"].combine_chunks(), np.asarray(cell["bucket"].combine_chunks())
    value, row = np.asarray(lists.flatten()), np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    first = value < own[row]
    row, value = row[first], value[first]
    _, bit, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = count > 1
    row, bit = row[shared[bit]], (np.cumsum(shared) - 1)[bit[shared[bit]]]
    out = np.zeros((len(lists), -(-int(shared.sum()) // 64)), W.U)
    np.bitwise_or.at(out, (row, bit >> 6), W.U(1) << (bit & 63).astype(W.U))
    return out


def _met(before: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the items p and q have an earlier bucket in common, too."""
    out = np.zeros(len(p), bool)
    step = max(1, (1 << 20) // max(1, before.shape[1]))
    for lo in range(0, len(p), step):
        out[lo : lo + step] = (before[p[lo : lo + step]] & before[q[lo : lo + step]]).any(axis=1)
    return out


def _nearest(p: np.ndarray, q: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which pairs are the best of one of their items."""
    chosen = np.zeros(len(p), bool)
    for side in (p, q):
        order = np.lexsort((apart, side))
        chosen[order[np.flatnonzero(np.diff(side[order], prepend=-1))]] = True
    return chosen


def _pairs(cell: pa.Table, near: Near, most: Most, few: int) -> pa.Table:
    """Pairs of a bucket that differ in component and may be similar, with their distance by parity.

    Those of side 0 with side 1 if the cell has two. Pairs that meet in an earlier bucket are left to it, if the
    rows tell these. If there are more than ``few`` for each row, only the best pair of each item, with the bucket,
    as the sign that there are more; the cell has one bucket then. With 0 or if it has several, all pairs.
    """
    names = ("key", "n", "place", "class", "side", "bucket")
    key, n, place, of, side, bucket = (np.asarray(cell[c].combine_chunks()) for c in names)
    several = (bucket != bucket[0]).any()
    whole = [np.frombuffer(b, W.U) for b in cell["bits"].to_pylist()]
    width = np.array([len(b) * 64 for b in whole])
    small = _folded(whole, SMALL_BITS)
    folded: dict[int, np.ndarray] = {}
    before = _earlier(cell)
    two = side.any()
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if two else left
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo in range(0, len(left), 256):
        i, j = left[lo : lo + 256][:, None], right[None]
        ok = (of[i] != of[j]) & near(n[i], n[j], place[i], place[j])
        if not two:
            ok &= i < j
        if several:
            ok &= bucket[i] == bucket[j]
        a, b = np.nonzero(ok)
        a, b = i[a, 0], j[0, b]
        for at in range(0, len(a), 1 << 16):
            p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            limit = most(n[p], n[q])
            apart = np.bitwise_count(small[p] ^ small[q]).sum(axis=1, dtype=np.int64)
            both = np.where(apart <= limit, np.minimum(width[p], width[q]), 0)
            for wide in np.unique(both[both > SMALL_BITS]).tolist():
                if wide not in folded:
                    folded[wide] = _folded(whole, wide)
                rows, some = folded[wide], np.flatnonzero(both == wide)
                for k in range(0, len(some), 4096):
                    at_once = some[k : k + 4096]
                    apart[at_once] = np.bitwise_count(rows[p[at_once]] ^ rows[q[at_once]]).sum(axis=1, dtype=np.int64)
            keep = np.flatnonzero(apart <= limit)
            if before is not None:
                keep = keep[~_met(before, p[keep], q[keep])]
            out.append((p[keep], q[keep], apart[keep]))
    a, b, apart = (np.concatenate([o[k] for o in out]) for k in range(3))
    more = bool(few) and not several and len(a) > few * len(key)
    if more:
        chosen = _nearest(a, b, apart)
        a, b, apart = a[chosen], b[chosen], apart[chosen]
    sign = pa.array(bucket[a]) if more else pa.nulls(len(a), pa.int64())
    return pa.table({"key": np.maximum(key[a], key[b]), "rep": np.minimum(key[a], key[b]), "apart": apart, "more": sign})


def _mixed(members: DataFrame, percent: int) -> DataFrame:
    """The rows of (bucket, key, n, place, class) whose bucket has another class that is near in size.

    Sizes within ``percent`` of each other are at most BANDS bands apart. Only one row for each band of a
    bucket and its neighbours is dealt, so a large bucket is counted in many tasks.
    """
    wide = math.log(100 / percent) / BANDS * (1 + 1e-9)
    members = members.withColumn("band", F.floor(F.log(F.greatest("n", F.lit(1))) / wide).cast("int"))
    bands = members.groupBy("bucket", "band").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    around = F.explode(F.sequence(F.col("band") - BANDS, F.col("band") + BANDS)).alias("band")
    near = bands.select("bucket", around, "low", "high").groupBy("bucket", "band")
    near = near.agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    return members.join(near.select("bucket", "band"), ["bucket", "band"], "left_semi").drop("band")


def rest(
    members: DataFrame, marks: DataFrame, percent: int, near: Near, most: Most, few: int = 0, once: bool = False
) -> tuple[DataFrame, list[DataFrame]]:
    """(key, rep, apart, more): pairs of a bucket in different components that may be similar; and the tables behind them.

    All pairs; with ``few``, a block of a bucket that has more than so many for each row gives the nearest of each
    item only, and ``more`` is its bucket. ``apart`` is the distance by parity. With ``once``, a pair is made only in
    the least bucket that has both; each row then takes along its item's other buckets, so there should be few.

    members: (bucket, key, n, place, class); marks: (key, bits). Sizes of similar
    items are within ``percent`` of each other. Buckets of at most PACK members are
    compared whole, many in one cell. Others are cut into blocks; a component larger
    than a block has blocks of its own, which do not meet each other.
    """
    total = members.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("m"))
    total = storage.written(total.withColumn("own", F.when(F.col("m") > BLOCK, F.col("class"))))
    tables = [total]
    whole = total.groupBy("bucket").agg(
        F.sum("m").alias("all"), F.sum(F.when(F.col("own").isNull(), F.col("m")).otherwise(0)).alias("rest")
    )
    small = whole.where(F.col("all") <= PACK)
    packs = (small.agg(F.sum("all")).first()[0] or 0) // PACKED + 1
    packed = members.join(small.select("bucket"), "bucket").withColumn("cell", F.pmod(F.xxhash64("bucket"), F.lit(packs)))
    packed = packed.select("cell", "bucket", F.lit(0).alias("side"), "key", "n", "place", "class")
    total = total.join(whole.where(F.col("all") > PACK), "bucket")
    size = F.when(F.col("own").isNull(), F.col("rest")).otherwise(F.col("m"))
    parts = total.select("bucket", "class", "own", F.ceil(size / BLOCK).alias("parts"))
    rows = members.join(parts, ["bucket", "class"]).withColumn("part", F.pmod(F.xxhash64("key"), "parts"))
    rows = storage.written(rows.withColumn("block", F.xxhash64("own", F.col("own").isNull(), "part")))
    blocks = storage.written(rows.groupBy("bucket", "own", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")))
    tables += [rows, blocks]
    a = blocks.select("bucket", *(F.col(c).alias(f"{c}_a") for c in ("own", "block", "low", "high")))
    b = blocks.select("bucket", *(F.col(c).alias(f"{c}_b") for c in ("own", "block", "low", "high")))
    fits = f"100 * high_a >= {percent} * low_b and 100 * high_b >= {percent} * low_a"
    cells = a.join(b, "bucket").where(f"block_a <= block_b and (own_a is null or own_b is null or own_a <> own_b) and {fits}")
    cells = cells.withColumn("cell", F.xxhash64("bucket", "block_a", "block_b"))
    dealt = cells.select("bucket", F.col("block_a").alias("block"), "cell", F.lit(0).alias("side")).unionByName(
        cells.where("block_a <> block_b").select("bucket", F.col("block_b").alias("block"), "cell", F.lit(1).alias("side"))
    )
    met = rows.join(dealt, ["bucket", "block"]).select("cell", "bucket", "side", "key", "n", "place", "class")
    met = met.withColumn("packed", F.lit(False)).unionByName(packed.withColumn("packed", F.lit(True)))
    if once:
        marks = marks.join(members.groupBy("key").agg(F.collect_list("bucket").alias("buckets")), "key")
    met = met.join(marks, "key")

    def pairs(cell: pa.Table) -> pa.Table:
        return _pairs(cell, near, most, 0 if cell["packed"][0].as_py() else few)

    return met.groupBy("packed", "cell").applyInArrow(pairs, "key long, rep long, apart long, more long"), tables


def _nearest_of_each(pairs: DataFrame) -> DataFrame:
    """(key, rep): of pairs (key, rep, apart), one for each item: that of least distance."""
    both = pairs.select("key", "rep", "apart").unionByName(pairs.select(F.col("rep").alias("key"), F.col("key").alias("rep"), "apart"))
    best = both.groupBy("key").agg(F.min_by("rep", F.struct("apart", "rep")).alias("rep"))
    return best.select(F.greatest("key", "rep").alias("key"), F.least("key", "rep").alias("rep")).distinct()


def linked(
    members: DataFrame, marks: DataFrame, check: Callable[[DataFrame], DataFrame], percent: int, near: Near, most: Most,
    once: bool = False,
) -> DataFrame:
    """(key, rep): links that were checked, enough of them to connect each component.

    members: (bucket, key, n, place, weight), several to a bucket; marks: (key,
    bits), see ``parities``. ``check`` takes pairs (key, rep) and returns a
    written table (key, rep, similar), which may lack pairs that cannot be.
    ``once`` as for ``rest``. Pairs by numbers that are no more than those of the
    greatest round are checked at once.
    """
    checked = found = roots = None
    number, before, easy = 0, [], 0

    def classed(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("class", F.col("key"))
        return rows.join(roots, "key", "left").withColumn("class", F.coalesce("root", "key")).drop("root")

    while True:
        now = classed(members)
        first = now.groupBy("bucket").agg(
            F.min("class").alias("low"), F.max("class").alias("high"),
            F.min(F.struct(F.xxhash64("key", F.lit(number)).alias("h"), "key", "class")).alias("first"),
        ).where("low < high")
        now = now.join(first.select("bucket", F.col("first.key").alias("rep"), F.col("first.class").alias("of")), "bucket")
        now = storage.written(now)
        storage.discard(*before)
        before = [now]
        asks = now.where("class <> of").groupBy("key", "rep").agg(F.sum("weight").alias("w"))
        asks = asks.groupBy("key").agg(F.max_by("rep", F.struct("w", "rep")).alias("rep"))
        if checked is not None:
            asks = asks.join(checked.select("key", "rep"), ["key", "rep"], "left_anti")
        done = check(asks)
        storage.forget(done)
        asked, good = done.agg(F.count(F.lit(1)), F.count_if("similar")).first()
        easy = max(easy, asked)
        checked = done if checked is None else checked.unionByName(done)
        found = checked.where("similar").select("key", "rep")
        if good:
            known = components(found.select(F.col("key").alias("a"), F.col("rep").alias("b")))
            roots = storage.written(known.withColumnRenamed("node", "key"))
        number += 1
        if good * WORTH < asked or not asked:
            break

    def unknown(pairs: DataFrame) -> DataFrame:
        """Those of distinct pairs (key, rep, apart) that were not checked and are between components."""
        both = checked.select(F.greatest("key", "rep").alias("key"), F.least("key", "rep").alias("rep")).distinct()
        pairs = classed(pairs.join(both, ["key", "rep"], "left_anti")).withColumnRenamed("class", "of")
        pairs = classed(pairs.withColumnsRenamed({"key": "other", "rep": "key"})).where("class <> of")
        return pairs.select(F.col("other").alias("key"), F.col("key").alias("rep"), "apart")

    members, waiting, old, last = now.select("bucket", "key", "n", "place"), None, [], False
    while True:
        # Pairs of all buckets; later of those that had too many to keep, and at last all of these.
        if members is not None:
            now = storage.written(_mixed(classed(members), percent) if waiting is None else classed(members))
            storage.discard(*before)
            pairs, tables = rest(now, marks, percent, near, most, few=0 if last else FEW, once=once)
            pairs = storage.written(pairs)
            storage.discard(*tables)
            before = [now, pairs]
            again = pairs.where("more is not null").select(F.col("more").alias("bucket")).distinct()
            members = None if again.isEmpty() else now.drop("class").join(again, "bucket", "left_semi")
            pairs = pairs.groupBy("key", "rep").agg(F.min("apart").alias("apart"))
            waiting = pairs if waiting is None else waiting.unionByName(pairs).dropDuplicates(["key", "rep"])
        waiting = storage.written(unknown(waiting))
        storage.discard(*old)
        old = [waiting]
        if members is None and (last or waiting.count() <= easy):
            break
        asks = storage.written(_nearest_of_each(waiting))
        old.append(asks)
        done = check(asks)
        storage.forget(done)
        asked, good = done.agg(F.count(F.lit(1)), F.count_if("similar")).first()
        checked = checked.unionByName(done)
        found = checked.where("similar").select("key", "rep")
        if good:
            known = components(found.select(F.col("key").alias("a"), F.col("rep").alias("b")))
            roots = storage.written(known.withColumnRenamed("node", "key"))
        waiting = waiting.join(asks, ["key", "rep"], "left_anti")
        last = good * NEAREST < asked or not asked
    more = check(waiting.select("key", "rep"))
    storage.discard(*old, *before)
    return found.unionByName(more.where("similar").select("key", "rep"))


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each node of some edges at a time, and the least of its component among them."""

    def star(edges: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([np.asarray(e.column(i)) for e in edges]) for i in range(2)]
        node, at = np.unique(np.concatenate(ends), return_inverse=True)
        a, b = np.split(at, 2)
        least = np.arange(len(node))
        while (least[a] != least[b]).any():
            np.minimum.at(least, np.maximum(least[a], least[b]), np.minimum(least[a], least[b]))
            while (least[least] != least).any():
                least = least[least]
        own = np.flatnonzero(least != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[least[own]])], ["a", "b"])

    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= EDGES:
            yield star(waiting)
            waiting, rows = [], 0
    if waiting:
        yield star(waiting)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component of undirected edges (a, b).

    Tasks of at most EDGES edges first join those that they read. Unless one
    task held them all, stars of larger and of smaller neighbours then alternate
    until each node has one edge, to a node that has none to a smaller one; each
    round is written to the shared folder, and only a count reaches the driver.
    """

    def unfinished(e: DataFrame) -> bool:
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return ends.where("up + down > 1 and up > 0").count() > 0

    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    tasks = -(-now.count() // EDGES)
    now = storage.written(now.coalesce(max(tasks, 1)).mapInArrow(_stars, "a long, b long"))
    while tasks > 1 and unfinished(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = storage.written(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        old, now = now, storage.written(small.where("a <> b").distinct())
        storage.discard(old, large)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def without_copies(postings: DataFrame) -> DataFrame:
    """(bucket, weight): of buckets with the same members, the first by place, and how many they are.

    postings: (bucket, key, place). Buckets of one member are left out.
    """
    shared = postings.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", "key")).alias("y"),
        F.min(F.struct("key", "place")).alias("first"),
    )
    alike = shared.where("m > 1").groupBy("m", "x", "y")
    alike = alike.agg(F.min(F.struct("first.place", "bucket")).alias("b"), F.count(F.lit(1)).alias("weight"))
    return alike.select(F.col("b.bucket").alias("bucket"), "weight")

"""Global row order without a single-partition window.

Rows are range-partitioned by a unique order, numbered inside each partition,
and the numbering is materialised once. Positions are dense, so everything
after works on equal blocks of positions, however skewed the keys are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.columns import col
from tidepool.session import WINDOW_GROUP_ROWS, checkpoint, limit_of, shuffle_partitions

BLOCK = 200_000


def _order(order: Sequence[str | Column]) -> list[Column]:
    return [col(o) if isinstance(o, str) else o for o in order]


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "_pos") -> DataFrame:
    """Add the 0-based position of each row under a unique ``order``.

    One range shuffle and one checkpoint. The position of a row is its
    partition's offset plus its index inside the sorted partition.
    """
    keys = _order(order)
    n = shuffle_partitions(df.sparkSession)
    placed = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    placed = checkpoint(placed)
    # The id holds the partition number above bit 33 and the row index below.
    placed = placed.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_idx", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = placed.groupBy("_pid").agg((F.max("_idx") + 1).alias("size")).collect()
    offsets, total = [], 0
    for pid, size in sorted(sizes):
        offsets.append((pid, total))
        total += size
    # One row per partition.
    table = df.sparkSession.createDataFrame(offsets, "_pid long, _off long")
    return (
        placed.join(F.broadcast(table), "_pid")
        .withColumn(name, F.col("_off") + F.col("_idx"))
        .drop("_mid", "_pid", "_idx", "_off")
    )


def shift_positions(
    df: DataFrame,
    shifts: Sequence[tuple[str, Column, int]],
    keys: Sequence[str] = (),
    pos: str = "_pos",
    block: int = BLOCK,
) -> DataFrame:
    """Add ``(name, value, k)`` columns: ``value`` of the row ``k`` places before.

    Negative ``k`` looks ahead. With ``keys`` a value is taken only from a row
    with the same keys. Each block also gets the few edge rows it needs from
    its neighbours, so a shift never crosses into a missing row.
    """
    back = max([k for _, _, k in shifts if k > 0], default=0)
    ahead = max([-k for _, _, k in shifts if k < 0], default=0)
    size = max(block, back + ahead + 1)
    own = F.floor(F.col(pos) / size).cast("long")
    off = F.pmod(F.col(pos), F.lit(size))
    homes = [own]
    if back:
        homes.append(F.when(off >= size - back, own + 1))
    if ahead:
        homes.append(F.when(off < ahead, own - 1))
    spread = df.withColumn("_blk", F.explode(F.array_compact(F.array(*homes))))
    w = Window.partitionBy("_blk").orderBy(pos)
    out = {}
    for name, value, k in shifts:
        moved = F.lag(value, k).over(w) if k > 0 else F.lead(value, -k).over(w)
        if k == 0:
            moved = value
        for key in keys:
            there = F.lag(col(key), k).over(w) if k > 0 else F.lead(col(key), -k).over(w)
            if k:
                # Outside the data the row itself is missing, so value is too.
                moved = F.when(there.eqNullSafe(col(key)), moved)
        out[name] = moved
    return spread.withColumns(out).filter(F.col("_blk") == own).drop("_blk")


def running_totals(
    df: DataFrame, values: dict[str, Column], pos: str = "_pos", block: int = BLOCK
) -> DataFrame:
    """Add, per name, the sum of a whole-number value over all earlier positions.

    Sums within a block of positions come from a window; the sums of all
    earlier blocks come from the same function over one row per block, so no
    table of blocks ever reaches the driver.
    """
    names = list(values)
    df = df.withColumn("_blk", F.floor(F.col(pos) / block).cast("long")).withColumns(
        {f"_v{i}": F.coalesce(values[n].cast("long"), F.lit(0)) for i, n in enumerate(names)}
    )
    w = Window.partitionBy("_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumns(
        {f"_s{i}": F.coalesce(F.sum(f"_v{i}").over(w), F.lit(0)) for i in range(len(names))}
    )
    last = df.agg(F.max("_blk")).first()[0]
    if last:
        sums = [F.sum(f"_v{i}").alias(f"_b{i}") for i in range(len(names))]
        blocks = checkpoint(df.groupBy(F.col("_blk").alias("_at")).agg(*sums))
        earlier = {f"_before_{n}": F.col(f"_b{i}") for i, n in enumerate(names)}
        starts = running_totals(blocks, earlier, "_at", block).withColumnRenamed("_at", "_blk")
        inside = inside.join(starts.select("_blk", *earlier), "_blk")
        inside = inside.withColumns({n: F.col(f"_before_{n}") + F.col(f"_s{i}") for i, n in enumerate(names)})
        inside = inside.drop(*earlier)
    else:
        inside = inside.withColumns({n: F.col(f"_s{i}") for i, n in enumerate(names)})
    return inside.drop("_blk", *[f"_{k}{i}" for k in "vs" for i in range(len(names))])


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key; a partial count, so a hot key shuffles little."""
    row = df.groupBy(*[col(k) for k in keys]).count().agg(F.max("count")).first()
    return row[0] or 0


def window_is_safe(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether one task can hold the largest key's rows of a window."""
    if not keys:
        return False
    bound = limit_of(df.sparkSession, "windowGroupRows", WINDOW_GROUP_ROWS)
    return largest_group(df, keys) <= bound


def ordered_shift(
    df: DataFrame,
    shifts: Sequence[tuple[str, Column, int]],
    order: Sequence[str | Column],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Shift values along ``order`` (unique within ``keys``).

    Keys whose groups are small enough use a plain window. A missing or hot
    key goes through global positions, where no task gets a whole key.
    """
    if window_is_safe(df, keys):
        w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*_order(order))
        out = {}
        for name, value, k in shifts:
            if k == 0:
                out[name] = value
            else:
                out[name] = F.lag(value, k).over(w) if k > 0 else F.lead(value, -k).over(w)
        return df.withColumns(out)
    placed = with_position(df, [*keys, *order])
    return shift_positions(placed, shifts, keys).drop("_pos")

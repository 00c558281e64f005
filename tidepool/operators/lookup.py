"""Attaching a per-key table to rows, safe for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.columns import col, require
from tidepool.session import BROADCAST_BYTES, checkpoint, fits_broadcast, limit_of, measure

# At most this many keys can each hold more than 1/HOT_SHARE of the rows.
HOT_SHARE = 1_000
# Copies of a hot key too wide to be broadcast, each joined with a part of its rows.
SALTS = 64


def attach(
    df: DataFrame, table: DataFrame, keys: Sequence[str], rows: str | None = None
) -> DataFrame:
    """Left-join a table with one row per key; NULL keys find nothing.

    ``table`` is materialised and measured. A small one is broadcast. Beyond
    that, the hot keys (known from the column ``rows``, the row count per key)
    are few and still broadcast, if their measured values allow it, and only
    the rest is shuffled. Wide values of hot keys are shuffled in ``SALTS``
    copies. NULL keys are set aside, since a shuffle would send them all to one
    task.
    """
    keys = list(keys)
    require(df, keys)
    table = checkpoint(table)
    values = table.drop(rows) if rows and rows in df.columns else table
    if fits_broadcast(table):
        return df.join(F.broadcast(values), keys, "left")
    missing = F.lit(False)
    for k in keys:
        missing = missing | col(k).isNull()
    nothing = df.filter(missing)
    for field in values.schema.fields:
        if field.name not in keys:
            nothing = nothing.withColumn(field.name, F.lit(None).cast(field.dataType))
    df = df.filter(~missing)
    if rows is None:
        return df.join(values, keys, "left").unionByName(nothing)
    total = table.agg(F.sum(rows)).first()[0] or 0
    is_hot = col(rows) > total / HOT_SHARE
    hot = table.filter(is_hot)
    hot = hot.drop(rows) if rows in df.columns else hot
    cold = table.filter(~is_hot)
    cold = cold.drop(rows) if rows in df.columns else cold
    named = hot.select(*keys)
    bound = limit_of(df.sparkSession, "broadcastBytes", BROADCAST_BYTES)
    if measure(named)[1] > bound:  # keys of many kilobytes each: adaptive execution splits them
        return df.join(values, keys, "left").unionByName(nothing)
    if measure(hot)[1] <= bound:
        on_hot = df.join(F.broadcast(hot), keys, "inner")
    else:
        dealt = df.join(F.broadcast(named), keys, "left_semi")
        dealt = dealt.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        copies = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on_hot = dealt.join(copies, [*keys, "_salt"], "inner").drop("_salt")
    rest = df.join(F.broadcast(named), keys, "left_anti").join(cold, keys, "left")
    return on_hot.unionByName(rest).unionByName(nothing)

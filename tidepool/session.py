"""Session helpers: durable cut points and size limits.

The limits below are the only places where data may be collected or broadcast.
Each has another, fully distributed way beyond it.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup table is broadcast up to these sizes, and shuffled beyond them.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Built-in exact percentile buffers distinct values; used up to this many.
PERCENTILE_DISTINCT = 1_000_000
# A per-key window sorts one key's rows in one task; used up to this many.
WINDOW_GROUP_ROWS = 1_000_000
# A cached table is read by about one task per this many rows.
ROWS_PER_TASK = 25_000


def limit_of(spark: SparkSession, name: str, default: int) -> int:
    """A size limit, which a session may override as ``tidepool.<name>``."""
    return int(spark.conf.get(f"tidepool.{name}", str(default)))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session
    that names none gets a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="tidepool-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def in_parallel(spark: SparkSession, jobs: Sequence[Callable[[], Any]], most: int = 4) -> list[Any]:
    """Run independent jobs from a few driver threads, results in order.

    One small fit cannot keep a cluster busy; several at once do. The session
    may set ``tidepool.parallelism``.
    """
    most = min(limit_of(spark, "parallelism", most), len(jobs))
    if most < 2:
        return [job() for job in jobs]
    with ThreadPool(most) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs, chunksize=1)


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a table for several passes, in no more tasks than its rows need.

    A small table left in many shuffle partitions would make every pass of a
    fit pay for starting nearly empty tasks.
    """
    held = df.persist()
    try:
        tasks = max(1, math.ceil(held.count() / ROWS_PER_TASK))
        yield held.coalesce(tasks) if tasks < held.rdd.getNumPartitions() else held
    finally:
        held.unpersist()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _width(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(field.dataType, T.ArrayType):
        inner = field.dataType.elementType
        if isinstance(inner, T.StringType):
            return F.coalesce(F.octet_length(F.array_join(c, ",")), F.lit(0)).cast("long")
        if isinstance(inner, (T.ArrayType, T.StructType, T.MapType, T.BinaryType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)).cast("long")
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long") * 8
    if isinstance(field.dataType, (T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)).cast("long")
    return F.lit(8).cast("long")


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a materialised table."""
    width = sum((_width(f) for f in df.schema.fields), F.lit(0).cast("long"))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return row["n"], row["b"] or 0


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a materialised table is within the broadcast bounds."""
    spark = df.sparkSession
    rows, size = measure(df)
    return rows <= limit_of(spark, "broadcastRows", BROADCAST_ROWS) and size <= limit_of(
        spark, "broadcastBytes", BROADCAST_BYTES
    )

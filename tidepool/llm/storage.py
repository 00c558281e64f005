"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidepool import session


def folder(spark: SparkSession) -> str:
    """A new path in ``spark.checkpoint.dir``; a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.getCheckpointDir() is None:
            session.checkpoint(spark.range(1))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/tidepool-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned and that nothing will read again."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Let Spark delete shuffle files of finished writes now: it does when the driver's memory is next collected."""
    df.sparkSession.sparkContext._jvm.System.gc()

"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.ordering import with_position

_ENCODINGS = {"utf-8": "UTF-8", "utf-16": "UTF-16", "latin1": "ISO-8859-1"}


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType | str | None = None,
    encoding: str = "utf-8",
    line_breaks: bool = True,
) -> DataFrame:
    """CSV with a header. Give a schema where it is known: inference reads twice.

    Quoted cells may hold line breaks, so each file is read by one task; write
    many files, as ``write_csv`` does. Files without such cells are split if
    ``line_breaks`` is False. UTF-16 files are never split, as their lines
    cannot be found without decoding.
    """
    reader = spark.read.options(
        header=True, encoding=_ENCODINGS[encoding], escape='"', multiLine=line_breaks or encoding == "utf-16"
    )
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(paths if isinstance(paths, str) else list(paths))


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def write_csv(
    df: DataFrame,
    path: str,
    order_by: Sequence[str | Column] | None = None,
    row_number: str | None = None,
    encoding: str = "utf-8",
    mode: str = "overwrite",
) -> None:
    """CSV with a header, one file per partition. Quoted cells keep their line breaks and spaces.

    ``row_number`` names an extra first column 0, 1, 2, … along ``order_by``,
    which must then be a unique order.
    """
    if encoding not in _ENCODINGS:
        raise ValueError(f"Unknown encoding '{encoding}'")
    if row_number is not None:
        if not order_by:
            raise ValueError("Row numbers need a unique order_by")
        names = df.columns
        df = with_position(df, order_by, row_number).select(row_number, *names)
    elif order_by:
        df = df.orderBy(*order_by)
    df.write.mode(mode).options(
        header=True, encoding=_ENCODINGS[encoding], escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write any result table. CSV holds arrays as text joined by ``, ``."""
    if fmt == "csv":
        flat = [
            F.array_join(F.col(f"`{f.name}`").cast("array<string>"), ", ").alias(f.name)
            if isinstance(f.dataType, T.ArrayType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
        write_csv(df.select(*flat), path, mode=mode)
    elif fmt in ("parquet", "json", "orc"):
        df.write.mode(mode).format(fmt).save(path)
    else:
        raise ValueError(f"Unknown result format '{fmt}'")


def check_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Return ``df`` if it has every feature; name the missing ones otherwise."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"Missing required features: {', '.join(missing)}")
    return df

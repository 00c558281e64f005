"""Column classes and argument checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def kind_of(data_type: T.DataType) -> str:
    """``numeric``, ``text``, ``datetime``, ``boolean`` or ``other``."""
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(data_type, _DATETIME):
        return "datetime"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "other"


def classify(df: DataFrame) -> dict[str, list[str]]:
    """Column names by class, in schema order; ``all`` holds every name."""
    groups: dict[str, list[str]] = {
        k: [] for k in ("numeric", "text", "datetime", "boolean", "other")
    }
    for field in df.schema.fields:
        groups[kind_of(field.dataType)].append(field.name)
    groups["all"] = list(df.columns)
    return groups


def require(df: DataFrame, names: Iterable[str], kind: str | None = None) -> None:
    """Raise ``ValueError`` for unknown columns or columns of another class."""
    for name in names:
        if name not in df.columns:
            raise ValueError(f"Column '{name}' not found")
        found = kind_of(df.schema[name].dataType)
        if kind is not None and found != kind:
            raise ValueError(f"Column '{name}' must be {kind}, but is {found}")


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_name(data_type: T.DataType) -> str:
    return data_type.simpleString()

"""Predicates over columns. All values become literals, never SQL text."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.columns import col, kind_of


def one_of(name: str, values: Sequence[Any]) -> Column:
    """The value is among ``values``; ``None`` among them selects NULL."""
    present = [v for v in values if v is not None]
    test = F.coalesce(col(name).isin(present), F.lit(False)) if present else F.lit(False)
    if len(present) < len(values):
        test = test | col(name).isNull()
    elif present:
        test = col(name).isin(present)
    return test


def text_contains(name: str, pattern: str, literal: bool = False) -> Column:
    """Case-insensitive search by regular expression, or by plain text."""
    if literal:
        hit = F.contains(F.lower(col(name)), F.lit(pattern.lower()))
    else:
        hit = col(name).rlike("(?i)" + pattern)
    return F.coalesce(hit, F.lit(False))


def in_range(name: str, low: float, high: float) -> Column:
    if low > high:
        raise ValueError(f"Minimum {low} is above maximum {high}")
    return col(name).between(low, high)


def in_dates(name: str, first: dt.date, last: dt.date) -> Column:
    """Inclusive range on the date part."""
    return F.to_date(col(name)).between(F.lit(first), F.lit(last))


class Condition(NamedTuple):
    """One line of the condition builder; ``link`` joins it to the next line."""

    column: str
    op: str
    value: Any
    link: str = "and"


# The comparisons offered per column class.
NUMERIC_OPS = (">", "<", ">=", "<=", "==", "!=")
TEXT_OPS = ("==", "!=", "contains")
OTHER_OPS = ("==", "!=")
MAX_CONDITIONS = 5


def _one(cond: Condition, schema: T.StructType) -> Column:
    if cond.column not in schema.names:
        raise ValueError(f"Column '{cond.column}' not found")
    kind = kind_of(schema[cond.column].dataType)
    allowed = {"numeric": NUMERIC_OPS, "text": TEXT_OPS}.get(kind, OTHER_OPS)
    if cond.op not in allowed:
        raise ValueError(f"Operator '{cond.op}' is not available for {kind} columns")
    c, v = col(cond.column), F.lit(cond.value)
    if cond.op == "contains":
        return text_contains(cond.column, str(cond.value))
    if cond.op == "==":
        return c == v
    if cond.op == "!=":
        # A missing value differs from every value.
        return ~c.eqNullSafe(v)
    return {">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[cond.op]


def build(conditions: Sequence[Condition | tuple], schema: T.StructType) -> Column:
    """Combine up to five conditions; ``and`` binds tighter than ``or``.

    A text condition with an empty value is skipped together with its link.
    """
    conds = [c if isinstance(c, Condition) else Condition(*c) for c in conditions]
    if len(conds) > MAX_CONDITIONS:
        raise ValueError(f"At most {MAX_CONDITIONS} conditions")
    conds = [c for c in conds if c.value != ""]
    groups: list[list[Column]] = [[]]
    for cond in conds:
        if cond.link not in ("and", "or"):
            raise ValueError(f"Unknown link '{cond.link}'")
        groups[-1].append(_one(cond, schema))
        if cond.link == "or":
            groups.append([])
    groups = [g for g in groups if g]
    if not groups:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, g) for g in groups])

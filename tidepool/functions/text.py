"""Text features. A missing text counts as empty."""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_letters, ascii_uppercase, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.columns import col, require

# The blanks of the pattern \\s without Unicode.
BLANKS = " \t\n\x0b\f\r"

# The column suffix of each feature.
SUFFIXES = {
    "length": "length",
    "word_count": "word_count",
    "char_count": "char_count",
    "uppercase_count": "uppercase_count",
    "digit_count": "digit_count",
    "special_char_count": "special_chars",
}


def feature(name: str, kind: str, unicode: bool = False) -> Column:
    """One count over a text column. ``unicode`` widens ``\\d`` and ``\\s``."""
    text = F.coalesce(col(name), F.lit(""))
    flag = "(?U)" if unicode else ""
    if kind == "length":
        return F.length(text)
    if kind == "char_count":
        return F.length(F.replace(text, F.lit(" "), F.lit("")))
    if kind == "word_count":
        # One letter is left of each word with the blanks around it.
        words = F.length(F.regexp_replace(text, flag + r"\s*\S+\s*", "x"))
        return F.when(text.rlike(flag + r"\S"), words).otherwise(F.lit(0))
    if kind == "uppercase_count":
        return F.length(text) - F.length(F.translate(text, ascii_uppercase, ""))
    if kind == "digit_count" and not unicode:
        return F.length(text) - F.length(F.translate(text, digits, ""))
    if kind == "special_char_count" and not unicode:
        return F.length(F.translate(text, ascii_letters + digits + BLANKS, ""))
    # Unicode classes are too large to list: what is left after removing the others.
    others = {"digit_count": r"\D+", "special_char_count": r"[a-zA-Z0-9\s]+"}
    if kind not in others:
        raise ValueError(f"Unknown text feature '{kind}'")
    return F.length(F.regexp_replace(text, flag + others[kind], ""))


def add_features(
    df: DataFrame, name: str, kinds: Sequence[str] = tuple(SUFFIXES), unicode: bool = False
) -> DataFrame:
    require(df, [name], "text")
    return df.withColumns(
        {f"{name}_{SUFFIXES[k]}": feature(name, k, unicode).cast("long") for k in kinds}
    )


def concat(
    df: DataFrame,
    a: str,
    b: str,
    sep: str = "_",
    name: str | None = None,
    null_token: str = "nan",
) -> DataFrame:
    """Join two columns as text; a missing value becomes ``null_token``."""
    require(df, [a, b])
    parts = [F.coalesce(col(c).cast("string"), F.lit(null_token)) for c in (a, b)]
    return df.withColumn(name or f"{a}_concat_{b}", F.concat_ws(sep, *parts))

"""Joins of two named datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.columns import col, kind_of, require

HOW = ("inner", "left", "right", "outer")


def repair_keys(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str
) -> tuple[DataFrame, DataFrame]:
    """Give both keys one type: text if either is text, double for mixed numbers."""
    require(left, [left_on])
    require(right, [right_on])
    lt, rt = left.schema[left_on].dataType, right.schema[right_on].dataType
    if lt == rt:
        return left, right
    kinds = {kind_of(lt), kind_of(rt)}
    if "text" in kinds:
        target = "string"
    elif kinds == {"numeric"}:
        whole = all(isinstance(t, T.IntegralType) for t in (lt, rt))
        target = "bigint" if whole else "double"
    else:
        return left, right
    return (
        left.withColumn(left_on, col(left_on).cast(target)),
        right.withColumn(right_on, col(right_on).cast(target)),
    )


def join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    how: str = "inner",
    null_keys_match: bool = True,
    fix_types: bool = True,
) -> DataFrame:
    """Equi-join on one key each.

    NULL keys match each other unless told otherwise. One key column remains
    if both have the same name; any other clashing name gets ``_left`` or
    ``_right``. An outer join is a left join plus the right rows without a
    partner: unlike a full join, both of these let Spark split a skewed key.
    """
    if how not in HOW:
        raise ValueError(f"Unknown join type '{how}'")
    if fix_types:
        left, right = repair_keys(left, right, left_on, right_on)
    else:
        require(left, [left_on])
        require(right, [right_on])
    same = left_on == right_on
    shared = (set(left.columns) & set(right.columns)) - ({left_on} if same else set())
    lnames = {c: c + "_left" if c in shared else c for c in left.columns}
    rnames = {c: c + "_right" if c in shared else c for c in right.columns}
    l = left.select(*[col(c).alias(n) for c, n in lnames.items()])
    r = right.select(*[col(c).alias(n) for c, n in rnames.items()])
    lk, rk = lnames[left_on], rnames[right_on]
    if same:
        r = r.withColumnRenamed(rk, "_rkey")
        rk = "_rkey"

    def on(a: DataFrame, b: DataFrame, ak: str = lk, bk: str = rk):
        x, y = a["`" + ak + "`"], b["`" + bk + "`"]
        return x.eqNullSafe(y) if null_keys_match else x == y

    names = [c for c in l.columns] + [c for c in r.columns if c != "_rkey"]
    joined = l.join(r, on(l, r), "left" if how == "outer" else how)
    if same:
        key = col(rk) if how == "right" else col(lk)
        joined = joined.withColumn(lk, key)
    joined = joined.select(*[col(c) for c in names])
    if how != "outer":
        return joined
    keys = l.select(col(lk).alias("_lkey")).distinct()
    lonely = r.join(keys, on(r, keys, rk, "_lkey"), "left_anti")
    types = {f.name: f.dataType for f in l.schema.fields}
    cells = []
    for c in names:
        if same and c == lk:
            cells.append(col(rk).alias(c))
        elif c in types:
            cells.append(F.lit(None).cast(types[c]).alias(c))
        else:
            cells.append(col(c))
    return joined.unionByName(lonely.select(*cells))


def join_report(left: DataFrame, right: DataFrame, result: DataFrame) -> DataFrame:
    """Result rows, columns, and rows relative to the larger input."""

    def rows(df: DataFrame, side: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))

    parts = rows(left, "left").unionByName(rows(right, "right")).unionByName(rows(result, "result"))
    sizes = parts.agg(
        *[F.max(F.when(F.col("side") == s, F.col("n"))).alias(f"{s}_rows")
          for s in ("left", "right", "result")]
    )
    most = F.greatest("left_rows", "right_rows")
    return sizes.select(
        "left_rows",
        "right_rows",
        "result_rows",
        F.lit(len(result.columns)).cast("long").alias("result_columns"),
        F.when(most > 0, F.round(F.try_divide(F.col("result_rows") * 100.0, most), 2))
        .otherwise(F.lit(0.0))
        .alias("efficiency_pct"),
    )

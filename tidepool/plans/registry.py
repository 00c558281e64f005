"""Registry of queries: name -> (Spark query, equivalent SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where SQL can say the same."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"Query '{name}' is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The test tables hold no NULL. All customers with all their orders supply them:
# what a small order says is not known, and some customers have no order.
UNKNOWN = ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
MISSING_SQL = f"""(select c_custkey, c_acctbal, c_mktsegment, o_orderkey,
                         {", ".join(f"case when o_totalprice > 150000 then {c} end as {c}" for c in UNKNOWN)}
                  from customer left join orders on c_custkey = o_custkey)"""


def with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers with all their orders, NULL where a small order says something."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", *UNKNOWN)
    known = F.col("o_totalprice") > 150000
    o = o.select("o_custkey", "o_orderkey", *[F.when(known, F.col(x)).alias(x) for x in UNKNOWN])
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").drop("o_custkey")

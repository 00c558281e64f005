"""Sources, sinks, filters and joins."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import predicates as P
from tidepool.operators import filters, joins, lookup, numeric, profile
from tidepool.plans.registry import MISSING_SQL, query, table, with_missing
from tidepool.session import checkpoint
from tidepool.sources import files, typing
from tidepool.sources.catalog import Catalog


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, where all executors can write."""
    checkpoint(spark.range(1))
    return os.path.join(spark.sparkContext.getCheckpointDir(), f"out-{uuid.uuid4().hex}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.where(
        table(spark, sf_dir, "lineitem"),
        [("l_quantity", ">", 10), ("l_returnflag", "!=", "N")],
    )
    rows = numeric.arithmetic(rows, "l_extendedprice", "l_discount", "multiply", "saved")
    return rows.groupBy("l_returnflag").agg(
        F.round(F.sum(F.col("saved").cast("decimal(18,4)")).cast("double"), 2).alias("sum_saved"),
        F.round(F.avg("saved"), 4).alias("mean_saved"),
        F.count(F.lit(1)).alias("n"),
    )


query(
    "flagship",
    """select l_returnflag,
              round(cast(sum(cast(l_extendedprice * l_discount as decimal(18,4))) as double), 2) as sum_saved,
              round(avg(l_extendedprice * l_discount), 4) as mean_saved, count(*) as n
       from lineitem where l_quantity > 10 and l_returnflag <> 'N' group by l_returnflag""",
)(flagship)


@query("s1_csv_scan", "select r_regionkey, r_name from region")
def _(spark, d):
    path = scratch(spark)
    files.write_csv(table(spark, d, "region"), path)
    return files.read_csv(spark, path)


@query("s1_csv_texts", "select doc_id, text, lang, source, n_chars from documents")
def _(spark, d):
    path, rows = scratch(spark), table(spark, d, "documents")
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


@query("s1_csv_turns", "select conv_id, turn, role, text from conversations")
def _(spark, d):
    path, rows = scratch(spark), table(spark, d, "conversations")
    files.write_result(rows, path, "csv")
    return files.read_csv(spark, path, rows.schema)


@query("s2_parquet_scan", "select n_nationkey, n_name, n_regionkey from nation")
def _(spark, d):
    return files.read_parquet(spark, f"{d}/nation.parquet")


@query(
    "s3_catalog",
    """select 'Orders' as dataset, count(*) as rows, 6::bigint as columns from orders
       union all select 'Customers', count(*), 5 from customer""",
)
def _(spark, d):
    names = Catalog(spark)
    names.add("Orders", table(spark, d, "orders"))
    names.add("Regions", table(spark, d, "region"))
    names.add("Customers", table(spark, d, "customer"))
    names.remove("Regions")
    return names.listing()


@query("s4_promote_types", "select event_id, ts, user_id, event_type, value from events")
def _(spark, d):
    names = ["event_id", "ts", "user_id", "event_type", "value"]
    text = table(spark, d, "events").select(*[F.col(c).cast("string").alias(c) for c in names])
    return typing.promote_types(text)


@query(
    "s5_nan_to_null",
    "select event_id, case when value < 10 then null else value end as value from events",
)
def _(spark, d):
    broken = F.when(F.col("value") < 10, F.lit(float("nan"))).otherwise(F.col("value"))
    return typing.nan_to_null(table(spark, d, "events").select("event_id", broken.alias("value")))


@query(
    "s6_csv_sink_numbered",
    """select row_number() over (order by c_custkey) - 1 as row_no, c_custkey, c_name, c_acctbal
       from customer""",
)
def _(spark, d):
    path = scratch(spark)
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    files.write_csv(rows, path, order_by=["c_custkey"], row_number="row_no", encoding="latin1")
    schema = "row_no long, c_custkey long, c_name string, c_acctbal double"
    return files.read_csv(spark, path, schema, encoding="latin1")


@query(
    "s7_result_sink",
    """select o_orderstatus, round(avg(o_totalprice), 4) as mean_price
       from orders group by o_orderstatus""",
)
def _(spark, d):
    path = scratch(spark)
    got = profile.group_aggregate(table(spark, d, "orders"), "o_orderstatus", "o_totalprice", "mean")
    got = got.select("o_orderstatus", F.round("mean_o_totalprice", 4).alias("mean_price"))
    files.write_result(got, path, "csv")
    return files.read_csv(spark, path, "o_orderstatus string, mean_price double")


@query(
    "s8_scoring_input",
    "select l_quantity, l_extendedprice, l_discount from lineitem",
)
def _(spark, d):
    features = ["l_quantity", "l_extendedprice", "l_discount"]
    return files.check_features(table(spark, d, "lineitem"), features).select(*features)


@query(
    "f1_value_set",
    f"""select c_custkey, o_orderkey from {MISSING_SQL}
        where o_orderstatus in ('F', 'O') or o_orderstatus is null""",
)
def _(spark, d):
    got = filters.value_set(with_missing(spark, d), "o_orderstatus", ["F", "O", None])
    return got.select("c_custkey", "o_orderkey")


@query(
    "f2_text_search",
    "select p_partkey, p_name from part where regexp_matches(p_name, '(?i)RED|ring$')",
)
def _(spark, d):
    got = filters.text_search(table(spark, d, "part"), "p_name", "RED|ring$")
    return got.select("p_partkey", "p_name")


@query(
    "f2_text_search_literal",
    "select doc_id from documents where contains(lower(text), 'que')",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    return filters.text_search(docs, "text", "que", literal=True).select("doc_id")


@query(
    "f3_numeric_range",
    """select l_orderkey, l_linenumber, l_extendedprice from lineitem
       where l_extendedprice between 20000 and 30000""",
)
def _(spark, d):
    got = filters.numeric_range(table(spark, d, "lineitem"), "l_extendedprice", 20000, 30000)
    return got.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "f3_numeric_bounds",
    """select min(l_quantity) as low, max(l_quantity) as high,
              count(distinct l_quantity) as distinct_values from lineitem""",
)
def _(spark, d):
    return filters.numeric_bounds(table(spark, d, "lineitem"), "l_quantity")


@query(
    "f4_date_range",
    """select event_id from events
       where ts::date between date '2024-01-05' and date '2024-01-10'""",
)
def _(spark, d):
    got = filters.date_range(
        table(spark, d, "events"), "ts", dt.date(2024, 1, 5), dt.date(2024, 1, 10)
    )
    return got.select("event_id")


@query(
    "f5_conjunction",
    """select o_orderkey from orders where o_orderstatus in ('F') and o_totalprice between 1000 and 250000
       and o_orderdate::date between date '1996-01-01' and date '1998-12-31'""",
)
def _(spark, d):
    tests = [
        P.one_of("o_orderstatus", ["F"]),
        P.in_range("o_totalprice", 1000, 250000),
        P.in_dates("o_orderdate", dt.date(1996, 1, 1), dt.date(1998, 12, 31)),
    ]
    return filters.all_of(table(spark, d, "orders"), tests).select("o_orderkey")


@query(
    "f6_condition_builder",
    """select l_orderkey, l_linenumber from lineitem
       where (l_quantity >= 45 and l_returnflag = 'A') or l_discount > 0.08
          or (l_linestatus = 'F' and l_tax <= 0.01)""",
)
def _(spark, d):
    got = filters.where(
        table(spark, d, "lineitem"),
        [
            ("l_quantity", ">=", 45, "and"),
            ("l_returnflag", "==", "A", "or"),
            ("l_discount", ">", 0.08, "or"),
            ("l_linestatus", "==", "F", "and"),
            ("l_tax", "<=", 0.01),
        ],
    )
    return got.select("l_orderkey", "l_linenumber")


@query(
    "f6_condition_contains",
    """select o_orderkey from orders where regexp_matches(o_orderpriority, '(?i)urgent')
       or o_totalprice < 5000""",
)
def _(spark, d):
    got = filters.where(
        table(spark, d, "orders"),
        [
            ("o_orderpriority", "contains", "urgent", "or"),
            ("o_orderstatus", "==", "", "and"),
            ("o_totalprice", "<", 5000),
        ],
    )
    return got.select("o_orderkey")


@query(
    "f7_not_equal_with_missing",
    f"select c_custkey, o_orderkey from {MISSING_SQL} where o_orderstatus is distinct from 'F'",
)
def _(spark, d):
    got = filters.where(with_missing(spark, d), [("o_orderstatus", "!=", "F")])
    return got.select("c_custkey", "o_orderkey")


@query(
    "f8_filter_report",
    """select count(*) as original_rows, count(*) filter (l_quantity > 25 and l_returnflag = 'R') as filtered_rows,
              count(*) - count(*) filter (l_quantity > 25 and l_returnflag = 'R') as rows_removed,
              round((count(*) - count(*) filter (l_quantity > 25 and l_returnflag = 'R')) * 100.0 / count(*), 2)::double as reduction_pct,
              2::bigint as filters, 'quantity above 25; returned' as conditions, 'filtered' as status
       from lineitem""",
)
def _(spark, d):
    tests = [F.col("l_quantity") > 25, F.col("l_returnflag") == "R"]
    return filters.filter_report(
        table(spark, d, "lineitem"), tests, ["quantity above 25", "returned"]
    )


@query(
    "f9_complete_rows",
    f"select c_custkey, o_orderkey from {MISSING_SQL} where o_totalprice is not null",
)
def _(spark, d):
    got = filters.complete_rows(with_missing(spark, d), ["o_totalprice", "o_orderstatus"], 10)
    return got.select("c_custkey", "o_orderkey")


@query(
    "f10_project_head",
    "select s_suppkey, s_acctbal from supplier order by s_suppkey limit 20",
)
def _(spark, d):
    got = filters.project(table(spark, d, "supplier"), ["s_suppkey", "s_acctbal"])
    return got.orderBy("s_suppkey").limit(20)


@query("f11_rename", "select ts as ds, value as y from events")
def _(spark, d):
    got = filters.project(table(spark, d, "events"), ["ts", "value"])
    return filters.rename(filters.rename(got, "ts", "ds"), "value", "y")


@query(
    "j1_inner",
    """select o_orderkey, o_custkey, c_custkey, c_name, c_mktsegment, o_totalprice
       from orders join customer on o_custkey = c_custkey""",
)
def _(spark, d):
    got = joins.join(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey")
    return got.select("o_orderkey", "o_custkey", "c_custkey", "c_name", "c_mktsegment", "o_totalprice")


@query(
    "j1_left",
    """select c_custkey, c_name, o_custkey, o_orderkey, o_totalprice
       from customer left join orders on c_custkey = o_custkey""",
)
def _(spark, d):
    got = joins.join(
        table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", "left"
    )
    return got.select("c_custkey", "c_name", "o_custkey", "o_orderkey", "o_totalprice")


@query(
    "j1_right_same_key",
    """select e.user_id as key, c.c_name as name_left, e.event_type as name_right
       from customer c right join events e on c.c_custkey = e.user_id""",
)
def _(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name")
    )
    e = table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.col("event_type").alias("name")
    )
    return joins.join(c, e, "key", "key", "right")


# Keys are made missing on both sides: missing keys match each other.
@query(
    "j1_outer_null_keys",
    """select coalesce(n.k, c.k) as k, n.n_name, c.c_custkey
       from (select nullif(n_nationkey, 3) as k, n_name from nation) n
       full join (select nullif(c_nationkey, 5) as k, c_custkey from customer) c
       on n.k is not distinct from c.k""",
)
def _(spark, d):
    n = table(spark, d, "nation")
    n = n.select(F.nullif(F.col("n_nationkey"), F.lit(3)).alias("k"), "n_name")
    c = table(spark, d, "customer")
    c = c.select(F.nullif(F.col("c_nationkey"), F.lit(5)).alias("k"), "c_custkey")
    return joins.join(n, c, "k", "k", "outer")


@query(
    "j2_key_repair",
    """select o_orderkey, o_custkey::varchar as o_custkey, c_custkey::varchar as c_custkey, c_acctbal
       from orders join customer on o_custkey = c_custkey""",
)
def _(spark, d):
    o = table(spark, d, "orders").withColumn("o_custkey", F.col("o_custkey").cast("string"))
    got = joins.join(o, table(spark, d, "customer"), "o_custkey", "c_custkey")
    return got.select("o_orderkey", "o_custkey", "c_custkey", "c_acctbal")


@query(
    "j3_join_report",
    """select l as left_rows, r as right_rows, j as result_rows, 8::bigint as result_columns,
              round(j * 100.0 / greatest(l, r), 2)::double as efficiency_pct
       from (select (select count(*) from nation) as l, (select count(*) from customer) as r,
                    (select count(*) from nation join customer on n_nationkey = c_nationkey) as j)""",
)
def _(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    return joins.join_report(n, c, joins.join(n, c, "n_nationkey", "c_nationkey"))


@query(
    "j4_lookup",
    """select o_orderkey, o_custkey, orders_of_customer from orders
       left join (select c_custkey as o_custkey, count(*) as orders_of_customer
                  from customer join orders on c_custkey = o_custkey group by 1) using (o_custkey)""",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer")
    counts = (
        o.join(c, o["o_custkey"] == c["c_custkey"], "left_semi")
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("orders_of_customer"))
    )
    return lookup.attach(o, counts, ["o_custkey"], rows="orders_of_customer")

"""Profiles, chart tables, heads, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import charts, profile, sampling
from tidepool.plans.registry import MISSING_SQL, query, table, with_missing

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _each(template: str, names: list[str]) -> str:
    return " union all ".join(template.replace("{c}", c) for c in names)


def _rounded(df, places: int, *names: str):
    return df.withColumns({n: F.round(n, places) for n in names})


@query(
    "p1_describe",
    _each(
        """select '{c}' as "column", count({c}) as count, round(avg({c}), 5) as mean, round(stddev_samp({c}), 5) as std,
           min({c}) as min, round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50,
           round(quantile_cont({c}, 0.75), 6) as p75, max({c}) as max from lineitem""",
        _NUMBERS,
    ),
)
def _(spark, d):
    got = profile.describe(table(spark, d, "lineitem"), _NUMBERS)
    return _rounded(_rounded(got, 5, "mean", "std"), 6, "p25", "p50", "p75")


@query(
    "p2_extremes",
    _each(
        'select \'{c}\' as "column", max({c})::double as max, min({c})::double as min from part',
        ["p_partkey", "p_size", "p_retailprice"],
    ),
)
def _(spark, d):
    return profile.extremes(table(spark, d, "part"))


@query(
    "p3_group_aggregate",
    """select l_returnflag, round(avg(l_extendedprice), 4) as mean_l_extendedprice,
              round(sum(l_extendedprice), 1) as sum_l_extendedprice,
              count(l_extendedprice) as count_l_extendedprice,
              round(median(l_extendedprice), 6) as median_l_extendedprice,
              round(stddev_samp(l_extendedprice), 4) as std_l_extendedprice,
              min(l_extendedprice) as min_l_extendedprice, max(l_extendedprice) as max_l_extendedprice
       from lineitem group by l_returnflag""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem")
    places = {"mean": 4, "sum": 1, "median": 6, "std": 4}
    got = None
    for m in profile.METRICS:
        part = profile.group_aggregate(rows, "l_returnflag", "l_extendedprice", m)
        name = f"{m}_l_extendedprice"
        if m in places:
            part = _rounded(part, places[m], name)
        got = part if got is None else got.join(part, "l_returnflag")
    return got


@query(
    "p3_group_drops_missing",
    f"""select o_orderstatus, count(c_acctbal) as count_c_acctbal from {MISSING_SQL}
        where o_orderstatus is not null group by 1""",
)
def _(spark, d):
    return profile.group_aggregate(with_missing(spark, d), "o_orderstatus", "c_acctbal", "count")


_MISSING_TYPES = [
    ("c_custkey", "bigint"),
    ("c_acctbal", "double"),
    ("c_mktsegment", "string"),
    ("o_orderkey", "bigint"),
    ("o_orderstatus", "string"),
    ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"),
    ("o_orderpriority", "string"),
]


@query(
    "p4_missing_report",
    " union all ".join(
        f"""select '{c}' as "column", '{t}' as type, count(*) - count({c}) as missing,
            round((count(*) - count({c})) * 100.0 / count(*), 2)::double as missing_pct, count({c}) as non_null
            from {MISSING_SQL}"""
        for c, t in _MISSING_TYPES
    ),
)
def _(spark, d):
    return profile.missing_report(with_missing(spark, d))


@query(
    "p4_missing_total",
    f"""select sum(m)::bigint as missing_cells, round(sum(m) * 100.0 / (8 * max(n)), 2)::double as missing_pct
        from (select count(*) as n, 8 * count(*) - count(c_custkey) - count(c_acctbal) - count(c_mktsegment)
              - count(o_orderkey) - count(o_orderstatus) - count(o_totalprice) - count(o_orderdate)
              - count(o_orderpriority) as m from {MISSING_SQL})""",
)
def _(spark, d):
    return profile.missing_total(with_missing(spark, d))


_PART_TYPES = [
    ("p_partkey", "bigint", "numeric"),
    ("p_name", "string", "text"),
    ("p_brand", "string", "text"),
    ("p_type", "string", "text"),
    ("p_size", "int", "numeric"),
]


@query(
    "p5_type_summary",
    " union all ".join(
        f"""select '{c}' as "column", '{t}' as type, '{k}' as class, count(distinct {c}) as distinct_values,
            arg_min({c}, p_partkey)::varchar as sample from part"""
        for c, t, k in _PART_TYPES
    ),
)
def _(spark, d):
    return profile.type_summary(
        table(spark, d, "part"), "p_partkey", [c for c, _, _ in _PART_TYPES]
    )


@query(
    "p5_type_counts",
    "select 'numeric' as class, 3::bigint as columns union all select 'text', 3",
)
def _(spark, d):
    return profile.type_counts(profile.type_summary(table(spark, d, "part"), "p_partkey"))


@query(
    "p6_distribution",
    _each(
        """select '{c}' as "column", round(avg({c}), 5) as mean, round(median({c}), 6) as median,
           round(stddev_samp({c}), 5) as std, round(skewness({c}), 5) as skewness,
           round(quantile_cont({c}, 0.10), 6) as p10, round(quantile_cont({c}, 0.25), 6) as p25,
           round(quantile_cont({c}, 0.50), 6) as p50, round(quantile_cont({c}, 0.75), 6) as p75,
           round(quantile_cont({c}, 0.90), 6) as p90, round(quantile_cont({c}, 0.95), 6) as p95,
           round(quantile_cont({c}, 0.99), 6) as p99 from lineitem""",
        _NUMBERS,
    ),
)
def _(spark, d):
    got = profile.distribution(table(spark, d, "lineitem"), _NUMBERS)
    marks = [f"p{round(p * 100)}" for p in profile.DISTRIBUTION_MARKS]
    return _rounded(_rounded(got, 5, "mean", "std", "skewness"), 6, "median", *marks)


@query(
    "p7_shape",
    _each(
        """select '{c}' as "column", round(skewness({c}), 5) as skewness, round(kurtosis({c}), 4) as kurtosis,
           count(*) - count({c}) as missing from """
        + MISSING_SQL,
        ["c_acctbal", "o_totalprice"],
    ),
)
def _(spark, d):
    got = profile.shape(with_missing(spark, d), ["c_acctbal", "o_totalprice"])
    return _rounded(_rounded(got, 5, "skewness"), 4, "kurtosis")


@query(
    "p8_column_info",
    " union all ".join(
        f"""select '{c}' as "column", '{t}' as type, count({c}) as non_null, count(*) - count({c}) as nulls,
            count(distinct {c}) as distinct_values from {MISSING_SQL}"""
        for c, t in _MISSING_TYPES
    ),
)
def _(spark, d):
    return profile.column_info(with_missing(spark, d))


@query(
    "p9_numeric_summary",
    f"""select count(*) as total, count(o_totalprice) as non_null, count(*) - count(o_totalprice) as nulls,
               count(distinct o_totalprice) as distinct_values, round(avg(o_totalprice), 4) as mean,
               round(median(o_totalprice), 6) as median, min(o_totalprice) as min, max(o_totalprice) as max,
               round(stddev_samp(o_totalprice), 4) as std, max(o_totalprice) - min(o_totalprice) as range
        from {MISSING_SQL}""",
)
def _(spark, d):
    got = profile.numeric_summary(with_missing(spark, d), "o_totalprice")
    return _rounded(_rounded(got, 4, "mean", "std"), 6, "median")


@query(
    "p10_top_texts",
    f"""select o_orderpriority, count(*) as count,
               round(count(*) * 100.0 / (select count(*) from {MISSING_SQL}), 2)::double as pct,
               (select count(distinct o_orderpriority) from {MISSING_SQL}) as distinct_values
        from {MISSING_SQL} where o_orderpriority is not null
        group by 1 order by 2 desc, 1 limit 5""",
)
def _(spark, d):
    return profile.value_counts(with_missing(spark, d), "o_orderpriority", 5)


@query(
    "p11_date_summary",
    """select min(ts) as earliest, max(ts) as latest, date_sub('day', min(ts), max(ts)) as range_days
       from events""",
)
def _(spark, d):
    return profile.date_summary(table(spark, d, "events"), "ts")


_CONVERSATION = """(select role, text from conversations)"""


@query(
    "p12_quality",
    f"""select round(greatest(0.0, 100.0 - d * 100.0::double / (2 * n)), 2)::double as quality_score, 100.0::double as completeness_pct,
               0::bigint as missing_cells, d as duplicate_rows
        from (select count(*) as n, count(*) - (select count(*) from (select distinct role, text from conversations)) as d
              from conversations)""",
)
def _(spark, d):
    return profile.quality(table(spark, d, "conversations").select("role", "text"))


@query(
    "p13_value_counts",
    """select p_name, count(*) as count, round(count(*) * 100.0 / (select count(*) from part), 2)::double as pct,
              (select count(distinct p_name) from part) as distinct_values
       from part group by 1 order by 2 desc, 1 limit 20""",
)
def _(spark, d):
    return profile.value_counts(table(spark, d, "part"), "p_name", 20)


@query(
    "p14_issues",
    f"""with s as (select * from {MISSING_SQL}),
        q as (select quantile_cont(c_acctbal, [0.25, 0.75]) as a, quantile_cont(o_totalprice, [0.25, 0.75]) as b from s),
        m as (select count(*) as n, count(distinct c_mktsegment) as seg, count(distinct o_orderstatus) as st,
                     count(*) - count(o_orderstatus) as miss,
                     count(*) filter (c_acctbal < a[1] - 1.5 * (a[2] - a[1]) or c_acctbal > a[2] + 1.5 * (a[2] - a[1])) as oa,
                     count(*) filter (o_totalprice < b[1] - 1.5 * (b[2] - b[1]) or o_totalprice > b[2] + 1.5 * (b[2] - b[1])) as ob
              from s, q),
        t as (select 'c_acctbal' as "column", 'double' as type, null::varchar as i,
                     case when oa > 0 then printf('%d outliers (%.1f%%)', oa, round(oa * 100.0::double / n, 1)) end as j from m
              union all
              select 'c_mktsegment', 'string', null,
                     case when seg < 0.5 * n then printf('High duplication (%.1f%%)', round((n - seg) * 100.0::double / n, 1)) end from m
              union all
              select 'o_orderstatus', 'string',
                     case when miss > 0 then printf('%d missing (%.1f%%)', miss, round(miss * 100.0::double / n, 1)) end,
                     case when st < 0.5 * n then printf('High duplication (%.1f%%)', round((n - st) * 100.0::double / n, 1)) end from m
              union all
              select 'o_totalprice', 'double',
                     case when miss > 0 then printf('%d missing (%.1f%%)', miss, round(miss * 100.0::double / n, 1)) end,
                     case when ob > 0 then printf('%d outliers (%.1f%%)', ob, round(ob * 100.0::double / n, 1)) end from m)
        select "column", type, coalesce(nullif(concat_ws('; ', i, j), ''), 'No issues') as issues,
               (i is not null)::bigint + (j is not null)::bigint as issue_count from t""",
)
def _(spark, d):
    names = ["c_acctbal", "c_mktsegment", "o_orderstatus", "o_totalprice"]
    return profile.issues(with_missing(spark, d).select(*names))


@query(
    "p15_duplicates",
    """select count(*) as rows, count(*) - (select count(*) from (select distinct lang, text from documents)) as duplicates
       from documents""",
)
def _(spark, d):
    return profile.duplicate_rows(table(spark, d, "documents"), ["lang", "text"])


@query(
    "p16_insights",
    """with m as (select count(*) as n, count(distinct o_orderstatus) as a, count(distinct o_orderpriority) as b from orders)
       select 'large dataset' as rule, null::varchar as "column", n::double as value from m where n > 100000
       union all select 'small dataset', null, n from m where n < 100
       union all select 'complete data', null, 0
       union all select 'time series potential', null, 1
       union all select 'low cardinality', 'o_orderstatus', round(a / n, 6) from m where a / n < 0.1
       union all select 'low cardinality', 'o_orderpriority', round(b / n, 6) from m where b / n < 0.1""",
)
def _(spark, d):
    return profile.insights(table(spark, d, "orders"))


@query(
    "p17_overview",
    """select count(*) as rows, 6::bigint as columns, 3::bigint as numeric_columns, 2::bigint as text_columns,
              1::bigint as date_columns, 0::bigint as missing_cells, 0::bigint as duplicate_rows from events""",
)
def _(spark, d):
    return profile.overview(table(spark, d, "events"))


@query(
    "p18_report",
    " union all ".join(
        f"""select '{c}' as "column", '{t}' as type, count({c}) as non_null, count(*) - count({c}) as nulls,
            count(distinct {c}) as distinct_values, arg_min({c}, s_suppkey)::varchar as sample,
            count(*) as rows, 0::bigint as duplicate_rows from supplier"""
        for c, t in [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int")]
    ),
)
def _(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    top, details = profile.report(rows, "s_suppkey")
    n, dup = top.select("rows", "duplicate_rows").first()
    return details.withColumns(
        {"rows": F.lit(n).cast("long"), "duplicate_rows": F.lit(dup).cast("long")}
    )


@query(
    "p19_correlations",
    " union all ".join(
        f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem"
        for a in _NUMBERS
        for b in _NUMBERS
    ),
)
def _(spark, d):
    return _rounded(profile.correlations(table(spark, d, "lineitem"), _NUMBERS), 6, "r")


@query(
    "p20_high_correlations",
    """select 'l_extendedprice' as a, 'net' as b, round(corr(l_extendedprice, net), 6) as r
       from (select l_extendedprice, l_extendedprice * (1 - l_discount) as net from lineitem) having abs(corr(l_extendedprice, net)) > 0.95""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
    )
    return _rounded(profile.high_correlations(profile.correlations(rows), 0.95), 6, "r")


@query(
    "v1_bar",
    """select o_orderpriority, round(avg(o_totalprice), 4) as o_totalprice,
              (select round(avg(m), 4) from (select avg(o_totalprice) as m from orders group by o_orderpriority)) as mean_of_bars
       from orders group by 1""",
)
def _(spark, d):
    bars = charts.bar(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    mean = charts.mean_of_bars(bars, "o_totalprice").first()[0]
    return _rounded(bars.withColumn("mean_of_bars", F.lit(mean)), 4, "o_totalprice", "mean_of_bars")


@query("v1_bar_count", "select p_brand, count(*) as count from part group by 1")
def _(spark, d):
    return charts.bar(table(spark, d, "part"), "p_brand", "p_size", "count")


@query(
    "v2_line",
    "select p_size, round(median(p_retailprice), 6) as p_retailprice from part group by 1",
)
def _(spark, d):
    got = charts.line(table(spark, d, "part"), "p_size", "p_retailprice", "median")
    return _rounded(got, 6, "p_retailprice")


@query(
    "v3_scatter",
    "select c_acctbal, c_nationkey, c_mktsegment from customer",
)
def _(spark, d):
    return charts.scatter(table(spark, d, "customer"), "c_nationkey", "c_acctbal", ["c_mktsegment"])


@query(
    "v3_density",
    """select least(floor((l_quantity - x0) / ((x1 - x0) / 20)), 19)::bigint as x_bin,
              least(floor((l_extendedprice - y0) / ((y1 - y0) / 20)), 19)::bigint as y_bin, count(*) as count
       from lineitem, (select min(l_quantity) as x0, max(l_quantity) as x1, min(l_extendedprice) as y0,
                              max(l_extendedprice) as y1 from lineitem) group by 1, 2""",
)
def _(spark, d):
    return charts.density(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query(
    "v4_histogram",
    """with b as (select min(o_totalprice) as lo, (max(o_totalprice) - min(o_totalprice)) / 30 as w from orders)
       select g.bin, count(o_totalprice) as count, round(lo + g.bin * w, 4) as low, round(lo + (g.bin + 1) * w, 4) as high
       from (select unnest(range(30)) as bin) g, b
       left join orders on least(floor((o_totalprice - b.lo) / b.w), 29) = g.bin group by g.bin, lo, w""",
)
def _(spark, d):
    return _rounded(charts.histogram(table(spark, d, "orders"), "o_totalprice"), 4, "low", "high")


@query(
    "v5_box",
    """with q as (select event_type, quantile_cont(value, [0.25, 0.5, 0.75]) as q, min(value) as min, max(value) as max,
                         count(*) as count from events group by 1)
       select event_type, min, round(q[1], 6) as q1, round(q[2], 6) as median, round(q[3], 6) as q3, max,
              (select min(value) from events e where e.event_type = q.event_type
                 and value between q.q[1] - 1.5 * (q.q[3] - q.q[1]) and q.q[3] + 1.5 * (q.q[3] - q.q[1])) as low_whisker,
              (select max(value) from events e where e.event_type = q.event_type
                 and value between q.q[1] - 1.5 * (q.q[3] - q.q[1]) and q.q[3] + 1.5 * (q.q[3] - q.q[1])) as high_whisker,
              (select count(*) from events e where e.event_type = q.event_type
                 and not value between q.q[1] - 1.5 * (q.q[3] - q.q[1]) and q.q[3] + 1.5 * (q.q[3] - q.q[1])) as outliers,
              count from q""",
)
def _(spark, d):
    got = charts.box(table(spark, d, "events"), "value", "event_type")
    return _rounded(got, 6, "q1", "median", "q3")


@query("v6_time_line", "select ts, value, event_id from events")
def _(spark, d):
    return charts.time_line(table(spark, d, "events"), "ts", "value", "event_id")


@query(
    "v6_time_line_daily",
    "select date_trunc('day', ts)::timestamp as ts, round(avg(value), 6) as value from events group by 1",
)
def _(spark, d):
    return _rounded(charts.time_line(table(spark, d, "events"), "ts", "value", every="day"), 6, "value")


@query(
    "v7_score_histogram",
    """with b as (select min(value) as lo, (max(value) - min(value)) / 20 as w from events)
       select t.event_type, g.bin, count(e.value) as count, round(lo + g.bin * w, 4) as low, round(lo + (g.bin + 1) * w, 4) as high
       from (select distinct event_type from events) t, (select unnest(range(20)) as bin) g, b
       left join events e on e.event_type = t.event_type and least(floor((e.value - b.lo) / b.w), 19) = g.bin
       group by t.event_type, g.bin, lo, w""",
)
def _(spark, d):
    got = charts.histogram(table(spark, d, "events"), "value", 20, "event_type")
    return _rounded(got, 4, "low", "high")


@query(
    "v8_shares",
    """select c_mktsegment, count(*) as count, round(count(*) * 100.0 / (select count(*) from customer), 2)::double as pct
       from customer group by 1""",
)
def _(spark, d):
    return charts.shares(table(spark, d, "customer"), "c_mktsegment").withColumn(
        "pct", F.col("pct").cast("double")
    )


@query(
    "r1_head_and_tail",
    """(select 'head' as part, o_orderkey, o_orderdate from orders order by o_orderdate, o_orderkey limit 10)
       union all
       (select 'tail', o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 10)""",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    order = ["o_orderdate", "o_orderkey"]
    first = sampling.head(rows, 10, order).withColumn("part", F.lit("head"))
    return first.unionByName(sampling.tail(rows, 10, order).withColumn("part", F.lit("tail")))


@query("r2_random_rows")
def _(spark, d):
    return sampling.random_rows(table(spark, d, "orders"), 100, ["o_orderkey"])


# What a random sample must be: of the asked size, of rows of the table, none twice.
@query(
    "r2_random_rows_sound",
    """select least(100, count(*)) as rows, least(100, count(*)) as distinct_rows, least(100, count(*)) as known from orders""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    got = sampling.random_rows(orders, 100, ["o_orderkey"])
    every = orders.withColumn("is_known", F.lit(True))
    return got.join(every, ["o_orderkey", "o_totalprice"], "left").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("o_orderkey").alias("distinct_rows"),
        F.count("is_known").alias("known"),
    )


@query("r4_sort", "select s_suppkey, s_nationkey, s_acctbal from supplier")
def _(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return rows.orderBy(F.asc("s_nationkey"), F.desc("s_acctbal"), "s_suppkey")


@query(
    "r5_top",
    "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sampling.top(rows, "o_totalprice", 20, ["o_orderkey"])


@query("r6_train_test_split")
def _(spark, d):
    train, test = sampling.split(table(spark, d, "orders"), ["o_orderkey"], 0.2)
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


# Both parts together are the table, and no row is in both; the share is within four deviations.
@query(
    "r6_split_sound",
    """select count(*) as rows, 1 as fewest, 1 as most, true as known, true as near_share from orders""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    train, test = sampling.split(orders, ["o_orderkey"], 0.2)
    drawn = orders.select("*", F.lit(1).alias("own"), F.lit(0).alias("part"), F.lit(0).alias("test"))
    for part, is_test in ((train, 0), (test, 1)):
        drawn = drawn.unionByName(part.select("*", F.lit(0).alias("own"), F.lit(1).alias("part"), F.lit(is_test).alias("test")))
    per_row = drawn.groupBy("o_orderkey").agg(*[F.sum(c).cast("int").alias(c) for c in ("own", "part", "test")])
    return per_row.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("part").alias("fewest"),
        F.max("part").alias("most"),
        (F.min("own") == 1).alias("known"),
        (F.abs(F.avg("test") - 0.2) < 4 * F.sqrt(F.lit(0.16) / F.count(F.lit(1)))).alias("near_share"),
    )


# The classes, not the chosen rows, are fixed by the rule: each class gives a fifth.
@query(
    "r7_stratified_split",
    """select o_orderstatus, round(count(*) * 0.2)::bigint as test_rows, count(*) - round(count(*) * 0.2)::bigint as train_rows
       from orders group by 1""",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    train, test = sampling.stratified_split(rows, "o_orderstatus", ["o_orderkey"], 0.2)
    both = train.withColumn("t", F.lit(0)).unionByName(test.withColumn("t", F.lit(1)))
    return both.groupBy("o_orderstatus").agg(
        F.sum("t").alias("test_rows"), F.sum(1 - F.col("t")).alias("train_rows")
    )


@query("r8_folds")
def _(spark, d):
    return sampling.folds(
        table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), 5, ["o_orderkey"]
    )


@query(
    "r8_stratified_folds",
    """select o_orderstatus, fold::int as fold, (n // 5 + (fold < n % 5)::int)::bigint as rows
       from (select o_orderstatus, count(*) as n from orders group by 1), (select unnest(range(5)) as fold)""",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    got = sampling.folds(rows, 5, ["o_orderkey"], label="o_orderstatus")
    return got.groupBy("o_orderstatus", "fold").agg(F.count(F.lit(1)).alias("rows"))


# Without repeats a row is drawn once at most; with repeats the mean of draws is the share.
@query(
    "r9_bootstrap_sound",
    """select true as once, true as near_share, true as near_mean, true as known""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    once, many = (sampling.bootstrap(orders, ["o_orderkey"], 0.8, replace=r) for r in (False, True))
    kinds = {"own": orders, "once": once, "many": many}
    drawn = None
    for kind, rows in kinds.items():
        rows = rows.select("*", *[F.lit(int(k == kind)).alias(k) for k in kinds])
        drawn = rows if drawn is None else drawn.unionByName(rows)
    per_row = drawn.groupBy("o_orderkey", "o_totalprice").agg(*[F.sum(k).alias(k) for k in kinds])
    near = lambda c, spread: F.abs(F.avg(c) - 0.8) < 4 * F.sqrt(F.lit(spread) / F.count(F.lit(1)))
    return per_row.agg(
        (F.max("once") == 1).alias("once"),
        near("once", 0.16).alias("near_share"),
        near("many", 0.8).alias("near_mean"),
        ((F.min("own") == 1) & (F.max("own") == 1)).alias("known"),
    )


@query("r9_bootstrap")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sampling.bootstrap(rows, ["o_orderkey"], 0.8)

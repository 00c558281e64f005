"""Patterns, anomalies and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import anomaly, forecast, mining, prepare
from tidepool.plans.registry import query, table


def _rounded(df, places, *names):
    return df.withColumns({n: F.round(n, places) for n in names})


# The part types, in order, for the oracle's bit masks.
_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_CODE = "case p_type " + " ".join(f"when '{t}' then {1 << i}" for i, t in enumerate(_TYPES)) + " end"

def _names(mask: str) -> str:
    cells = ", ".join(
        f"case when {mask} & {1 << i} <> 0 then '{t}' end" for i, t in enumerate(_TYPES)
    )
    return f"concat_ws(', ', {cells})"


_SETS_SQL = f"""
    with b as (select l_orderkey, bit_or({_CODE}) as m from lineitem join part on l_partkey = p_partkey group by 1),
         g as (select m, count(*) as n from b group by 1),
         t as (select count(*) as n from b),
         f as (select i.m, bit_count(i.m) as length, sum(g.n)::bigint as count, sum(g.n) / max(t.n) as support
               from (select unnest(range(1, 64)) as m) i join g on g.m & i.m = i.m, t
               group by 1, 2 having sum(g.n) / max(t.n) >= 0.05)"""


def _types(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, d, "part").select("p_partkey", "p_type")
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return mining.pairs(rows, "l_orderkey", "p_type")


def _itemsets(spark, d):
    return mining.frequent_itemsets(_types(spark, d), 0.05)


@query("t1_baskets", "select distinct l_orderkey as tx, l_suppkey::varchar as item from lineitem")
def _(spark, d):
    return mining.pairs(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query(
    "t1_frequent_baskets",
    """with p as (select distinct l_orderkey as tx, p_type as item from lineitem join part on l_partkey = p_partkey),
            f as (select item from p group by 1 having count(*) >= 100)
       select tx, array_to_string(list_sort(list(item)), ',') as items from p join f using (item) group by 1""",
)
def _(spark, d):
    found = mining.baskets(_types(spark, d), 100)
    return found.select("tx", F.array_join("items", ",").alias("items"))


@query(
    "t1_whole_baskets",
    """select l_orderkey as tx, 0 as chunk, array_to_string(list_sort(list(distinct l_suppkey::varchar)), ',') as items
       from lineitem group by 1""",
)
def _(spark, d):
    found = mining.basket_chunks(mining.pairs(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey"))
    return found.select("tx", "chunk", F.array_join("items", ",").alias("items"))


# Three transactions hold all part keys; each is in many arrays.
@query(
    "t1_hot_baskets",
    """select l_returnflag as tx, count(distinct l_partkey) as items, sum(distinct l_partkey)::bigint as total, true as dealt
       from lineitem group by 1""",
)
def _(spark, d):
    found = mining.basket_chunks(mining.pairs(table(spark, d, "lineitem"), "l_returnflag", "l_partkey"), 50)
    each = found.select("tx", "chunk", "chunks", F.explode("items").alias("item"))
    sums = each.groupBy("tx").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum(F.col("item").cast("long")).alias("total"),
        (F.max("chunk") > 0).alias("dealt"),
    )
    return sums


@query(
    "t2_onehot_baskets",
    """select tx, item from (
         select o_orderkey as tx, unnest([case when o_orderpriority = '1-URGENT' then 'urgent' end,
                case when o_totalprice > 200000 then 'big' end, case when o_orderstatus = 'F' then 'final' end]) as item from orders)
       where item is not null""",
)
def _(spark, d):
    wide = table(spark, d, "orders").select(
        "o_orderkey",
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        (F.col("o_totalprice") > 200000).cast("int").alias("big"),
        (F.col("o_orderstatus") == "F").alias("final"),
    )
    return mining.onehot_pairs(wide, "o_orderkey", ["urgent", "big", "final"])


@query(
    "t3_frequent_itemsets",
    _SETS_SQL + f" select {_names('m')} as items, length::int as length, count, round(support, 9) as support from f",
)
def _(spark, d):
    got = _itemsets(spark, d)
    return got.select(
        F.array_join("items", ", ").alias("items"), "length", "count", F.round("support", 9).alias("support")
    )


@query(
    "t4_itemset_report",
    _SETS_SQL
    + """ select count(*) as itemsets, round(avg(support), 9) as mean_support, max(length)::int as max_length,
                 count(*) filter (length = 1) as single_items from f""",
)
def _(spark, d):
    return _rounded(mining.itemset_report(_itemsets(spark, d)), 9, "mean_support")


_RULES_SQL = (
    _SETS_SQL
    + """, r as (select a.m as am, c.m as cm, a.support as sa, c.support as sc, s.support as s
                 from f a join f c on a.m & c.m = 0 join f s on s.m = a.m | c.m where s.length <= 3),
           q as (select *, s / sa as confidence, s / sa / sc as lift, s - sa * sc as leverage, (1 - sc) / (1 - s / sa) as conviction
                 from r where s / sa >= 0.35)"""
)


@query(
    "t5_association_rules",
    _RULES_SQL
    + f""" select {_names('am')} as antecedent, {_names('cm')} as consequent, round(sa, 8) as antecedent_support, round(sc, 8) as consequent_support,
                  round(s, 8) as support, round(confidence, 8) as confidence, round(lift, 8) as lift, round(leverage, 8) as leverage,
                  round(conviction, 8) as conviction from q""",
)
def _(spark, d):
    got = mining.association_rules(_itemsets(spark, d), "confidence", 0.35, 3)
    got = got.withColumns(
        {s: F.array_join(s, ", ") for s in ("antecedent", "consequent")}
    )
    return _rounded(got, 8, "antecedent_support", "consequent_support", *mining.METRICS)


@query(
    "t6_rule_report",
    _RULES_SQL
    + """ select count(*) as rules, round(avg(confidence), 8) as mean_confidence, round(avg(lift), 8) as mean_lift,
                 count(*) filter (lift > 1) as lifting_rules from q""",
)
def _(spark, d):
    rules = mining.association_rules(_itemsets(spark, d), "confidence", 0.35, 3)
    return _rounded(mining.rule_report(rules), 8, "mean_confidence", "mean_lift")


@query(
    "t6_top_rules",
    _RULES_SQL
    + f""" select {_names('am')} as antecedent, {_names('cm')} as consequent, round(support, 8) as support, round(confidence, 8) as confidence,
                  round(lift, 8) as lift, case when lift > 1 then 'positive' when lift < 1 then 'negative' else 'none' end as direction
           from (select *, s as support from q) order by lift desc limit 10""",
)
def _(spark, d):
    rules = mining.association_rules(_itemsets(spark, d), "confidence", 0.35, 3)
    return _rounded(mining.top_rules(rules), 8, "support", "confidence", "lift")


@query(
    "t7_rule_edges",
    _RULES_SQL
    + f""", e as (select {_names('am')} as source, {_names('cm')} as target, round(lift, 8) as weight from q order by lift desc limit 20)
           select *, (select count(*) from (select source from e union select target from e)) as nodes, (select count(*) from e) as edges from e""",
)
def _(spark, d):
    edges = mining.rule_edges(mining.association_rules(_itemsets(spark, d), "confidence", 0.35, 3))
    counts = mining.edge_counts(edges).first()
    return _rounded(edges, 8, "weight").withColumns(
        {k: F.lit(counts[k]).cast("long") for k in ("nodes", "edges")}
    )


@query(
    "t8_sequences",
    """select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as place, events
       from events join (select user_id, count(*) as events from events group by 1 having count(*) >= 2) using (user_id)""",
)
def _(spark, d):
    rows = table(spark, d, "events")
    return mining.sequences(rows, "user_id", "ts", "event_id", ["event_id"]).select(
        "user_id", "event_id", "place", "events"
    )


@query(
    "t8_sessions",
    """with g as (select user_id, event_id, ts, lag(ts) over w as p from events window w as (partition by user_id order by ts, event_id)),
            s as (select *, sum((p is null or date_sub('second', p, ts) > 43200)::int) over (partition by user_id order by ts, event_id) as session from g),
            c as (select user_id, session, event_id, count(*) over (partition by user_id, session) as events,
                         row_number() over (partition by user_id, session order by ts, event_id) - 1 as place from s)
       select user_id, event_id, place, events from c where events >= 2""",
)
def _(spark, d):
    rows = table(spark, d, "events")
    got = mining.sequences(rows, "user_id", "ts", "event_id", ["event_id"], max_gap_hours=12)
    return got.select("user_id", "event_id", "place", "events")


_PATTERNS_SQL = """
    with e as (select event_type as a, lead(event_type, 1) over w as b, lead(event_type, 2) over w as c
               from events window w as (partition by user_id order by ts, event_id)),
         p as (select a || ' → ' || b as pattern, 2::int as length, count(*) as count from e where b is not null group by 1
               union all select a || ' → ' || b || ' → ' || c, 3, count(*) from e where c is not null group by 1),
         f as (select * from p where count >= 5)"""


@query("t9_sequential_patterns", _PATTERNS_SQL + " select * from f")
def _(spark, d):
    got = mining.sequential_patterns(
        table(spark, d, "events"), "user_id", "ts", "event_type", ["event_id"], 2, 3, 5
    )
    return mining.pattern_table(got)


@query("t10_pattern_lengths", _PATTERNS_SQL + " select length, count(*) as patterns from f group by 1")
def _(spark, d):
    got = mining.sequential_patterns(
        table(spark, d, "events"), "user_id", "ts", "event_type", ["event_id"], 2, 3, 5
    )
    return mining.pattern_lengths(got)


@query(
    "t11_cooccurrence",
    """select o_orderstatus as item1, o_orderpriority as item2, count(*) as count from orders group by 1, 2
       having count(*) >= 5 order by 3 desc, 1, 2 limit 10""",
)
def _(spark, d):
    return mining.cooccurrence(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", 5, 10)


@query(
    "t12_shared_context",
    """with p as (select distinct l_orderkey, l_suppkey::varchar as item from lineitem)
       select a.item as item1, b.item as item2, count(*) as count from p a join p b on a.l_orderkey = b.l_orderkey and a.item < b.item
       group by 1, 2 having count(*) >= 2 order by 3 desc, 1, 2 limit 100""",
)
def _(spark, d):
    return mining.shared_context(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", 2, 100)


@query("a1_isolation_forest")
def _(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", "value", F.hour("ts").alias("hour"), F.weekday("ts").alias("day")
    )
    _, scored = anomaly.fit_isolation_forest(rows, ["value", "hour", "day"], ["event_id"])
    return scored


@query(
    "a2_local_outliers",
    """with v as (select vec_id, embedding::double[] as e from embeddings),
            p as (select *, row_number() over (partition by id order by distance, neighbor) as r
                  from (select a.vec_id as id, b.vec_id as neighbor, list_distance(a.e, b.e) as distance from v a, v b where a.vec_id <> b.vec_id)),
            n as (select * from p where r <= 20),
            k as (select id, max(distance) as kd from n group by 1),
            l as (select n.id, 1 / (avg(greatest(n.distance, k.kd)) + 1e-10) as lrd from n join k on k.id = n.neighbor group by 1),
            f as (select n.id, -(avg(o.lrd) / any_value(l.lrd)) as score from n join l on l.id = n.id join l o on o.id = n.neighbor group by 1)
       select id as vec_id, round(score, 6) as anomaly_score, score < (select quantile_cont(score, 0.1) from f) as is_anomaly from f""",
)
def _(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    got = anomaly.local_outliers(
        rows, [], ["vec_id"], 20, 0.1, vector=F.col("embedding").cast("array<double>")
    )
    return _rounded(got.drop("embedding"), 6, "anomaly_score")


@query(
    "a3_prepare",
    """select l_orderkey, l_linenumber, round((l_quantity - a) / b, 6) as l_quantity, round((l_extendedprice - c) / e, 6) as l_extendedprice
       from lineitem, (select avg(l_quantity) as a, stddev_pop(l_quantity) as b, avg(l_extendedprice) as c, stddev_pop(l_extendedprice) as e from lineitem)""",
)
def _(spark, d):
    features = ["l_quantity", "l_extendedprice"]
    rows, scaling = anomaly.prepared(table(spark, d, "lineitem"), features)
    got = prepare.scale(rows, scaling).select("l_orderkey", "l_linenumber", *features)
    return _rounded(got, 6, *features)


def _scored(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        "value",
        F.hour("ts").cast("double").alias("hour"),
        (-F.col("value") / 1000).alias("anomaly_score"),
        (F.col("value") > 150).alias("is_anomaly"),
    )


@query(
    "a4_report",
    """select count(*) as total, count(*) filter (value > 150) as anomalies,
              round(count(*) filter (value > 150) * 100.0 / count(*), 2)::double as rate_pct, 10.0::double as expected_pct from events""",
)
def _(spark, d):
    return anomaly.report(_scored(spark, d), 0.1)


@query(
    "a4_top_anomalies",
    """select event_id, value, -value / 1000 as anomaly_score from events where value > 150 order by 3, 1 limit 10""",
)
def _(spark, d):
    return anomaly.top_anomalies(_scored(spark, d), ["event_id"]).select(
        "event_id", "value", "anomaly_score"
    )


@query(
    "a5_feature_shift",
    """with e as (select value, hour(ts)::double as hour, value > 150 as a from events)
       select 'value' as feature, round(abs(avg(value) filter (a) - avg(value) filter (not a)) / stddev_pop(value), 6) as importance from e
       union all select 'hour', round(abs(avg(hour) filter (a) - avg(hour) filter (not a)) / stddev_pop(hour), 6) from e""",
)
def _(spark, d):
    return _rounded(anomaly.feature_shift(_scored(spark, d), ["value", "hour"]), 6, "importance")


@query("z1_forecast")
def _(spark, d):
    return forecast.forecast(
        table(spark, d, "events"), "ts", "value", 14, "D", "event_type", daily=True
    )


_LAST = "(select event_type as series, max(ts) as t from events group by 1)"


@query(
    "z2_future_calendar",
    f"""select series, 'D' as freq, t + to_days(i::int) as ds from {_LAST}, (select unnest(range(1, 6)) as i)
        union all
        select series, 'W', t + to_days((case when isodow(t) = 7 then 7 else 7 - isodow(t) end + 7 * (i - 1))::int) from {_LAST}, (select unnest(range(1, 6)) as i)
        union all
        select series, 'M', last_day((date_trunc('month', t) + to_months((i - 1 + (last_day(t) = t::date)::int)::int))::date)::timestamp + (t - date_trunc('day', t))
        from {_LAST}, (select unnest(range(1, 6)) as i)
        union all
        select series, 'Q', last_day((date_trunc('quarter', t) + to_months((3 * (i - 1) + 2)::int))::date)::timestamp + (t - date_trunc('day', t))
        from {_LAST}, (select unnest(range(1, 6)) as i)
        union all
        select series, 'Y', last_day((date_trunc('year', t) + to_months((12 * (i - 1) + 11)::int))::date)::timestamp + (t - date_trunc('day', t))
        from {_LAST}, (select unnest(range(1, 6)) as i)""",
)
def _(spark, d):
    rows = forecast.series_rows(table(spark, d, "events"), "ts", "value", "event_type")
    out = None
    for freq in forecast.FREQUENCIES:
        part = forecast.future(rows, 5, freq).withColumn("freq", F.lit(freq))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "z3_errors",
    """select round(avg(abs(value - 50)), 6) as mae, round(avg(abs((value - 50) / nullif(value, 0))) * 100, 4) as mape_pct,
              round(sqrt(avg((value - 50) * (value - 50))), 6) as rmse from events""",
)
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("value").alias("y"), F.lit(50.0).alias("yhat"))
    return _rounded(_rounded(forecast.errors(rows), 6, "mae", "rmse"), 4, "mape_pct")


@query(
    "z4_summary",
    """with p as (select event_type as series, ts as ds, value as yhat, ts >= timestamp '2024-01-20' as f from events)
       select series, count(*) filter (not f) as history, count(*) filter (f) as forecasts, round(avg(yhat) filter (f), 6) as mean_forecast,
              case when arg_max(yhat, ds) filter (f) > arg_min(yhat, ds) filter (f) then 'up' else 'down' end as trend from p group by 1""",
)
def _(spark, d):
    later = F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("series"),
        F.col("ts").alias("ds"),
        F.col("value").alias("yhat"),
        F.when(later, "future").otherwise("history").alias("part"),
    )
    return _rounded(forecast.summary(rows), 6, "mean_forecast")


@query("z5_components")
def _(spark, d):
    return forecast.forecast(
        table(spark, d, "events"), "ts", "value", 7, "D", components=True, daily=True
    )

"""Scalar, text, date, categorical, group and lag features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import dates, text
from tidepool.operators import encoders, groups, numeric, ordering
from tidepool.plans.registry import MISSING_SQL, query, table, with_missing


@query(
    "e1_log",
    """select c_custkey, round(ln(c_acctbal + case when lo <= 0 then abs(lo) + 1 else 0 end), 8) as c_acctbal_log_transform
       from customer, (select min(c_acctbal) as lo from customer)""",
)
def _(spark, d):
    got = numeric.transform(table(spark, d, "customer"), "c_acctbal", "log")
    return got.select("c_custkey", F.round("c_acctbal_log_transform", 8).alias("c_acctbal_log_transform"))


@query(
    "e2_square_root",
    "select c_custkey, sqrt(abs(c_acctbal)) as c_acctbal_square_root from customer",
)
def _(spark, d):
    got = numeric.transform(table(spark, d, "customer"), "c_acctbal", "sqrt")
    return got.select("c_custkey", "c_acctbal_square_root")


@query(
    "e3_square",
    "select p_partkey, p_size::double * p_size::double as p_size_square from part",
)
def _(spark, d):
    return numeric.transform(table(spark, d, "part"), "p_size", "square").select(
        "p_partkey", "p_size_square"
    )


@query(
    "e4_reciprocal",
    """select l_orderkey, l_linenumber, 1.0::double / nullif(l_discount, 0) as l_discount_reciprocal
       from lineitem""",
)
def _(spark, d):
    got = numeric.transform(table(spark, d, "lineitem"), "l_discount", "reciprocal")
    return got.select("l_orderkey", "l_linenumber", "l_discount_reciprocal")


@query(
    "e5_standard",
    """select l_orderkey, l_linenumber, round((l_extendedprice - m) / s, 6) as z
       from lineitem, (select avg(l_extendedprice) as m, stddev_samp(l_extendedprice) as s from lineitem)""",
)
def _(spark, d):
    got = numeric.transform(table(spark, d, "lineitem"), "l_extendedprice", "standard", "z")
    return got.select("l_orderkey", "l_linenumber", F.round("z", 6).alias("z"))


@query(
    "e6_minmax",
    """select l_orderkey, l_linenumber, round((l_extendedprice - lo) / (hi - lo), 9) as s
       from lineitem, (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem)""",
)
def _(spark, d):
    got = numeric.transform(table(spark, d, "lineitem"), "l_extendedprice", "minmax", "s")
    return got.select("l_orderkey", "l_linenumber", F.round("s", 9).alias("s"))


@query(
    "e7_robust",
    """select l_orderkey, l_linenumber, round((l_extendedprice - q[2]) / (q[3] - q[1]), 8) as r
       from lineitem, (select quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) as q from lineitem)""",
)
def _(spark, d):
    got = numeric.transform(table(spark, d, "lineitem"), "l_extendedprice", "robust", "r")
    return got.select("l_orderkey", "l_linenumber", F.round("r", 8).alias("r"))


@query(
    "e8_quantile_bins",
    """select l_orderkey, l_linenumber, l_extendedprice,
              ((l_extendedprice > q[1])::int + (l_extendedprice > q[2])::int + (l_extendedprice > q[3])::int
               + (l_extendedprice > q[4])::int)::bigint as price_bin,
              ((l_quantity > w[1])::int + (l_quantity > w[2])::int + (l_quantity > w[3])::int)::bigint as quantity_bin
       from lineitem, (select quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) as q,
                              quantile_cont(l_quantity, [0.25, 0.5, 0.75]) as w from lineitem)""",
)
def _(spark, d):
    got = numeric.transform(table(spark, d, "lineitem"), "l_extendedprice", "bins", "price_bin")
    got = numeric.transform(got, "l_quantity", "bins", "quantity_bin", n_bins=4)
    return got.select("l_orderkey", "l_linenumber", "l_extendedprice", "price_bin", "quantity_bin")


@query(
    "e9_arithmetic",
    """select l_orderkey, l_linenumber, l_extendedprice * l_discount as l_extendedprice_x_l_discount,
              l_quantity + l_tax as l_quantity_plus_l_tax, l_quantity - l_tax as l_quantity_minus_l_tax,
              l_quantity / nullif(l_discount, 0) as l_quantity_div_l_discount from lineitem""",
)
def _(spark, d):
    got = table(spark, d, "lineitem")
    keep = ["l_orderkey", "l_linenumber"]
    for a, b, kind in [
        ("l_extendedprice", "l_discount", "multiply"),
        ("l_quantity", "l_tax", "add"),
        ("l_quantity", "l_tax", "subtract"),
        ("l_quantity", "l_discount", "divide"),
    ]:
        got = numeric.arithmetic(got, a, b, kind)
        keep.append(got.columns[-1])
    return got.select(*keep)


@query(
    "e10_concat",
    f"""select c_custkey, o_orderkey, coalesce(o_orderstatus, 'nan') || '-' || coalesce(o_orderpriority, 'nan') as tag
       from {MISSING_SQL}""",
)
def _(spark, d):
    rows = with_missing(spark, d)
    got = text.concat(rows, "o_orderstatus", "o_orderpriority", "-", "tag")
    return got.select("c_custkey", "o_orderkey", "tag")


@query(
    "e11_ratio",
    """select l_orderkey, l_linenumber, l_tax / nullif(l_discount, 0) as l_tax_to_l_discount_ratio,
              l_tax / case when l_discount = 0 then 1e-10 else l_discount end as small from lineitem""",
)
def _(spark, d):
    got = numeric.ratio(table(spark, d, "lineitem"), "l_tax", "l_discount")
    got = numeric.ratio(got, "l_tax", "l_discount", "small_value", "small")
    return got.select("l_orderkey", "l_linenumber", "l_tax_to_l_discount_ratio", "small")


@query(
    "e12_e17_text_features",
    r"""select doc_id, length(text) as text_length,
              length(regexp_replace(regexp_replace(text, '[^\t\n\v\f\r ]+', 'x', 'g'), '[\t\n\v\f\r ]+', '', 'g')) as text_word_count,
              length(replace(text, ' ', '')) as text_char_count,
              length(regexp_replace(text, '[^A-Z]', '', 'g')) as text_uppercase_count,
              length(regexp_replace(text, '[^0-9]', '', 'g')) as text_digit_count,
              length(regexp_replace(text, '[a-zA-Z0-9\t\n\v\f\r ]', '', 'g')) as text_special_chars
       from documents""",
)
def _(spark, d):
    got = text.add_features(table(spark, d, "documents"), "text")
    return got.select("doc_id", *got.columns[-6:])


@query(
    "e18_e21_date_features",
    """select event_id, year(ts) as ts_year, month(ts) as ts_month, day(ts) as ts_day, quarter(ts) as ts_quarter,
              hour(ts) as ts_hour, isodow(ts) - 1 as ts_dayofweek, (isodow(ts) >= 6)::bigint as ts_is_weekend,
              date_diff('day', date '1970-01-01', ts::date) as ts_days_since_epoch from events""",
)
def _(spark, d):
    got = dates.add_features(table(spark, d, "events"), "ts")
    return got.select("event_id", *got.columns[-8:])


@query(
    "e20_weekend_of_missing",
    f"""select c_custkey, o_orderkey, coalesce((isodow(o_orderdate) >= 6)::bigint, 0) as o_orderdate_is_weekend,
              month(o_orderdate) as o_orderdate_month from {MISSING_SQL}""",
)
def _(spark, d):
    rows = with_missing(spark, d)
    got = dates.add_features(rows, "o_orderdate", ["is_weekend", "month"])
    return got.select("c_custkey", "o_orderkey", "o_orderdate_is_weekend", "o_orderdate_month")


@query(
    "e22_one_hot",
    f"""select c_custkey, o_orderkey, coalesce(o_orderstatus = 'F', false) as "o_orderstatus_F",
              coalesce(o_orderstatus = 'O', false) as "o_orderstatus_O", coalesce(o_orderstatus = 'P', false) as "o_orderstatus_P",
              o_orderstatus is null as o_orderstatus_nan
       from {MISSING_SQL}""",
)
def _(spark, d):
    rows = with_missing(spark, d).select(
        "c_custkey", "o_orderkey", "o_orderstatus"
    )
    return encoders.one_hot(rows, "o_orderstatus").drop("o_orderstatus")


@query(
    "e22_one_hot_vector",
    """select (rank - 1)::int as place, rows from (
         select row_number() over (order by o_custkey) as rank, count(*) as rows from orders group by o_custkey)
       union all select (select count(distinct o_custkey) from orders)::int, 0""",
)
def _(spark, d):
    rows = encoders.one_hot_vector(table(spark, d, "orders").select("o_custkey"), "o_custkey")
    return encoders.vector_counts(rows, "o_custkey_onehot")


@query(
    "e23_label_encode",
    """select o_orderkey, o_orderpriority, code as o_orderpriority_label_encoded
       from orders join (select o_orderpriority, row_number() over (order by min(o_orderkey)) - 1 as code
                         from orders group by 1) using (o_orderpriority)""",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return encoders.label(rows, "o_orderpriority", ["o_orderkey"])


@query(
    "e23_label_encode_many_values",
    f"""select c_custkey, o_orderkey, coalesce(code, -1) as clerk_label_encoded
       from (select c_custkey, o_orderkey, 'clerk ' || (o_orderkey % 997)::varchar as clerk
             from {MISSING_SQL})
       left join (select clerk, row_number() over (order by clerk) - 1 as code
                  from (select distinct 'clerk ' || (o_orderkey % 997)::varchar as clerk
                        from {MISSING_SQL} where o_orderkey is not null)) using (clerk)""",
)
def _(spark, d):
    rows = with_missing(spark, d).select(
        "c_custkey",
        "o_orderkey",
        F.concat(F.lit("clerk "), (F.col("o_orderkey") % 997).cast("string")).alias("clerk"),
    )
    return encoders.label(rows, "clerk").drop("clerk")


@query(
    "e24_frequency_encode",
    """select l_orderkey, l_linenumber, l_partkey, count(*) over (partition by l_partkey) as l_partkey_frequency
       from lineitem""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return encoders.frequency(rows, "l_partkey")


@query(
    "e25_target_encode",
    """select o_orderkey, o_orderpriority, round(avg(o_totalprice) over (partition by o_orderpriority), 4)
              as o_orderpriority_target_encoded from orders""",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    got = encoders.target(rows, "o_orderpriority", "o_totalprice")
    name = "o_orderpriority_target_encoded"
    return got.select("o_orderkey", "o_orderpriority", F.round(name, 4).alias(name))


@query(
    "e26_outliers_iqr",
    """select event_id, (value < lo or value > hi)::bigint as value_is_outlier_iqr,
              round(case when value < lo then lo - value when value > hi then value - hi else 0 end, 6) as value_outlier_distance
       from events, (select q[1] - 1.5 * (q[2] - q[1]) as lo, q[2] + 1.5 * (q[2] - q[1]) as hi
                     from (select quantile_cont(value, [0.25, 0.75]) as q from events))""",
)
def _(spark, d):
    got = numeric.outliers(table(spark, d, "events"), "value", "iqr")
    return got.select(
        "event_id",
        "value_is_outlier_iqr",
        F.round("value_outlier_distance", 6).alias("value_outlier_distance"),
    )


@query(
    "e27_outliers_zscore",
    """select event_id, (abs(value - m) / s > 3)::bigint as value_is_outlier_zscore,
              round(abs(value - m) / s, 6) as value_zscore
       from events, (select avg(value) as m, stddev_samp(value) as s from events)""",
)
def _(spark, d):
    got = numeric.outliers(table(spark, d, "events"), "value", "zscore")
    return got.select(
        "event_id", "value_is_outlier_zscore", F.round("value_zscore", 6).alias("value_zscore")
    )


@query(
    "e28_feature_summary",
    """select 'l_discount_reciprocal' as feature, 'double' as type, count(nullif(l_discount, 0)) as non_null,
              11::bigint as original, 2::bigint as created, 13::bigint as total from lineitem
       union all select 'l_quantity_square', 'double', count(l_quantity), 11, 2, 13 from lineitem""",
)
def _(spark, d):
    base = table(spark, d, "lineitem")
    got = numeric.transform(base, "l_discount", "reciprocal")
    return numeric.feature_summary(base, numeric.transform(got, "l_quantity", "square"))


@query("e29_reset", "select * from nation")
def _(spark, d):
    base = table(spark, d, "nation")
    return numeric.reset(base, numeric.transform(base, "n_nationkey", "square"))


@query(
    "w1_group_stats",
    """select l_orderkey, l_linenumber, round(avg(l_extendedprice) over g, 4) as l_extendedprice_mean_by_l_returnflag,
              round(stddev_samp(l_extendedprice) over g, 4) as l_extendedprice_std_by_l_returnflag,
              count(*) over g as l_returnflag_count
       from lineitem window g as (partition by l_returnflag)""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice"
    )
    got = groups.group_stats(rows, "l_returnflag", "l_extendedprice")
    a, b = "l_extendedprice_mean_by_l_returnflag", "l_extendedprice_std_by_l_returnflag"
    return got.select(
        "l_orderkey",
        "l_linenumber",
        F.round(a, 4).alias(a),
        F.round(b, 4).alias(b),
        "l_returnflag_count",
    )


@query(
    "w2_group_rank",
    f"""select c_custkey, o_orderkey, case when o_orderdate is not null then
              rank() over (partition by o_orderpriority, o_orderdate is null order by o_day)
              + (count(*) over (partition by o_orderpriority, o_day) - 1) / 2.0::double end as o_day_rank_in_o_orderpriority
       from (select *, date_diff('day', date '1970-01-01', o_orderdate::date) as o_day
             from {MISSING_SQL})""",
)
def _(spark, d):
    rows = with_missing(spark, d).select(
        "c_custkey",
        "o_orderkey",
        "o_orderpriority",
        F.unix_date(F.to_date("o_orderdate")).cast("long").alias("o_day"),
    )
    got = groups.group_rank(rows, "o_orderpriority", "o_day")
    return got.select("c_custkey", "o_orderkey", "o_day_rank_in_o_orderpriority")


@query(
    "w3_lag_by_key",
    """select event_id, lag(value, 1) over w as value_lag_1, lag(value, 3) over w as value_lag_3,
              lead(value, 2) over w as value_lead_2
       from events window w as (partition by user_id order by ts, event_id)""",
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    got = groups.lags(rows, "value", [1, 3, -2], ["ts", "event_id"], ["user_id"])
    return got.select("event_id", "value_lag_1", "value_lag_3", "value_lead_2")


@query(
    "w3_lag_whole_table",
    """select event_id, lag(value, 1) over w as value_lag_1, lag(value, 24) over w as value_lag_24,
              lead(value, 1) over w as value_lead_1, value as value_lead_0
       from events window w as (order by ts, event_id)""",
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "value")
    got = groups.lags(rows, "value", [1, 24, -1, 0], ["ts", "event_id"])
    return got.select("event_id", "value_lag_1", "value_lag_24", "value_lead_1", "value_lead_0")


@query(
    "r3_row_position",
    """select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as position from orders""",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    got = ordering.with_position(rows, [F.desc("o_totalprice"), "o_orderkey"], "position")
    return got.select("o_orderkey", "position")

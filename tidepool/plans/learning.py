"""Preparation, models, clusters, evaluation, ensembles and automatic search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import (
    automl,
    charts,
    cluster,
    ensemble,
    metrics,
    models,
    neighbors,
    prepare,
)
from tidepool.plans.basics import scratch
from tidepool.plans.registry import MISSING_SQL, query, table, with_missing

_GUESS_SQL = """(select o_orderkey, o_orderstatus as actual,
                        case when o_totalprice < 150000 then 'F' when o_totalprice < 300000 then 'O' else 'P' end as guess
                 from orders)"""


def _guess(spark, d):
    price = F.col("o_totalprice")
    guess = F.when(price < 150000, "F").when(price < 300000, "O").otherwise("P")
    return table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("actual"), guess.alias("guess")
    )


def _rounded(df, places, *names):
    return df.withColumns({n: F.round(n, places) for n in names})


def _order_features(spark, d):
    """Orders with numeric features and a flag for large ones."""
    lines = (
        table(spark, d, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("quantity"),
            F.avg("l_discount").alias("discount"),
            F.max("l_extendedprice").alias("top_price"),
        )
    )
    o = table(spark, d, "orders")
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"]).select(
        "o_orderkey",
        "o_orderstatus",
        "o_totalprice",
        "o_orderpriority",
        F.month("o_orderdate").alias("month"),
        "quantity",
        "discount",
        "top_price",
        (F.col("quantity") > 100).cast("int").alias("large"),
    )


_FEATURES = ["quantity", "discount", "top_price", "month"]
_KEY = ["o_orderkey"]
# Full size, but for the depth: an unlimited tree of random data is a copy of it.
_FOREST = {"max_depth": 5}


@query(
    "m1_problem_type",
    """select 'o_orderstatus' as target, 'classification' as problem
       union all select 'month', case when count(distinct month(o_orderdate)) <= 20 then 'classification' else 'regression' end from orders
       union all select 'o_totalprice', case when count(distinct o_totalprice) <= 10 then 'classification' else 'regression' end from orders
       union all select 'o_custkey', case when count(distinct o_custkey) <= 20 then 'classification' else 'regression' end from orders""",
)
def _(spark, d):
    o = table(spark, d, "orders").withColumn("month", F.month("o_orderdate"))
    names = ["o_orderstatus", "month", "o_totalprice", "o_custkey"]
    rows = [(n, prepare.problem_type(o, n)) for n in names]
    return spark.createDataFrame(rows, "target string, problem string")


@query(
    "m2_imputation",
    f"""select c_custkey, o_orderkey,
               round(coalesce(o_totalprice, (select avg(o_totalprice) from {MISSING_SQL})), 4) as o_totalprice,
               coalesce(o_orderpriority, (select o_orderpriority from {MISSING_SQL} where o_orderpriority is not null
                                          group by 1 order by count(*) desc, 1 limit 1)) as o_orderpriority
        from {MISSING_SQL}""",
)
def _(spark, d):
    rows = with_missing(spark, d).select(
        "c_custkey", "o_orderkey", "o_totalprice", "o_orderpriority"
    )
    fill = prepare.fit_imputation(rows, ["o_totalprice", "o_orderpriority"], "mean")
    return _rounded(prepare.impute(rows, fill), 4, "o_totalprice")


@query(
    "m2_imputation_median",
    f"""select c_custkey, o_orderkey,
               round(coalesce(o_totalprice, (select median(o_totalprice) from {MISSING_SQL})), 4) as o_totalprice
        from {MISSING_SQL}""",
)
def _(spark, d):
    rows = with_missing(spark, d).select("c_custkey", "o_orderkey", "o_totalprice")
    fill = prepare.fit_imputation(rows, ["o_totalprice"], "median")
    return _rounded(prepare.impute(rows, fill), 4, "o_totalprice")


@query(
    "m3_scaling",
    """select l_orderkey, l_linenumber, round((l_extendedprice - m) / s, 6) as standard,
              round((l_extendedprice - lo) / (hi - lo), 8) as minmax, round((l_extendedprice - q[2]) / (q[3] - q[1]), 8) as robust
       from lineitem, (select avg(l_extendedprice) as m, stddev_pop(l_extendedprice) as s, min(l_extendedprice) as lo,
                              max(l_extendedprice) as hi, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) as q from lineitem)""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem")
    cells = []
    for kind, places in (("standard", 6), ("minmax", 8), ("robust", 8)):
        fitted = prepare.fit_scaling(rows, ["l_extendedprice"], kind)["l_extendedprice"]
        cells.append(F.round(prepare.scaled("l_extendedprice", fitted), places).alias(kind))
    return rows.select("l_orderkey", "l_linenumber", *cells)


@query(
    "m4_validation",
    f"""with s as (select * from {MISSING_SQL})
        select 'missing target' as "check", 'warning' as level, count(*) - count(o_orderstatus) || ' rows' as detail from s
        union all select 'missing values', 'warning', 'o_totalprice: ' || (count(*) - count(o_totalprice)) || ' rows' from s
        union all select 'constant feature', 'warning', 'one'
        union all select 'feature is not numeric', 'warning', 'c_mktsegment'
        union all select 'high correlation', 'warning', 'c_acctbal, twice'""",
)
def _(spark, d):
    rows = with_missing(spark, d).withColumns(
        {"one": F.lit(1), "twice": F.col("c_acctbal") * 2 + 1}
    )
    return prepare.validate(
        rows, "o_orderstatus", ["c_acctbal", "twice", "o_totalprice", "one", "c_mktsegment"]
    )


def _predicted(spark, d, algorithm, target, params=None, scaling="none", problem=None):
    rows = _order_features(spark, d)
    model = models.fit(
        rows, target, _FEATURES, algorithm, problem=problem, params=params, scaling=scaling, keys=_KEY
    )
    got = models.predict(model, rows)
    return got.select("o_orderkey", target, *[c for c in got.columns if c.startswith("Pr")])


@query("m5_logistic_regression")
def _(spark, d):
    return _predicted(spark, d, "Logistic Regression", "o_orderstatus", None, "standard")


@query("m6_random_forest_classes")
def _(spark, d):
    return _predicted(spark, d, "Random Forest", "o_orderstatus", _FOREST)


@query("m6_random_forest_values")
def _(spark, d):
    return _predicted(spark, d, "Random Forest", "o_totalprice", _FOREST)


@query("m7_decision_tree")
def _(spark, d):
    return _predicted(spark, d, "Decision Tree", "large", {"max_depth": 4, "min_samples_split": 10})


# Class means and deviations, written out; the smoothing of the variance is
# 1e-9 of the largest variance.
@query(
    "m8_naive_bayes",
    """with r as (select o_orderkey, o_orderstatus, o_totalprice as x, l.q as y from orders
                  join (select l_orderkey, sum(l_quantity) as q from lineitem group by 1) l on l_orderkey = o_orderkey),
            e as (select 1e-9 * greatest(var_pop(x), var_pop(y)) as eps from r),
            c as (select o_orderstatus as k, ln(count(*) / (select count(*) from r)) as prior, avg(x) as mx, avg(y) as my,
                         var_pop(x) + max(eps) as vx, var_pop(y) + max(eps) as vy from r, e group by 1),
            s as (select o_orderkey, k, prior - 0.5 * (ln(2 * pi() * vx) + (x - mx) * (x - mx) / vx)
                         - 0.5 * (ln(2 * pi() * vy) + (y - my) * (y - my) / vy) as score from r, c)
       select o_orderkey, arg_max(k, score) as "Predicted_o_orderstatus" from s group by 1""",
)
def _(spark, d):
    rows = _order_features(spark, d)
    model = models.fit(rows, "o_orderstatus", ["o_totalprice", "quantity"], "Naive Bayes")
    return models.predict(model, rows).select("o_orderkey", "Predicted_o_orderstatus")


# With one yes-or-no feature, these models have closed forms: group shares,
# group majorities and group means.
def _flagged(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        "l_returnflag",
        (F.col("l_linestatus") == "F").cast("int").alias("final"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
    )


@query(
    "m5_logistic_shares",
    """select l_orderkey, l_linenumber, (share > 0.5)::int as "Predicted_returned", round(1 - share, 3) as "Probability_0", round(share, 3) as "Probability_1"
       from lineitem join (select l_linestatus, avg((l_returnflag = 'R')::int) as share from lineitem group by 1) using (l_linestatus)""",
)
def _(spark, d):
    rows = _flagged(spark, d)
    model = models.fit(rows, "returned", ["final"], "Logistic Regression", params={"C": 1e6})
    got = models.predict(model, rows.drop("returned"))
    names = ["Probability_0", "Probability_1"]
    return _rounded(got.select("l_orderkey", "l_linenumber", "Predicted_returned", *names), 3, *names)


_MAJORITY_SQL = """(select l_linestatus, arg_max(l_returnflag, (n, l_returnflag)) as guess
                     from (select l_linestatus, l_returnflag, count(*) as n from lineitem group by 1, 2) group by 1)"""


@query(
    "m7_tree_majority",
    f"""select l_orderkey, l_linenumber, guess as "Predicted_l_returnflag" from lineitem join {_MAJORITY_SQL} using (l_linestatus)""",
)
def _(spark, d):
    rows = _flagged(spark, d)
    model = models.fit(rows, "l_returnflag", ["final"], "Decision Tree", params={"max_depth": 1})
    return models.predict(model, rows).select("l_orderkey", "l_linenumber", "Predicted_l_returnflag")


@query(
    "m7_tree_means",
    """select l_orderkey, l_linenumber, round(avg(l_extendedprice) over (partition by l_linestatus), 4) as "Predicted_l_extendedprice"
       from lineitem""",
)
def _(spark, d):
    rows = _flagged(spark, d)
    model = models.fit(rows, "l_extendedprice", ["final"], "Decision Tree", params={"max_depth": 1})
    got = models.predict(model, rows).select("l_orderkey", "l_linenumber", "Predicted_l_extendedprice")
    return _rounded(got, 4, "Predicted_l_extendedprice")


@query(
    "m12_boosted_means",
    """select l_orderkey, l_linenumber, round(avg(l_extendedprice) over (partition by l_linestatus), 4) as "Predicted_l_extendedprice"
       from lineitem""",
)
def _(spark, d):
    rows = _flagged(spark, d)
    params = {"n_estimators": 1, "max_depth": 1}
    model = models.fit(rows, "l_extendedprice", ["final"], "Gradient Boosting", params=params)
    got = models.predict(model, rows).select("l_orderkey", "l_linenumber", "Predicted_l_extendedprice")
    return _rounded(got, 4, "Predicted_l_extendedprice")


@query("m9_support_vector_classes")
def _(spark, d):
    return _predicted(spark, d, "Support Vector Machine", "large", None, "standard")


@query("m10_support_vector_values")
def _(spark, d):
    return _predicted(spark, d, "Support Vector Regression", "o_totalprice", None, "standard")


# Separable classes: the sides are those of the feature, and the probabilities agree with them.
@query(
    "m9_support_vector_sides",
    """select l_orderkey, l_linenumber, (l_linestatus = 'F')::int as "Predicted_done", (l_linestatus = 'F')::int as sure from lineitem""",
)
def _(spark, d):
    rows = _flagged(spark, d).withColumn("done", F.col("final"))
    model = models.fit(rows, "done", ["final"], "Support Vector Machine", params={"kernel": "linear", "max_iter": 100})
    got = models.predict(model, rows)
    return got.select("l_orderkey", "l_linenumber", "Predicted_done", (F.col("Probability_1") > 0.5).cast("int").alias("sure"))


# Three classes as well: the class shares in each group decide.
@query(
    "m12_softmax_shares",
    """with s as (select l_linestatus, count(*)::double as m from lineitem group by 1),
            k as (select l_returnflag as k, ln(count(*)::double / (select count(*) from lineitem)) as f from lineitem group by 1),
            c as (select l_linestatus, l_returnflag as k, count(*)::double as n from lineitem group by 1, 2),
            p0 as (select s.l_linestatus, k.k, m, coalesce(n, 0) as n, f, exp(f) / sum(exp(f)) over (partition by s.l_linestatus) as p
                   from s, k left join c on c.l_linestatus = s.l_linestatus and c.k = k.k),
            f1 as (select l_linestatus, k, m, n, f + 0.1 * (2.0 / 3) * (n - m * p) / (m * p * (1 - p)) as f from p0),
            p1 as (select *, exp(f) / sum(exp(f)) over (partition by l_linestatus) as p from f1),
            f2 as (select l_linestatus, k, f + 0.1 * (2.0 / 3) * (n - m * p) / (m * p * (1 - p)) as f from p1),
            p2 as (select l_linestatus, k, exp(f) / sum(exp(f)) over (partition by l_linestatus) as p from f2),
            w as (select l_linestatus, round(max(p) filter (where k = 'A'), 6) as "Probability_A",
                    round(max(p) filter (where k = 'N'), 6) as "Probability_N", round(max(p) filter (where k = 'R'), 6) as "Probability_R"
                  from p2 group by 1)
       select l_orderkey, l_linenumber, "Probability_A", "Probability_N", "Probability_R" from lineitem join w using (l_linestatus)""",
)
def _(spark, d):
    rows = _flagged(spark, d)
    params = {"n_estimators": 2, "max_depth": 1, "learning_rate": 0.1}
    model = models.fit(rows, "l_returnflag", ["final"], "Gradient Boosting", params=params)
    names = ["Probability_A", "Probability_N", "Probability_R"]
    return _rounded(models.predict(model, rows).select("l_orderkey", "l_linenumber", *names), 6, *names)


# On an exact line the flattest slope that keeps all rows inside the tube wins.
@query(
    "m10_tube_of_a_line",
    """select l_orderkey, l_linenumber, true as as_flat_as_allowed from lineitem""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_quantity") * 3 + 7).alias("y"))
    params = {"kernel": "linear", "C": 1.0, "epsilon": 5.0}
    model = models.fit(rows, "y", ["l_quantity"], "Support Vector Regression", "regression", params)
    low, high = rows.agg(F.min("l_quantity"), F.max("l_quantity")).first()
    middle = (low + high) / 2
    want = 3 * middle + 7 + (3 - 2 * 5.0 / (high - low)) * (F.col("l_quantity") - middle)
    near = F.abs(F.col("Predicted_y") - want) < 0.1
    return models.predict(model, rows).select("l_orderkey", "l_linenumber", near.alias("as_flat_as_allowed"))


@query("m14_network_values", """select l_orderkey, l_linenumber, true as near from lineitem""")
def _(spark, d):
    target = 2 * F.col("l_quantity") - 100 * F.col("l_discount")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", target.alias("y"))
    params = {"hidden": 8, "max_iter": 200}
    model = models.fit(rows, "y", ["l_quantity", "l_discount"], "Neural Network", "regression", params)
    near = F.abs(F.col("Predicted_y") - F.col("y")) < 2
    return models.predict(model, rows).select("l_orderkey", "l_linenumber", near.alias("near"))


def _embedded(spark, d):
    cells = [F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)]
    return table(spark, d, "embeddings").select("vec_id", "label", *cells)


_PAIRWISE = """with v as (select vec_id, label, embedding::double[] as e from embeddings),
     p as (select a.vec_id as id, b.vec_id as neighbor, b.label as label,
                  list_distance(a.e, b.e) as distance from v a, v b)"""


@query(
    "m11_neighbor_table",
    _PAIRWISE
    + """ select id, neighbor, rank, round(distance, 6) as distance
          from (select *, row_number() over (partition by id order by distance, neighbor) as rank from p where id <> neighbor)
          where rank <= 5""",
)
def _(spark, d):
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")
    )
    return _rounded(neighbors.neighbor_table(rows, 5), 6, "distance")


@query(
    "m11_nearest_classes",
    _PAIRWISE
    + """, n as (select *, row_number() over (partition by id order by distance, neighbor) as rank from p),
           c as (select id, label, count(*) as votes from n where rank <= 5 group by 1, 2)
          select id as vec_id, arg_min(label, (-votes, label)) as "Predicted_label" from c group by 1""",
)
def _(spark, d):
    rows = _embedded(spark, d)
    features = [f"e{i}" for i in range(64)]
    model = models.fit(rows, "label", features, "K-Nearest Neighbors", keys=["vec_id"])
    return models.predict(model, rows).select("vec_id", "Predicted_label")


@query("m12_gradient_boosting_classes")
def _(spark, d):
    return _predicted(spark, d, "Gradient Boosting", "o_orderstatus")


@query("m12_gradient_boosting_values")
def _(spark, d):
    return _predicted(spark, d, "Gradient Boosting", "o_totalprice")


@query(
    "m13_linear_regression",
    """select 'intercept' as term, round(regr_intercept(l_extendedprice, l_quantity), 4) as value from lineitem
       union all select 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) from lineitem""",
)
def _(spark, d):
    model = models.fit(
        table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], "Linear Regression"
    )
    last = model.model.stages[-1]
    rows = [("intercept", float(last.intercept)), ("l_quantity", float(last.coefficients[0]))]
    return _rounded(spark.createDataFrame(rows, "term string, value double"), 4, "value")


# Ridge in one dimension has a closed form on centred data.
@query(
    "m13_ridge_regression",
    """select round(covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + 1000.0), 5) as slope
       from lineitem""",
)
def _(spark, d):
    model = models.fit(
        table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], "Ridge Regression",
        params={"alpha": 1000.0},
    )
    slope = float(model.model.stages[-1].coefficients[0])
    return _rounded(spark.createDataFrame([(slope,)], "slope double"), 5, "slope")


# Lasso in one dimension is a soft threshold of the covariance.
@query(
    "m13_lasso_regression",
    """select round(sign(covar_pop(l_extendedprice, l_quantity)) * greatest(abs(covar_pop(l_extendedprice, l_quantity)) - 100.0, 0)
              / var_pop(l_quantity), 3) as slope from lineitem""",
)
def _(spark, d):
    model = models.fit(
        table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], "Lasso Regression",
        params={"alpha": 100.0},
    )
    slope = float(model.model.stages[-1].coefficients[0])
    return _rounded(spark.createDataFrame([(slope,)], "slope double"), 3, "slope")


@query("m14_neural_network")
def _(spark, d):
    return _predicted(
        spark, d, "Neural Network", "large", None, "standard"
    )


@query("m15_feature_selection")
def _(spark, d):
    rows = _order_features(spark, d)
    out = []
    for method in ("kbest", "model", "rfe"):
        names = models.select_features(rows, "o_totalprice", _FEATURES, method, 2)
        out += [(method, n) for n in names]
    return spark.createDataFrame(out, "method string, feature string")


@query(
    "m15_best_features",
    """with c as (select abs(corr(l_extendedprice, l_quantity)) as q, abs(corr(l_extendedprice, l_discount)) as d,
                         abs(corr(l_extendedprice, l_tax)) as t, abs(corr(l_extendedprice, l_linenumber)) as n from lineitem)
       select feature from (select 'l_quantity' as feature, q as r from c union all select 'l_discount', d from c
                            union all select 'l_tax', t from c union all select 'l_linenumber', n from c) order by r desc limit 2""",
)
def _(spark, d):
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    got = models.select_features(table(spark, d, "lineitem"), "l_extendedprice", names, "kbest", 2)
    return spark.createDataFrame([(n,) for n in got], "feature string")


@query("m15_components")
def _(spark, d):
    rows = _order_features(spark, d)
    model = models.fit(
        rows, "large", _FEATURES, "Logistic Regression", scaling="standard",
        extra_stages=[models.components_stage(2)],
    )
    return models.predict(model, rows).select("o_orderkey", "large", "Predicted_large")


@query("m16_train")
def _(spark, d):
    _, scores, _ = models.train(
        _order_features(spark, d), "large", _FEATURES, "Decision Tree", _KEY, folds=5,
        params={"max_depth": 4},
    )
    return spark.createDataFrame([(k, float(v)) for k, v in scores.items()], "metric string, value double")


@query("m17_batch_predict")
def _(spark, d):
    rows = _order_features(spark, d)
    model, _, test = models.train(rows, "large", _FEATURES, "Random Forest", _KEY, params=_FOREST)
    return models.predict(model, test.drop("large"))


@query(
    "m19_confusion_matrix",
    f"""select a.k as actual, p.k as predicted, count(g.guess) as count
        from (select unnest(['F', 'O', 'P']) as k) a, (select unnest(['F', 'O', 'P']) as k) p
        left join {_GUESS_SQL} g on g.actual = a.k and g.guess = p.k group by 1, 2""",
)
def _(spark, d):
    return metrics.confusion_matrix(_guess(spark, d), "actual", "guess")


_PER_CLASS_SQL = f"""
    with g as (select * from {_GUESS_SQL}),
         k as (select unnest(['F', 'O', 'P']) as label),
         c as (select label, (select count(*) from g where actual = label and guess = label) as h,
                      (select count(*) from g where guess = label) as p, (select count(*) from g where actual = label) as s from k),
         m as (select label, coalesce(h / nullif(p, 0), 0) as precision, coalesce(h / nullif(s, 0), 0) as recall,
                      coalesce(2.0 * h / nullif(p + s, 0), 0)::double as f1, s as support, h from c)"""


@query(
    "m20_classification_report",
    _PER_CLASS_SQL
    + """ select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from m
          union all select 'accuracy', round(sum(h) / sum(support), 6), round(sum(h) / sum(support), 6), round(sum(h) / sum(support), 6), sum(support)::bigint from m
          union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint from m
          union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                           round(sum(f1 * support) / sum(support), 6), sum(support)::bigint from m""",
)
def _(spark, d):
    got = metrics.classification_report(_guess(spark, d), "actual", "guess")
    return _rounded(got, 6, "precision", "recall", "f1")


@query(
    "m20_classification_scores",
    _PER_CLASS_SQL
    + """ select round(sum(h) / sum(support), 6) as accuracy, round(sum(precision * support) / sum(support), 6) as precision,
                 round(sum(recall * support) / sum(support), 6) as recall, round(sum(f1 * support) / sum(support), 6) as f1 from m""",
)
def _(spark, d):
    got = metrics.classification_scores(_guess(spark, d), "actual", "guess")
    return _rounded(got, 6, "accuracy", "precision", "recall", "f1")


@query(
    "m21_regression_scores",
    """select round(1 - avg(e * e) / var_pop(y), 6) as r2, round(sqrt(avg(e * e)), 3) as rmse, round(avg(abs(e)), 3) as mae,
              round(avg(e * e), 0) as mse
       from (select l_extendedprice as y, l_extendedprice - 2000 * l_quantity as e from lineitem)""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 2000)
    got = metrics.regression_scores(rows, "l_extendedprice", "p")
    return _rounded(_rounded(_rounded(got, 6, "r2"), 3, "rmse", "mae"), 0, "mse")


@query("m22_cross_validation")
def _(spark, d):
    scores = models.cross_validate(
        _order_features(spark, d), "o_totalprice", _FEATURES, "Linear Regression", _KEY, 5
    )
    return models.fold_table(spark, scores)


@query(
    "m23_roc_curve",
    """with s as (select round(l_extendedprice / 100) as threshold, count(*) filter (l_returnflag = 'R') as p,
                         count(*) filter (l_returnflag <> 'R') as n from lineitem group by 1)
       select threshold, sum(p) over w::bigint as tp, sum(n) over w::bigint as fp,
              round(sum(p) over w / (select sum(p) from s), 9) as tpr, round(sum(n) over w / (select sum(n) from s), 9) as fpr
       from s window w as (order by threshold desc)""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn("score", F.round(F.col("l_extendedprice") / 100))
    curve = metrics.roc_curve(rows, F.col("l_returnflag") == "R", "score")
    return _rounded(curve.drop("area"), 9, "tpr", "fpr")


@query(
    "m23_auc_and_log_loss",
    """with s as (select l_extendedprice as t, count(*) filter (l_returnflag = 'R') as p, count(*) filter (l_returnflag <> 'R') as n
                  from lineitem group by 1),
            c as (select n, p, coalesce(sum(p) over (order by t desc rows between unbounded preceding and 1 preceding), 0) as b from s)
       select round(sum(n * (b + p / 2)) / (sum(n)::double * sum(p)::double), 8) as auc,
              (select round(avg(-ln(case when l_returnflag = 'R' then l_extendedprice / 110000 else 1 - l_extendedprice / 110000 end)), 6)
               from lineitem) as log_loss from c""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn("p", F.col("l_extendedprice") / 110000)
    positive = F.col("l_returnflag") == "R"
    area = metrics.auc(metrics.roc_curve(rows, positive, "l_extendedprice")).first()[0]
    loss = metrics.log_loss(rows, positive, "p")
    return loss.select(F.lit(area).alias("auc"), "log_loss").select(
        F.round("auc", 8).alias("auc"), F.round("log_loss", 6).alias("log_loss")
    )


@query(
    "m24_residual_histogram",
    """with r as (select l_extendedprice - l_quantity * 2000 as e from lineitem),
            b as (select min(e) as lo, (max(e) - min(e)) / 20 as w from r)
       select bin, count(*) as count from (select least(floor((e - lo) / w), 19)::bigint as bin from r, b) group by 1""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 2000)
    pairs = metrics.residuals(rows, "l_extendedprice", "p")
    got = charts.histogram(pairs, "residual", 20).select("bin", "count")
    return got.filter(F.col("count") > 0)


@query(
    "m24_prediction_bounds",
    """select least(min(l_extendedprice), min(l_quantity * 2000)) as low, greatest(max(l_extendedprice), max(l_quantity * 2000)) as high
       from lineitem""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 2000)
    return metrics.prediction_bounds(metrics.residuals(rows, "l_extendedprice", "p"))


# Two coefficients by Cramer's rule on covariances.
@query(
    "m25_coefficients",
    """with c as (select var_pop(l_quantity) as a, var_pop(l_discount) as b, covar_pop(l_quantity, l_discount) as c,
                         covar_pop(l_quantity, l_extendedprice) as y, covar_pop(l_discount, l_extendedprice) as z from lineitem)
       select 'l_quantity' as feature, round((y * b - z * c) / (a * b - c * c), 4) as coefficient from c
       union all select 'l_discount', round((z * a - y * c) / (a * b - c * c), 2) from c""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem")
    model = models.fit(rows, "l_extendedprice", ["l_quantity", "l_discount"], "Linear Regression")
    places = F.when(F.col("feature") == "l_quantity", F.round("coefficient", 4))
    return models.importances(model, spark).withColumn(
        "coefficient", places.otherwise(F.round("coefficient", 2))
    )


@query("m25_importances")
def _(spark, d):
    rows = _order_features(spark, d)
    return models.importances(models.fit(rows, "large", _FEATURES, "Random Forest", params=_FOREST), spark)


@query("m26_compare_models")
def _(spark, d):
    rows = _order_features(spark, d)
    tree, _, test = models.train(rows, "large", _FEATURES, "Decision Tree", _KEY, params={"max_depth": 3})
    bayes, _, _ = models.train(rows, "large", _FEATURES, "Naive Bayes", _KEY)
    return models.compare([tree, bayes], test).drop("model_id")


@query(
    "m26_compare_majorities",
    f"""with g as (select l_returnflag = guess as hit from lineitem join {_MAJORITY_SQL} using (l_linestatus)),
             o as (select l_returnflag, count(*) as n from lineitem group by 1)
        select 'Decision Tree' as algorithm, round(avg(hit::int), 6) as accuracy from g
        union all select 'Naive Bayes', round(avg(hit::int), 6) from g""",
)
def _(spark, d):
    rows = _flagged(spark, d)
    tree = models.fit(rows, "l_returnflag", ["final"], "Decision Tree", params={"max_depth": 1})
    bayes = models.fit(rows, "l_returnflag", ["final"], "Naive Bayes")
    return _rounded(models.compare([tree, bayes], rows).select("algorithm", "accuracy"), 6, "accuracy")


@query(
    "m27_registry",
    f"""select l_orderkey, l_linenumber, guess as "Predicted_l_returnflag" from lineitem join {_MAJORITY_SQL} using (l_linestatus)""",
)
def _(spark, d):
    rows = _flagged(spark, d)
    registry = models.Registry(spark, scratch(spark))
    tree = models.fit(rows, "l_returnflag", ["final"], "Decision Tree", params={"max_depth": 1})
    line = models.fit(rows, "l_extendedprice", ["final"], "Linear Regression")
    registry.save(tree)
    registry.save(line)
    registry.delete(line.model_id)
    again = registry.load(registry.listing().first()["model_id"])
    return models.predict(again, rows).select("l_orderkey", "l_linenumber", "Predicted_l_returnflag")


@query("m28_build_model")
def _(spark, d):
    rows = _order_features(spark, d).withColumn(
        "discount", F.when(F.col("month") == 7, F.lit(None)).otherwise(F.col("discount"))
    )
    _, scores, steps = automl.build(
        rows, "large", [*_FEATURES, "o_orderpriority"], "Logistic Regression", _KEY,
        selection="kbest", n_features=4,
    )
    return steps.withColumn("accuracy", F.lit(scores["accuracy"]))


@query("m29_parameter_search")
def _(spark, d):
    _, tried = automl.search(
        _order_features(spark, d), "large", _FEATURES, "Decision Tree", _KEY,
        {"max_depth": [2, 4, 6]}, folds=5,
    )
    return automl.search_table(spark, tried)


@query("m30_automatic_search")
def _(spark, d):
    found = automl.run(
        _order_features(spark, d).drop("month", "top_price"), "o_totalprice", _KEY,
        scalings=["none", "standard"], algorithms=["Linear Regression", "Ridge Regression"],
        grids={"Ridge Regression": {"alpha": [1.0, 100.0]}}, folds=5,
    )
    return found.leaderboard(spark)


@query("c1_kmeans")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return cluster.cluster(rows, ["c_acctbal", "c_nationkey"], 3)


_CENTRES = [[500.0, 5.0], [4500.0, 12.0], [8500.0, 20.0]]
_CENTRE_SQL = [
    f"sqrt((c_acctbal - {a}) * (c_acctbal - {a}) + (c_nationkey - {n}) * (c_nationkey - {n}))"
    for a, n in _CENTRES
]


@query(
    "c2_assign",
    f"""select c_custkey, round(a, 6) as "Distance_to_Cluster_0", round(b, 6) as "Distance_to_Cluster_1", round(c, 6) as "Distance_to_Cluster_2",
               round(least(a, b, c), 6) as "Distance_to_Center",
               (case when a <= b and a <= c then 0 when b <= c then 1 else 2 end)::int as "Predicted_Cluster"
        from (select c_custkey, {_CENTRE_SQL[0]} as a, {_CENTRE_SQL[1]} as b, {_CENTRE_SQL[2]} as c from customer)""",
)
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    got = cluster.assign(rows, ["c_acctbal", "c_nationkey"], _CENTRES).drop("c_acctbal", "c_nationkey")
    return _rounded(got, 6, "Distance_to_Center", *[f"Distance_to_Cluster_{i}" for i in range(3)])


@query(
    "c3_cluster_sizes",
    f"""select "Cluster", count(*) as rows from (
          select (case when a <= b and a <= c then 0 when b <= c then 1 else 2 end)::int as "Cluster"
          from (select {_CENTRE_SQL[0]} as a, {_CENTRE_SQL[1]} as b, {_CENTRE_SQL[2]} as c from customer)) group by 1""",
)
def _(spark, d):
    rows = cluster.assign(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], _CENTRES, "Cluster")
    return cluster.sizes(rows)


# Three given votes per order.
_VOTES_SQL = """(select o_orderkey, o_orderstatus, case when o_totalprice < 200000 then 'F' else 'O' end as a,
                        case when o_custkey % 3 = 0 then 'P' else 'O' end as b,
                        case when month(o_orderdate) < 5 then 'F' when month(o_orderdate) < 9 then 'P' else 'O' end as c from orders)"""


def _votes(spark, d):
    month = F.month("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(F.col("o_totalprice") < 200000, "F").otherwise("O").alias("a"),
        F.when(F.col("o_custkey") % 3 == 0, "P").otherwise("O").alias("b"),
        F.when(month < 5, "F").when(month < 9, "P").otherwise("O").alias("c"),
    )


@query(
    "b1_hard_vote",
    f"""select o_orderkey, case when f >= o and f >= p then 'F' when o >= p then 'O' else 'P' end as vote,
               case when 1.5 * (a = 'F')::int + (c = 'F')::int >= 1.5 * (a = 'O')::int + 0.5 * (b = 'O')::int + (c = 'O')::int
                     and 1.5 * (a = 'F')::int + (c = 'F')::int >= 0.5 * (b = 'P')::int + (c = 'P')::int then 'F'
                    when 1.5 * (a = 'O')::int + 0.5 * (b = 'O')::int + (c = 'O')::int >= 0.5 * (b = 'P')::int + (c = 'P')::int then 'O'
                    else 'P' end as weighted_vote
        from (select *, (a = 'F')::int + (b = 'F')::int + (c = 'F')::int as f, (a = 'O')::int + (b = 'O')::int + (c = 'O')::int as o,
                     (a = 'P')::int + (b = 'P')::int + (c = 'P')::int as p from {_VOTES_SQL})""",
)
def _(spark, d):
    votes = [F.col("a"), F.col("b"), F.col("c")]
    classes = ["F", "O", "P"]
    return _votes(spark, d).select(
        "o_orderkey",
        ensemble.hard_vote(votes, classes).alias("vote"),
        ensemble.hard_vote(votes, classes, [1.5, 0.5, 1.0]).alias("weighted_vote"),
    )


@query(
    "b2_soft_vote",
    """select o_orderkey, case when 2 * p + q >= 3 - 2 * p - q then 'no' else 'yes' end as vote
       from (select o_orderkey, o_totalprice / 500001 as p, (o_custkey % 10) / 10 as q from orders)""",
)
def _(spark, d):
    p, q = F.col("o_totalprice") / 500001, (F.col("o_custkey") % 10) / 10
    vote = ensemble.soft_vote([F.array(p, 1 - p), F.array(q, 1 - q)], ["no", "yes"], [2.0, 1.0])
    return table(spark, d, "orders").select("o_orderkey", vote.alias("vote"))


@query(
    "b3_weighted_mean",
    """select l_orderkey, l_linenumber, round(l_extendedprice * 0.75 + l_quantity * 2000 * 0.25, 4) as mean from lineitem""",
)
def _(spark, d):
    mean = ensemble.weighted_mean([F.col("l_extendedprice"), F.col("l_quantity") * 2000], [1.5, 0.5])
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(mean, 4).alias("mean")
    )


@query("b3_score_weights")
def _(spark, d):
    rows = _order_features(spark, d)
    scores = {}
    for name, params in (("Linear Regression", {}), ("Decision Tree", {"max_depth": 4})):
        _, got, _ = models.train(rows, "o_totalprice", ["top_price", "quantity"], name, _KEY, params=params)
        scores[name] = max(got["r2"], 1e-6)
    return ensemble.vote_table(spark, scores)


@query("b4_bagging")
def _(spark, d):
    rows = _order_features(spark, d)
    bag = ensemble.bagging(rows, "large", _FEATURES, "Decision Tree", _KEY, params={"max_depth": 4})
    return models.predict(bag, rows).select("o_orderkey", "large", "Predicted_large")


@query(
    "b5_chain",
    f"""select l_orderkey, l_linenumber, round(avg(l_extendedprice) over (partition by l_linestatus), 4) as step_1,
               (case guess when 'A' then 0 when 'N' then 1 else 2 end)::double as step_2
        from lineitem join {_MAJORITY_SQL} using (l_linestatus)""",
)
def _(spark, d):
    rows = _flagged(spark, d)
    first = models.fit(rows, "l_extendedprice", ["final"], "Linear Regression")
    fed = ensemble.chain(rows, [first])
    second = models.fit(fed, "l_returnflag", ["prev_prediction"], "Decision Tree", params={"max_depth": 1})
    got = ensemble.chain(rows, [first, second]).select("l_orderkey", "l_linenumber", "step_1", "step_2")
    return _rounded(got, 4, "step_1")


@query(
    "b6_chain_report",
    """select 1::bigint as step, count(*) as rows, round(avg(x), 4) as mean, round(stddev_pop(x), 4) as std, min(x) as min, max(x) as max
       from (select l_quantity * 2000 as x from lineitem)
       union all select 2, count(*), round(avg(x), 4), round(stddev_pop(x), 4), min(x), max(x)
       from (select l_quantity * 2000 + l_tax as x from lineitem)""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        (F.col("l_quantity") * 2000).alias("step_1"),
        (F.col("l_quantity") * 2000 + F.col("l_tax")).alias("step_2"),
    )
    return _rounded(ensemble.chain_report(rows, 2), 4, "mean", "std")


_BASES = [("Decision Tree", {"max_depth": 3}), ("Naive Bayes", {})]


@query("b7_stacking")
def _(spark, d):
    rows = _order_features(spark, d)
    stack, _ = ensemble.stacking(
        rows, "large", _FEATURES, _BASES, ("Logistic Regression", {}), _KEY
    )
    return models.predict(stack, rows).select("o_orderkey", "large", "Predicted_large")


@query("b8_out_of_fold")
def _(spark, d):
    held = ensemble.out_of_fold(_order_features(spark, d), "large", _FEATURES, _BASES, _KEY)
    return ensemble.meta_summary(held)


@query(
    "b9_ensemble_report",
    f"""with v as (select *, case when a = b then a when a = c then a when b = c then b else 'F' end as e from {_VOTES_SQL}),
             s as (select avg((o_orderstatus = e)::int) as e, avg((o_orderstatus = a)::int) as a,
                          avg((o_orderstatus = b)::int) as b, avg((o_orderstatus = c)::int) as c from v)
        select 'e' as model, round(e, 6) as accuracy, case when c >= a and c >= b then 'c' when b >= a then 'b' else 'a' end as best_base,
               round(e - greatest(a, b, c), 6) as improvement from s
        union all select 'a', round(a, 6), case when c >= a and c >= b then 'c' when b >= a then 'b' else 'a' end, null from s
        union all select 'b', round(b, 6), case when c >= a and c >= b then 'c' when b >= a then 'b' else 'a' end, null from s
        union all select 'c', round(c, 6), case when c >= a and c >= b then 'c' when b >= a then 'b' else 'a' end, null from s""",
)
def _(spark, d):
    votes = [F.col("a"), F.col("b"), F.col("c")]
    rows = _votes(spark, d).withColumn("e", ensemble.hard_vote(votes, ["F", "O", "P"]))
    got = ensemble.compare_columns(rows, "o_orderstatus", ["a", "b", "c"], "e", "classification")
    return _rounded(got.select("model", "accuracy", "best_base", "improvement"), 6, "accuracy", "improvement")


# Targets that one feature tells exactly: whatever is drawn, split or folded, the answer is known.
_SIZE_SQL = "case when o_totalprice > 150000 then 'large' else 'small' end"
_COST_SQL = "case when o_totalprice > 150000 then 350.0 else 250.0 end::double"


def _told(spark, d):
    """Orders with a yes-or-no feature, and a class and a value that it tells."""
    rows = table(spark, d, "orders").withColumn("high", (F.col("o_totalprice") > 150000).cast("double"))
    return rows.select(
        "o_orderkey", "high", F.when(F.col("high") == 1, "large").otherwise("small").alias("size"),
        (F.col("high") * 100 + 250).alias("cost"),
    )


def _said(model, rows, target="size"):
    return models.predict(model, rows.drop(target)).select("o_orderkey", f"Predicted_{target}")


@query("m6_forest_of_told_classes", f"""select o_orderkey, {_SIZE_SQL} as "Predicted_size" from orders""")
def _(spark, d):
    rows = _told(spark, d)
    return _said(models.fit(rows, "size", ["high"], "Random Forest", keys=_KEY), rows)


@query("m6_forest_of_told_values", f"""select o_orderkey, {_COST_SQL} as "Predicted_cost" from orders""")
def _(spark, d):
    rows = _told(spark, d)
    model = models.fit(rows, "cost", ["high"], "Random Forest", problem="regression", keys=_KEY)
    return _rounded(_said(model, rows, "cost"), 6, "Predicted_cost")


@query(
    "m16_train_told",
    """select * from (values ('accuracy', 1.0::double), ('cv_mean', 1.0), ('cv_std', 0.0)) t(metric, value)
       where (select count(*) from orders) > 0""",
)
def _(spark, d):
    _, scores, _ = models.train(_told(spark, d), "size", ["high"], "Decision Tree", _KEY, folds=5)
    return spark.createDataFrame(
        [(k, float(scores[k])) for k in ("accuracy", "cv_mean", "cv_std")], "metric string, value double"
    )


@query("m17_batch_predict_told", f"""select o_orderkey, {_SIZE_SQL} as "Predicted_size" from orders""")
def _(spark, d):
    rows = _told(spark, d)
    model, _, _ = models.train(rows, "size", ["high"], "Random Forest", _KEY)
    return _said(model, rows)


@query(
    "m22_cross_validation_told",
    """select unnest(range(5))::int as fold, 1.0::double as score, 1.0::double as mean, 0.0::double as std,
              1.0::double as min, 1.0::double as max, 0.0::double as stability_pct from (select count(*) from orders)""",
)
def _(spark, d):
    scores = models.cross_validate(_told(spark, d), "size", ["high"], "Logistic Regression", _KEY, 5)
    return models.fold_table(spark, scores)


@query("m28_build_told", f"""select o_orderkey, {_SIZE_SQL} as "Predicted_size" from orders""")
def _(spark, d):
    rows = _told(spark, d)
    model, _, _ = automl.build(rows, "size", ["high"], "Decision Tree", _KEY)
    return _said(model, rows)


@query(
    "m29_search_told",
    """select '{''max_depth'': ' || unnest([2, 4, 6]) || '}' as params, 1.0::double as cv_mean, 0.0::double as cv_std
       from (select count(*) from orders)""",
)
def _(spark, d):
    _, tried = automl.search(_told(spark, d), "size", ["high"], "Decision Tree", _KEY, {"max_depth": [2, 4, 6]}, folds=5)
    return automl.search_table(spark, tried)


@query(
    "c1_kmeans_planted",
    """select c_custkey, min(c_custkey) over (partition by c_custkey % 3) as first_of_cluster from customer""",
)
def _(spark, d):
    # Three groups far from each other: balances differ by ten thousands only within a million.
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") + F.col("c_custkey") % 3 * 1_000_000).alias("x"))
    found = cluster.cluster(rows, ["x"], 3)
    first = found.groupBy("Cluster").agg(F.min("c_custkey").alias("first_of_cluster"))
    return found.join(F.broadcast(first), "Cluster").select("c_custkey", "first_of_cluster")


@query("b4_bagging_told", f"""select o_orderkey, {_SIZE_SQL} as "Predicted_size" from orders""")
def _(spark, d):
    rows = _told(spark, d)
    return _said(ensemble.bagging(rows, "size", ["high"], "Decision Tree", _KEY), rows)


@query("b7_stacking_told", f"""select o_orderkey, {_SIZE_SQL} as "Predicted_size" from orders""")
def _(spark, d):
    rows = _told(spark, d)
    stack, _ = ensemble.stacking(rows, "size", ["high"], _BASES, ("Logistic Regression", {}), _KEY)
    return _said(stack, rows)


@query("b8_out_of_fold_told", f"select o_orderkey, {_COST_SQL} as first, {_COST_SQL} as second from orders")
def _(spark, d):
    bases = [("Linear Regression", {}), ("Decision Tree", {"max_depth": 3})]
    held = ensemble.out_of_fold(_told(spark, d), "cost", ["high"], bases, _KEY, problem="regression")
    first, second = [c for c in held.columns if c.startswith("meta_")]
    return held.select("o_orderkey", F.round(first, 4).alias("first"), F.round(second, 4).alias("second"))

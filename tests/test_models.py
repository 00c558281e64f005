import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import (
    automl, cluster, ensemble, forecast, metrics, models, numeric,
)

TREE = ("Decision Tree", {"max_depth": 4})


@pytest.fixture(scope="module")
def data(spark):
    """y follows a and b; the class c is a cut of y; t is a text."""
    rng = np.random.default_rng(0)
    a, b, e = rng.normal(0, 1, (3, 1500))
    y = 3 * a - 2 * b + 0.1 * e
    rows = [
        (i, float(a[i]), float(b[i]), float(y[i]), "hi" if y[i] > 1 else "mid" if y[i] > -1 else "lo",
         int(y[i] > 0), "uvw"[i % 3])
        for i in range(1500)
    ]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, c string, d int, t string")
    return df.persist()


def accuracy(m, df):
    return models.main_score(m.problem, models.evaluate(m, df))


@pytest.mark.parametrize(
    "algorithm, params, least",
    [
        ("Logistic Regression", {}, 0.95),
        ("Random Forest", {"n_estimators": 10, "max_depth": 6}, 0.85),
        ("Naive Bayes", {}, 0.8),
        ("K-Nearest Neighbors", {}, 0.9),
        ("Support Vector Machine", {"kernel": "linear", "max_iter": 10}, 0.6),
        ("Neural Network", {"max_iter": 40}, 0.9),
        ("Gradient Boosting", {"n_estimators": 3}, 0.75),
    ],
)
def test_classifiers(data, algorithm, params, least):
    m = models.fit(data, "c", ["a", "b"], algorithm, params=params, scaling="standard", keys=["id"])
    assert m.classes == ["hi", "lo", "mid"] and accuracy(m, data) >= least
    got = models.predict(m, data)
    proba = [c for c in got.columns if c.startswith("Probability_")]
    if proba:
        total = sum(F.col(c) for c in proba)
        assert got.filter(F.abs(total - 1) > 1e-9).count() == 0


def test_support_vectors_with_rbf(data):
    m = models.fit(
        data, "d", ["a", "b"], "Support Vector Machine", params={"max_iter": 10, "C": 100.0},
        scaling="standard",
    )
    assert accuracy(m, data) > 0.9


@pytest.mark.parametrize(
    "algorithm, params, least",
    [
        ("Linear Regression", {}, 0.99),
        ("Ridge Regression", {"alpha": 1.0}, 0.99),
        ("Lasso Regression", {"alpha": 0.01}, 0.99),
        ("Random Forest", {"n_estimators": 10, "max_depth": 6}, 0.8),
        ("Support Vector Regression", {"max_iter": 20}, 0.8),
        ("K-Nearest Neighbors", {"weights": "distance"}, 0.95),
        ("Gradient Boosting", {"n_estimators": 10}, 0.6),
    ],
)
def test_regressors(data, algorithm, params, least):
    m = models.fit(data, "y", ["a", "b"], algorithm, params=params, scaling="standard", keys=["id"])
    assert accuracy(m, data) >= least


def test_ridge_equals_closed_form(data):
    p = data.toPandas()
    x, y = p[["a", "b"]].to_numpy(), p["y"].to_numpy()
    x, y = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(x.T @ x + 500 * np.eye(2), x.T @ y)
    m = models.fit(data, "y", ["a", "b"], "Ridge Regression", params={"alpha": 500.0})
    np.testing.assert_allclose(m.model.stages[-1].coefficients.toArray(), want, rtol=1e-6)


def test_unknown_algorithm_and_missing_feature(data):
    with pytest.raises(ValueError, match="not available"):
        models.fit(data, "y", ["a"], "Naive Bayes")
    with pytest.raises(ValueError, match="zz"):
        models.fit(data, "y", ["a", "zz"], "Linear Regression")
    m = models.fit(data, "y", ["a"], "Linear Regression")
    with pytest.raises(ValueError, match="Missing required features: a"):
        models.predict(m, data.drop("a"))


def test_same_seed_same_model(data):
    got = [
        models.predict(
            models.fit(data, "c", ["a", "b"], "Random Forest", params={"n_estimators": 5, "max_depth": 4}),
            data,
        ).select("id", "Predicted_c").orderBy("id").collect()
        for _ in range(2)
    ]
    assert got[0] == got[1]


def test_cross_validation_and_train(data):
    scores = models.cross_validate(data, "y", ["a", "b"], "Linear Regression", ["id"], 3)
    assert len(scores) == 3 and min(scores) > 0.99
    m, got, test = models.train(data, "c", ["a", "b"], *TREE[:1], ["id"], params=TREE[1], folds=2)
    assert {"accuracy", "cv_mean", "cv_std"} <= got.keys() and test.count() < 400


def test_registry_round_trip(spark, data, tmp_path):
    registry = models.Registry(spark, str(tmp_path))
    assert registry.listing().count() == 0
    tree = models.fit(data, "c", ["a", "b"], TREE[0], params=TREE[1])
    near = models.fit(data, "y", ["a", "b"], "K-Nearest Neighbors", keys=["id"])
    for m in (tree, near):
        registry.save(m)
        again = registry.load(m.model_id)
        name = f"Predicted_{m.target}"
        want = models.predict(m, data).select("id", name)
        assert models.predict(again, data).select("id", name).exceptAll(want).count() == 0
    assert registry.listing().first()["model_id"] == near.model_id
    registry.delete(tree.model_id)
    assert [r["model_id"] for r in registry.listing().collect()] == [near.model_id]
    with pytest.raises(ValueError):
        registry.load("../x")


def test_importances_and_comparison(spark, data):
    tree = models.fit(data, "c", ["a", "b"], TREE[0], params=TREE[1])
    bayes = models.fit(data, "c", ["a", "b"], "Naive Bayes")
    assert models.importances(tree, spark).first()["feature"] == "a"
    line = models.fit(data, "y", ["a", "b"], "Linear Regression")
    assert models.importances(line, spark).first()["coefficient"] == pytest.approx(3, abs=0.1)
    assert models.compare([tree, bayes], data).count() == 2
    with pytest.raises(ValueError):
        models.compare([tree, line], data)


def test_feature_selection(data):
    noisy = data.withColumn("n", F.pmod(F.xxhash64("id"), F.lit(100)).cast("double"))
    for method in ("kbest", "model", "rfe"):
        got = models.select_features(noisy, "y", ["n", "a", "b"], method, 2)
        assert "n" not in got and "a" in got


def test_build_with_missing_values(data):
    holes = data.withColumn("a", F.when(F.col("id") % 9 == 0, None).otherwise(F.col("a")))
    for encoding, selection in (("onehot", None), ("label", "kbest"), ("frequency", "pca"), ("target", None)):
        target = "d"
        m, scores, steps = automl.build(
            holes, target, ["a", "b", "t"], "Logistic Regression", ["id"], imputation="median",
            encoding=encoding, selection=selection, n_features=2,
        )
        assert scores["accuracy"] > 0.7
        assert [r["kind"] for r in steps.orderBy("step").collect()][:3] == ["split", "impute", "encode"]


def test_search_and_experiment(spark, data):
    best, tried = automl.search(
        data, "d", ["a", "b"], "Decision Tree", ["id"], {"max_depth": [1, 5]}, folds=2
    )
    assert best == {"max_depth": 5} and len(tried) == 2
    found = automl.run(
        data.select("id", "a", "b", "y"), "y", ["id"], scalings=["none"],
        algorithms=["Linear Regression", "No Such", "Lasso Regression"],
        grids={"Lasso Regression": {"alpha": [0.1, 5.0]}}, folds=2,
    )
    board = found.leaderboard(spark).orderBy("rank").collect()
    assert [r["algorithm"] for r in board] == ["Linear Regression", "Lasso Regression"]
    assert found.best.algorithm == "Linear Regression" and any("failed" in s for s in found.log)


def test_grid_sizes():
    grid = {"a": [1, 2, 3], "b": [1, 2]}
    assert len(automl.combinations(grid)) == 6
    some = automl.combinations(grid, 4)
    assert len(some) == 4 and some == automl.combinations(grid, 4)


def test_kmeans(spark):
    rng = np.random.default_rng(4)
    rows = [
        (i * 3 + j, float(rng.normal(c, 0.1)), float(rng.normal(-c, 0.1)))
        for i in range(50) for j, c in enumerate((0, 5, 10))
    ]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    centres, cost = cluster.fit_kmeans(df, ["x", "y"], 3, 4)
    assert cost <= cluster.fit_kmeans(df, ["x", "y"], 3, 1)[1] + 1e-9
    assert sorted(round(c[0]) for c in centres) == [0, 5, 10]
    got = cluster.cluster(df, ["x", "y"], 3, 4)
    assert sorted(r["rows"] for r in cluster.sizes(got).collect()) == [50, 50, 50]


def test_votes(spark):
    df = spark.createDataFrame([("a", "b", "c"), ("c", "c", "a")], "x string, y string, z string")
    cols = [F.col(c) for c in "xyz"]
    got = df.select(ensemble.hard_vote(cols, ["a", "b", "c"]).alias("v")).collect()
    assert [r["v"] for r in got] == ["a", "c"]
    with pytest.raises(ValueError):
        ensemble.weighted_mean(cols, [0, 0, 0])
    assert ensemble.score_weights([0.5, -1, 1.5]) == [0.25, 0.0, 0.75]


def test_ensembles(data):
    bases = [
        models.fit(data, "c", ["a", "b"], a, params=p)
        for a, p in (TREE, ("Naive Bayes", {}), ("Logistic Regression", {}))
    ]
    for kind in ("hard", "soft"):
        team = ensemble.voting(bases, kind, [1, 1, 2])
        report = {r["model"]: r for r in ensemble.evaluate(team, data).collect()}
        assert len(report) == 4 and report["ensemble"]["accuracy"] > 0.85
        assert report["ensemble"]["improvement"] == pytest.approx(
            report["ensemble"]["accuracy"] - max(r["accuracy"] for n, r in report.items() if n != "ensemble")
        )
    bag = ensemble.bagging(data, "y", ["a", "b"], TREE[0], ["id"], 3, 0.5, params=TREE[1])
    assert accuracy(bag, data) > 0.7


def test_stacking(data):
    stack, held = ensemble.stacking(
        data, "c", ["a", "b"], [TREE, ("Naive Bayes", {})], ("Logistic Regression", {}), ["id"], 3
    )
    assert held.count() == 1500 and held.select("id").distinct().count() == 1500
    assert accuracy(stack, data) > 0.85
    assert ensemble.meta_summary(held).count() == 6


def test_chain_flows(data):
    first = models.fit(data, "y", ["a", "b"], "Linear Regression")
    fed = ensemble.chain(data, [first])
    second = models.fit(fed, "c", ["prev_prediction", "a"], TREE[0], params=TREE[1])
    done = ensemble.chain(data, [first, second])
    assert {"step_1", "step_2", "prev_prediction"} <= set(done.columns) and done.count() == 1500
    again = ensemble.chain(data, [first, second], "custom", [[], ["a"]], positional=True)
    assert again.select("id", "step_2").exceptAll(done.select("id", "step_2")).count() == 0
    alone = ensemble.chain(data, [first, second], "prediction_only")
    assert alone.count() == 1500 and set(data.columns) <= set(alone.columns)
    assert alone.select("id", "a").exceptAll(data.select("id", "a")).count() == 0
    assert ensemble.chain_report(done, 2).count() == 2
    with pytest.raises(ValueError):
        ensemble.chain(data, [second, first])


def test_metrics_agree_with_spark(data):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator

    m = models.fit(data, "d", ["a"], "Logistic Regression")
    scored = models.predict(m, data)
    pairs = scored.select(
        F.col("d").cast("double").alias("label"), F.col("Predicted_d").cast("double").alias("prediction"),
        F.col("Probability_1").alias("rawPrediction"),
    )
    got = metrics.classification_scores(scored, "d", "Predicted_d").first()
    for mine, theirs in (("accuracy", "accuracy"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1")):
        assert got[mine] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(pairs))
    curve = metrics.roc_curve(scored, F.col("d") == 1, "Probability_1")
    assert metrics.auc(curve).first()["auc"] == pytest.approx(
        BinaryClassificationEvaluator(numBins=0).evaluate(pairs)
    )


def _series(spark, n, noise=0.0, name="s", slope=0.5):
    rng = np.random.default_rng(1)
    rows = [
        (name, i, 100 + slope * i + 10 * np.sin(2 * np.pi * (i + 4) / 7) + float(noise * rng.normal()))
        for i in range(n)
    ]
    df = spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "k string, i int, y double")
    start = F.lit("2023-01-01").cast("date")
    return df.withColumn("ds", F.date_add(start, F.col("i")).cast("timestamp_ntz"))


def test_forecast_recovers_trend_and_week(spark):
    df = _series(spark, 200)
    got = forecast.forecast(df, "ds", "y", 14, "D", yearly=False).filter("part = 'future'").orderBy("ds")
    want = [100 + 0.5 * i + 10 * np.sin(2 * np.pi * (i + 4) / 7) for i in range(200, 214)]
    np.testing.assert_allclose([r["yhat"] for r in got.collect()], want, rtol=0.02)


def test_forecast_of_many_series_equals_each_alone(spark, large_paths):
    both = _series(spark, 120, 2.0, "p").unionByName(_series(spark, 80, 1.0, "q", -0.3))
    got = forecast.forecast(both, "ds", "y", 5, "D", "k", components=True)
    for name in "pq":
        alone = forecast.forecast(both.filter(F.col("k") == name), "ds", "y", 5, "D")
        a = [r["yhat"] for r in got.filter(F.col("series") == name).orderBy("ds").collect()]
        np.testing.assert_allclose(a, [r["yhat"] for r in alone.orderBy("ds").collect()], rtol=1e-6)
    parts = got.withColumn("sum", F.col("trend") + F.col("yearly") + F.col("weekly"))
    assert parts.filter(F.abs(F.col("sum") - F.col("yhat")) > 1e-6).count() == 0
    assert got.filter("yhat_lower > yhat or yhat_upper < yhat").count() == 0
    trends = {r["series"]: r["trend"] for r in forecast.summary(got).collect()}
    assert trends["p"] == "up" and trends["q"] == "down"


def test_forecast_interval_covers_most(spark):
    df = _series(spark, 300, 3.0)
    past = forecast.forecast(df, "ds", "y", 1, "D", yearly=False).filter("part = 'history'")
    both = past.join(df.select("ds", "y"), "ds")
    inside = both.filter("y between yhat_lower and yhat_upper").count()
    assert abs(inside / 300 - 0.8) < 0.03


def test_forecast_needs_ten_rows(spark):
    with pytest.raises(ValueError, match="At least 10"):
        forecast.fit(_series(spark, 9), "ds", "y")
    with pytest.raises(ValueError):
        forecast.future(_series(spark, 20).withColumn("series", F.lit("a")), 400)


def test_fitted_operators_run_on_a_stream(spark, data, tmp_path):
    data.select("id", "a", "b", "c").coalesce(2).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    tree = models.fit(batch, "c", ["a", "b"], TREE[0], params=TREE[1])
    scale = numeric.fit(batch, "a", "standard")
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    out = models.predict(tree, stream.withColumn("z", numeric.expression("a", "standard", scale)))
    out = cluster.assign(out, ["a", "b"], [[0.0, 0.0], [1.0, 1.0]])
    run = out.select("id", "z", "Predicted_c", "Predicted_Cluster").writeStream.format("memory").queryName("scored").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    want = models.predict(tree, batch).select("id", "Predicted_c")
    assert spark.table("scored").select("id", "Predicted_c").exceptAll(want).count() == 0
    assert spark.table("scored").count() == 1500

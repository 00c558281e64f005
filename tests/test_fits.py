"""Networks, tubes, softmax boosting and support vector probabilities against closed forms and held-out rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import boosting, gradients, models


@pytest.fixture(scope="module")
def curve(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(-3, 3, (2, 3000))
    y = 500 + 100 * np.sin(a) + 30 * a * b
    rows = [(i, 1000 * float(a[i]), float(b[i]), float(y[i])) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, a double, b double, y double").persist()


def test_network_recovers_a_curve_on_unseen_rows(curve, spark, tmp_path):
    seen, unseen = curve.where("id % 3 > 0"), curve.where("id % 3 = 0")
    m = models.fit(seen, "y", ["a", "b"], "Neural Network", problem="regression", params={"hidden": 30, "max_iter": 300})
    assert models.evaluate(m, unseen)["r2"] > 0.95
    registry = models.Registry(spark, str(tmp_path))
    registry.save(m)
    again = models.predict(registry.load(m.model_id), unseen).select("id", "Predicted_y")
    assert again.exceptAll(models.predict(m, unseen).select("id", "Predicted_y")).count() == 0


def test_network_gradient_is_that_of_its_loss():
    rng = np.random.default_rng(2)
    x, y, hidden = rng.normal(size=(7, 3)), rng.normal(size=7), 4
    w = rng.normal(size=hidden * 4 + hidden + 1)
    _, gradient = gradients._network(w, x, y, hidden)
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-6
        up, down = gradients._network(w + step, x, y, hidden)[0], gradients._network(w - step, x, y, hidden)[0]
        assert (up - down) / 2e-6 == pytest.approx(gradient[i], rel=1e-4, abs=1e-6)


def test_sums_do_not_depend_on_tasks(curve, monkeypatch):
    fits = []
    for parts in (1, 7):
        monkeypatch.setattr(gradients, "DIRECT", 2)
        rows = curve.repartition(parts)
        stage = gradients.tube(rows, ["b"], "y", "p", c=1.0, epsilon=50.0, steps=50)
        got = stage.transform(curve).select("id", "p").orderBy("id").toPandas()["p"].to_numpy()
        fits.append(got)
    np.testing.assert_allclose(fits[0], fits[1], rtol=1e-3)


def test_errors_inside_the_tube_cost_nothing():
    x, y = np.arange(5.0)[:, None], np.arange(5.0) + np.array([0.09, -0.09, 0, 0.05, -0.1])
    value, gradient = gradients._tube(np.array([1.0, 0.0]), x, y, 0.1, 0.01)
    assert value == pytest.approx(0) and gradient == pytest.approx(0)
    assert gradients._tube(np.array([1.0, 0.3]), x, y, 0.1, 0.01)[0] > 0


def test_tube_of_a_line_is_as_flat_as_allowed(spark):
    """On an exact line the least slope keeps the ends just inside the tube."""
    rows = spark.createDataFrame([(float(i), 3.0 * i + 7) for i in range(11)], "x double, y double")
    m = models.fit(rows, "y", ["x"], "Support Vector Regression", problem="regression", params={"kernel": "linear", "C": 100.0, "epsilon": 0.5})
    got = models.predict(m, rows).orderBy("x").toPandas()
    slope = (30 - 2 * 0.5) / 10
    np.testing.assert_allclose(np.diff(got["Predicted_y"]), slope, atol=2e-3)
    assert (got["Predicted_y"] - got["y"]).abs().max() == pytest.approx(0.5, abs=5e-3)


def softmax_by_hand(share, rounds, rate):
    """Scores of the classes for a yes-or-no feature: ``share`` holds counts per (value, class)."""
    total = share.sum()
    k = share.shape[1]
    scores = np.log(share.sum(0) / total) * np.ones((2, 1))
    for _ in range(rounds):
        p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        up = share - share.sum(1, keepdims=True) * p
        down = share * (1 - p) * p + (share.sum(1, keepdims=True) - share) * p * (1 - p)
        scores = scores + rate * (k - 1) / k * up / down
    return np.exp(scores) / np.exp(scores).sum(1, keepdims=True)


def test_softmax_boosting_equals_a_closed_form(spark, monkeypatch):
    monkeypatch.setattr(boosting, "WRITTEN_EVERY", 2)
    share = np.array([[30, 10, 5], [5, 20, 40]])
    rows = [(v, "abc"[c]) for v in range(2) for c in range(3) for _ in range(share[v, c])]
    df = spark.createDataFrame(rows, "x int, c string")
    m = models.fit(df, "c", ["x"], "Gradient Boosting", params={"n_estimators": 5, "max_depth": 1, "learning_rate": 0.3})
    got = models.predict(m, df.distinct()).select("x", "Probability_a", "Probability_b", "Probability_c", "Predicted_c").distinct()
    want = softmax_by_hand(share, 5, 0.3)
    for r in got.collect():
        np.testing.assert_allclose(list(r)[1:4], want[r["x"]], rtol=1e-6)
        assert r["Predicted_c"] == "abc"[int(want[r["x"]].argmax())]


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(5)
    centre = np.array([[0, 0], [4, 0], [0, 4]])
    rows = [(i, *map(float, rng.normal(centre[i % 3], 1.0)), "pqr"[i % 3], int(i % 3 == 1)) for i in range(1500)]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, d int").persist()


@pytest.mark.parametrize("target, kernel", [("c", "linear"), ("d", "linear"), ("d", "rbf")])
def test_support_vectors_know_how_sure_they_are(clouds, target, kernel):
    seen, unseen = clouds.where("id % 4 > 0"), clouds.where("id % 4 = 0")
    m = models.fit(seen, target, ["a", "b"], "Support Vector Machine", params={"kernel": kernel, "max_iter": 50, "C": 10.0}, scaling="standard")
    got = models.predict(m, unseen).toPandas()
    names = [f"Probability_{c}" for c in m.classes]
    p = got[names].to_numpy()
    assert ((p >= 0) & (p <= 1)).all()
    np.testing.assert_allclose(p.sum(1), 1)
    right = (got[f"Predicted_{target}"] == got[target]).mean()
    assert right > 0.93
    truth = np.stack([(got[target] == c).to_numpy(float) for c in m.classes], axis=1)
    assert abs(p.max(1).mean() - right) < 0.05  # sure as often as right
    assert -np.log(np.maximum((p * truth).sum(1), 1e-9)).mean() < 0.25


def test_support_vectors_on_components(clouds):
    m = models.fit(clouds, "c", ["a", "b"], "Support Vector Machine", params={"kernel": "linear", "max_iter": 30}, scaling="standard", extra_stages=[models.components_stage(2)])
    assert models.evaluate(m, clouds)["accuracy"] > 0.9


def test_large_scores_keep_finite_probabilities(spark):
    row = spark.range(1).selectExpr(f"{boosting.probabilities(['800D', '-800D', '799D'])} as p").first()["p"]
    assert math.isclose(sum(row), 1) and row[0] == pytest.approx(1 / (1 + math.exp(-1)))
    assert F is not None


def test_passes_follow_rows_and_halves_share_one(spark, monkeypatch):
    """Tasks follow the number of rows, not of blocks, and failed lengths of a step do not take a pass each."""
    monkeypatch.setattr(gradients, "PASS_ROWS", 500)
    seen = []
    monkeypatch.setattr(gradients, "_added", lambda sums, real=gradients._added: (seen.append(sums.getNumPartitions()), real(sums))[1])
    rows = spark.range(0, 4000, 1, 2).selectExpr("cast(id % 50 as double) as x", "3D * (id % 50) + 7 as y")
    stage = gradients.tube(rows, ["x"], "y", "p", c=1.0, epsilon=5.0)
    cores = spark.sparkContext.defaultParallelism
    assert set(seen) == {cores * math.ceil(8 / cores)} and len(seen) < 200
    slope = stage.transform(spark.createDataFrame([(0.0,), (1.0,)], "x double")).toPandas()["p"].diff().iloc[1]
    assert slope == pytest.approx(3 - 10 / 49, abs=2e-3)


def test_boosting_takes_a_pass_a_level_and_splits_like_a_tree(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(boosting, "_added", lambda sums, real=gradients._added: (passes.append(1), real(sums))[1], raising=False)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 2)), 1)
    y = rng.integers(0, 3, 600) * (x[:, 0] > 0.3)
    rows = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double").coalesce(2)
    stages = boosting.softmax(rows, ["a", "b"], "y", 3, "p", "q", rounds=1, depth=3)
    assert len(passes) == 3
    first = (y == 0).mean()
    residual = rows.withColumn("r", F.col("y").eqNullSafe(0.0).cast("double") - first)
    data = boosting.MF.VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(residual)
    from pyspark.ml.regression import DecisionTreeRegressor

    want = DecisionTreeRegressor(featuresCol="v", labelCol="r", maxDepth=3, predictionCol="leaf").fit(data).transform(data)
    got = stages[0].transform(want).select("leaf", "_s0").distinct().toPandas()
    assert len(got) == got["leaf"].nunique() > 4


def test_cosine_columns_are_made_in_the_tasks(clouds, monkeypatch):
    """What is kept for the passes are the inputs, not the columns of the kernel, and blocks come one by one."""
    kept = []
    real = gradients._sum

    def summed(blocks, loss, weights, lift=None):
        y, x = blocks.first()
        kept.append((lift, len(x) // len(y)))
        return real(blocks, loss, weights, lift)

    monkeypatch.setattr(gradients, "_sum", summed)
    m = models.fit(clouds, "a", ["a", "b"], "Support Vector Regression", problem="regression", params={"max_iter": 20}, scaling="standard")
    assert kept and all(lift is not None and columns == 2 for lift, columns in kept)
    assert models.evaluate(m, clouds)["r2"] > 0.9
    x = np.random.default_rng(0).normal(size=(500, 3)) * 50
    waves = gradients.Waves(["a", "b", "c"], x[:64], x[64:128, 0], 0.25)
    np.testing.assert_allclose(waves(x), 0.25 * np.cos(x @ x[:64].T + x[64:128, 0]), atol=1e-11)


def test_hinge_fits_take_few_passes(clouds, monkeypatch):
    """Folds share the passes of the whole model, and hundreds of steps are not needed."""
    passes = []
    monkeypatch.setattr(gradients, "_added", lambda sums, real=gradients._added: (passes.append(1), real(sums))[1])
    m = models.fit(clouds, "d", ["a", "b"], "Support Vector Machine", params={"kernel": "linear", "C": 1.0}, scaling="standard")
    assert 3 < len(passes) < 400
    assert models.evaluate(m, clouds)["accuracy"] > 0.95

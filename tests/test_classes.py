"""Models that did not see every class still number the classes alike."""

import pytest
from pyspark.sql import functions as F

from tidepool.operators import anomaly, automl, cluster, ensemble, models, sampling


@pytest.fixture(scope="module")
def rows(spark):
    cls = F.when(F.col("x") < 100, "a").when(F.col("x") < 200, "b").otherwise("c")
    return spark.range(300).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x")).withColumn("y", cls).cache()


@pytest.mark.parametrize("algorithm", ["Decision Tree", "Logistic Regression", "Naive Bayes"])
def test_votes_keep_classes(rows, algorithm):
    all_ = ["a", "b", "c"]
    parts = [rows, rows.filter("y <> 'b'"), rows.filter("y <> 'b'")]
    members = [models.fit(p, "y", ["x"], algorithm, "classification", classes=all_) for p in parts]
    # The last class is missing too: probabilities must still have three places.
    few = models.fit(rows.filter("y <> 'c'"), "y", ["x"], algorithm, "classification", classes=all_)
    assert few.score(rows).select(F.size("_probability")).distinct().first()[0] == 3
    for kind in ("hard", "soft"):
        got = models.predict(ensemble.voting(members, kind), rows)
        wrong = got.filter("y = 'c' and x > 250 and Predicted_y = 'b'").count()
        assert wrong == 0
    alone = models.fit(parts[1], "y", ["x"], algorithm, "classification")
    with pytest.raises(ValueError):
        ensemble.voting([members[0], alone])


def test_rare_class_out_of_fold(rows):
    rare = rows.withColumn("y", F.when(F.col("k") == 7, "b").when(F.col("x") < 150, "a").otherwise("c"))
    held = ensemble.out_of_fold(rare, "y", ["x"], [("Decision Tree", {}), ("Naive Bayes", {})], ["k"], 3, "classification")
    assert held.count() == 300
    assert [c for c in held.columns if c.startswith("meta_")] == [f"meta_{i}_{j}" for i in range(2) for j in range(3)]
    scores = models.cross_validate(rare, "y", ["x"], "Decision Tree", ["k"], 3, problem="classification")
    assert min(scores) > 0.95


def test_folds_hold_every_class(rows):
    dealt = sampling.folds(rows, 5, ["k"], label="y").groupBy("fold", "y").count()
    assert {r["count"] for r in dealt.collect()} == {20}


def test_depth_is_not_cut(rows):
    with pytest.raises(ValueError):
        models.fit(rows, "y", ["x"], "Decision Tree", "classification", {"max_depth": 40})


def test_sample_is_used_as_asked(spark, rows):
    big = spark.range(5000).select("id", F.randn(1).alias("v"))
    got = anomaly._samples(big, ["id"], 20, 2048, 5000, 3).groupBy("_tree").count().collect()
    assert len(got) == 20 and {r["count"] for r in got} == {2048}
    few = anomaly._samples(big, ["id"], 3, 64, 5000, 3)
    assert {r["count"] for r in few.groupBy("_tree").count().collect()} == {64}
    assert few.groupBy("_tree", "id").count().filter("count > 1").count() == 0


def test_bootstrap_has_no_cap(spark):
    got = sampling.bootstrap(spark.range(200_000), ["id"])
    n = got.groupBy("id").count().agg(F.max("count"), F.sum("count")).first()
    assert 6 <= n[0] and abs(n[1] - 200_000) < 2_500


def test_ensembles_are_saved_and_compared(spark, rows, tmp_path):
    parts = [models.fit(rows, "y", ["x"], a, "classification") for a in ("Decision Tree", "Naive Bayes")]
    few = models.fit(rows.filter("y <> 'b'"), "y", ["x"], "Decision Tree", "classification", classes=["a", "b", "c"])
    vote = ensemble.voting([*parts, few], "soft", [2, 1, 1])
    stack, _ = ensemble.stacking(rows, "y", ["x"], [("Decision Tree", {}), ("Naive Bayes", {})], ("Decision Tree", {}), ["k"], 3)
    registry = models.Registry(spark, str(tmp_path))
    for made in (vote, stack, few):
        again = registry.load(registry.save(made))
        want = models.predict(made, rows).select("k", "Predicted_y").collect()
        assert models.predict(again, rows).select("k", "Predicted_y").collect() == want
    got = models.compare([*parts, vote, stack], rows).collect()
    assert [r["accuracy"] for r in got] == sorted((r["accuracy"] for r in got), reverse=True) and len(got) == 4


def test_clusters_feed_a_model(spark, rows):
    groups = cluster.Clusters.fit(rows, ["x"], 3)
    numbered = groups.score(rows).withColumnRenamed("_prediction", "prev_prediction")
    model = models.fit(numbered, "y", ["prev_prediction"], "Decision Tree", "classification")
    done = ensemble.chain(rows, [groups, model])
    assert {"step_1", "step_2"} <= set(done.columns) and done.count() == 300


@pytest.mark.parametrize("encoding", automl.ENCODINGS)
def test_built_model_predicts_raw_rows(spark, tmp_path, encoding):
    raw = spark.range(400).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 7).cast("double").alias("n"),
        F.when(F.col("id") % 50 == 7, None).when(F.col("id") % 3 == 0, "u").otherwise("v").alias("t"),
        (F.col("id") % 3 == 0).cast("int").alias("y"),
    )
    built, scores, _ = automl.build(raw, "y", ["n", "t"], "Decision Tree", ["k"], encoding=encoding)
    assert scores["accuracy"] > 0.9
    new = spark.createDataFrame([(1, None, "u"), (2, 3.0, "unseen"), (3, 1.0, None)], "k int, n double, t string")
    got = models.predict(built, new)
    assert got.count() == 3 and {"k", "n", "t", "Predicted_y"} <= set(got.columns)
    assert [tuple(r) for r in got.select("k", "n", "t").orderBy("k").collect()] == [(1, None, "u"), (2, 3.0, "unseen"), (3, 1.0, None)]
    registry = models.Registry(spark, str(tmp_path))
    again = registry.load(registry.save(built))
    want = got.orderBy("k").select("Predicted_y").collect()
    assert models.predict(again, new).orderBy("k").select("Predicted_y").collect() == want

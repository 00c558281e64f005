import itertools
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepool.operators import anomaly, mining, neighbors


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        # One transaction holds a third of the rows; items repeat.
        tx = 0 if i % 3 == 0 else rng.randrange(1, 60)
        rows.append((tx, f"i{min(rng.randrange(12), rng.randrange(12)):02d}"))
    return spark.createDataFrame(rows, "tx long, item string")


def sets_of(lines):
    got = {}
    for tx, item in lines.collect():
        got.setdefault(tx, set()).add(item)
    return got


@pytest.mark.parametrize("large", [False, True])
def test_itemsets_equal_brute_force(spark, lines, large, request):
    if large:
        request.getfixturevalue("large_paths")
    sets = sets_of(lines)
    want = {}
    names = sorted({i for s in sets.values() for i in s})
    for size in range(1, 6):
        for c in itertools.combinations(names, size):
            n = sum(1 for s in sets.values() if s.issuperset(c))
            if n / len(sets) >= 0.2:
                want[c] = n
    got = mining.frequent_itemsets(mining.pairs(lines, "tx", "item"), 0.2)
    assert {tuple(r["items"]): r["count"] for r in got.collect()} == want


def test_rules_have_every_split(spark):
    sets = spark.createDataFrame(
        [(["a"], 1, 0.6), (["b"], 1, 0.5), (["c"], 1, 0.4), (["a", "b"], 2, 0.4),
         (["a", "c"], 2, 0.3), (["b", "c"], 2, 0.2), (["a", "b", "c"], 3, 0.2)],
        "items array<string>, length int, support double",
    )
    got = mining.association_rules(sets, "support", 0.0, 3).collect()
    assert len(got) == 3 * 2 + 6
    rule = next(r for r in got if r["antecedent"] == ["c"] and r["consequent"] == ["a", "b"])
    assert rule["confidence"] == pytest.approx(0.5)
    assert rule["lift"] == pytest.approx(1.25)
    assert rule["leverage"] == pytest.approx(0.04)
    assert rule["conviction"] == pytest.approx(1.2)
    sure = next(r for r in got if r["antecedent"] == ["b", "c"])
    assert sure["conviction"] == math.inf
    assert len(mining.association_rules(sets, "confidence", 0.99, 3).collect()) == 1
    assert all(len(r["antecedent"]) == 1 for r in mining.association_rules(sets, "support", 0, 2).collect())


@pytest.mark.parametrize("least", [0.1, 0.2, 1 / 3, 0.07, 1.0])
@pytest.mark.parametrize("n", [10, 30, 7, 100])
def test_least_count(least, n):
    c = mining.least_count(least, n)
    assert c / n >= least and (c == 1 or (c - 1) / n < least)


@pytest.mark.parametrize("tile", [2_048, 5])
def test_shared_context_equals_brute_force(spark, lines, tile, monkeypatch):
    monkeypatch.setattr(mining, "TILE", tile)
    want = Counter()
    for s in sets_of(lines).values():
        want.update(itertools.combinations(sorted(s), 2))
    want = {k: v for k, v in want.items() if v >= 3}
    got = mining.shared_context(lines, "tx", "item", 3)
    assert {(r["item1"], r["item2"]): r["count"] for r in got.collect()} == want


@pytest.mark.parametrize("dense", [0, 10**9])
def test_products_of_a_hot_context(spark, dense, monkeypatch):
    monkeypatch.setattr(mining, "TILE", 16)
    monkeypatch.setattr(mining, "CHUNK_ROWS", 7)
    monkeypatch.setattr(mining, "DENSE_PAIRS", dense)
    rng = random.Random(3)
    rows = [("hot", f"i{i:03d}") for i in range(100)] + [(f"t{rng.randrange(60)}", f"i{rng.randrange(100):03d}") for _ in range(900)]
    sets = {}
    for t, i in rows:
        sets.setdefault(t, set()).add(i)
    want = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    df = spark.createDataFrame(rows, "tx string, item string")
    got = mining.shared_context(df, "tx", "item", 1)
    assert {(r["item1"], r["item2"]): r["count"] for r in got.collect()} == want
    assert mining.shared_context(df.filter("false"), "tx", "item").count() == 0


def test_plan_of_products_does_not_grow(spark, lines, monkeypatch):
    sizes = []
    for tile in (2_048, 2):
        monkeypatch.setattr(mining, "TILE", tile)
        got = mining.shared_context(lines, "tx", "item", 1)
        sizes.append(len(got._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert sizes[0] == sizes[1]


@pytest.mark.parametrize("large", [False, True])
def test_whole_baskets_in_chunks(spark, large, request):
    if large:
        request.getfixturevalue("large_paths")
    rows = [("hot", f"i{i}") for i in range(500)] + [(f"t{i % 40}", f"i{i}") for i in range(400)]
    df = mining.pairs(spark.createDataFrame([*rows, *rows[:50], (None, "x"), ("t0", None)], "tx string, item string"), "tx", "item")
    got = mining.basket_chunks(df, 20).collect()
    assert Counter((r["tx"], i) for r in got for i in r["items"]) == Counter(rows)
    assert all(r["items"] == sorted(r["items"]) and r["chunk"] < r["chunks"] for r in got)
    assert {r["chunks"] for r in got if r["tx"] != "hot"} == {1} and {r["chunks"] for r in got if r["tx"] == "hot"} == {25}
    assert max(len(r["items"]) for r in got) < 60


@pytest.mark.parametrize("large", [False, True])
def test_sequences_with_a_hot_key(spark, large, request):
    if large:
        request.getfixturevalue("large_paths")
    rng = random.Random(5)
    rows = [
        (i, 0 if i % 3 == 0 else rng.randrange(1, 40), rng.randrange(50), rng.choice("abc"))
        for i in range(400)
    ] + [(1000, 999, 1, "a")]
    df = spark.createDataFrame(rows, "id long, k long, s long, e string")
    df = df.withColumn("t", F.timestamp_seconds("s").cast("timestamp_ntz"))
    runs = {}
    for i, k, s, e in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        runs.setdefault(k, []).append((i, e))
    want = Counter()
    for run in runs.values():
        for n in (2, 3, 4):
            want.update(tuple(e for _, e in run[j : j + n]) for j in range(len(run) - n + 1))
    want = {k: v for k, v in want.items() if v >= 2}
    got = mining.sequential_patterns(df, "k", "t", "e", ["id"], 2, 4, 2)
    assert {tuple(r["pattern"]): r["count"] for r in got.collect()} == want
    seq = mining.sequences(df, "k", "t", "id", ["id"]).collect()
    assert sorted((r["k"], r["place"], r["id"]) for r in seq) == sorted(
        (k, j, i) for k, run in runs.items() if len(run) > 1 for j, (i, _) in enumerate(run)
    )


@pytest.fixture(scope="module")
def points(spark):
    """A third of the points are copies of one; some lie on a grid."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        if i % 3 == 0:
            v = [1.0, 1.0, 1.0]
        elif i % 3 == 1:
            v = [float(x) for x in rng.integers(0, 4, 3)]
        else:
            v = [float(x) for x in rng.normal(0, 2, 3)]
        rows.append((i * 7, v))
    return spark.createDataFrame(rows, "id long, vec array<double>").repartition(5)


def brute_neighbors(points, k):
    rows = sorted((r["id"], tuple(r["vec"])) for r in points.collect())
    out = {}
    for i, a in rows:
        near = sorted(
            (float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())), j) for j, b in rows if j != i
        )
        out[i] = near[:k]
    return out


@pytest.mark.parametrize("large", [False, True])
def test_neighbor_table_is_exact(spark, points, large, request):
    if large:
        request.getfixturevalue("large_paths")
    want = brute_neighbors(points, 4)
    got = {}
    for r in neighbors.neighbor_table(points, 4).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["distance"], r["neighbor"]))
    assert got.keys() == want.keys()
    for i in want:
        assert [n for _, n in got[i]] == [n for _, n in want[i]]
        np.testing.assert_allclose([d for d, _ in got[i]], [d for d, _ in want[i]])


@pytest.mark.parametrize("large", [False, True])
def test_local_outlier_factor(spark, points, large, request):
    if large:
        request.getfixturevalue("large_paths")
    k = 5
    near = brute_neighbors(points, k)
    kd = {i: n[-1][0] for i, n in near.items()}
    lrd = {
        i: 1 / (np.mean([max(d, kd[j]) for d, j in n]) + 1e-10) for i, n in near.items()
    }
    want = {i: -np.mean([lrd[j] for _, j in n]) / lrd[i] for i, n in near.items()}
    got = anomaly.local_outliers(points, [], ["id"], k, 0.1, vector=F.col("vec")).collect()
    np.testing.assert_allclose(
        [r["anomaly_score"] for r in got], [want[r["id"]] for r in got], rtol=1e-6
    )
    assert 0 < sum(r["is_anomaly"] for r in got) <= 24


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_neighbor_model_both_ways(spark, points, weights, large_paths):
    from tidepool.operators import models

    df = points.select(
        "id", *[F.col("vec")[i].alias(f"x{i}") for i in range(3)],
        (F.col("vec")[0] > 1).cast("int").alias("y"), (F.col("vec")[0] * 2).alias("z"),
    )
    names = ["x0", "x1", "x2"]
    params = {"weights": weights, "n_neighbors": 3}
    for target in ("y", "z"):
        problem = "classification" if target == "y" else "regression"
        m = models.fit(
            df, target, names, "K-Nearest Neighbors", problem=problem, params=params,
            keys=["id"], scaling="standard",
        )
        spark.conf.set("tidepool.pointBytes", "0")
        large = models.predict(m, df).toPandas().sort_values("id")
        spark.conf.unset("tidepool.pointBytes")
        small = models.predict(m, df).toPandas().sort_values("id")
        np.testing.assert_allclose(
            large[f"Predicted_{target}"].to_numpy(float), small[f"Predicted_{target}"].to_numpy(float)
        )


def test_isolation_forest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (2000, 2)))]
    rows += [(5000 + i, 12.0 + i, -11.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    forest, scored = anomaly.fit_isolation_forest(df, ["a", "b"], ["id"], 60, contamination=0.05)
    assert len(forest.trees) == 60 and forest.sample == 256
    got = scored.toPandas()
    assert abs(got["is_anomaly"].mean() - 0.05) < 0.01
    assert got["anomaly_score"].between(-1, 0).all()
    assert set(got.nsmallest(5, "anomaly_score")["id"]) == {5000 + i for i in range(5)}
    _, again = anomaly.fit_isolation_forest(df.repartition(3), ["a", "b"], ["id"], 60, contamination=0.05)
    pd.testing.assert_series_equal(
        again.toPandas().sort_values("id")["anomaly_score"].reset_index(drop=True),
        got.sort_values("id")["anomaly_score"].reset_index(drop=True),
    )
    fresh = spark.createDataFrame([(1, 50.0, 50.0), (2, 0.0, 0.0)], "id long, a double, b double")
    assert [r["is_anomaly"] for r in forest.detect(fresh).orderBy("id").collect()] == [True, False]


def test_isolation_samples_are_full_and_without_repeats(spark):
    df = spark.range(40_000).withColumn("a", F.col("id").cast("double"))
    for trees, size in ((20, 256), (200, 512)):
        drawn = anomaly._samples(df, ["id"], trees, size, 40_000, 1)
        counts = drawn.groupBy("_tree").agg(F.count(F.lit(1)), F.countDistinct("id")).collect()
        assert len(counts) == trees and all(r[1] == r[2] == size for r in counts)


def test_anomalies_need_rows_and_features(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "id long, a double, b double")
    with pytest.raises(ValueError):
        anomaly.prepared(df, ["a", "b"])
    with pytest.raises(ValueError):
        anomaly.prepared(df, ["a"])


@pytest.mark.parametrize("few", [1, 3, 256])
def test_small_contexts_list_their_pairs(spark, few, monkeypatch):
    """Contexts of few values take no matrix of tiles; both ways count alike."""
    monkeypatch.setattr(mining, "FEW", few)
    monkeypatch.setattr(mining, "CHUNK_PAIRS", 20)
    if few == 256:
        monkeypatch.setattr(mining, "_tile_counts", None)
    baskets = {t: {(t * 7 + i * i) % 11 for i in range(t % 7)} for t in range(60)}
    rows = [(t, str(i)) for t, values in baskets.items() for i in values] + [(None, "1"), (3, None)]
    want = {}
    for values in baskets.values():
        for a in values:
            for b in values:
                if str(a) < str(b):
                    want[str(a), str(b)] = want.get((str(a), str(b)), 0) + 1
    got = mining.shared_context(spark.createDataFrame(rows, "tx long, item string"), "tx", "item", 2)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == {k: n for k, n in want.items() if n >= 2}

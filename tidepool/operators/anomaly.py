"""Anomalies: isolation forest, local outlier factor, and their reports."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.columns import col, require
from tidepool.operators import prepare
from tidepool.operators.filters import complete_rows
from tidepool.operators.lookup import attach
from tidepool.operators.neighbors import neighbor_table, vector_of
from tidepool.operators.ordering import with_position
from tidepool.operators.quantiles import quantiles
from tidepool.operators.sampling import row_hash, uniform
from tidepool.session import checkpoint
from tidepool.sources.files import check_features

MAX_TREES = 500


def prepared(
    df: DataFrame, features: Sequence[str], scale: bool = True
) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(complete rows, scaling): at least 10 rows and 2 numeric features."""
    if len(features) < 2:
        raise ValueError("At least two features")
    require(df, features, "numeric")
    rows = complete_rows(df, features, at_least=10)
    return rows, prepare.fit_scaling(rows, features, "standard" if scale else "none")


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 2.0)
    full = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, full, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """One isolation tree as flat arrays; leaves hold their path length."""
    limit = max(1, math.ceil(math.log2(max(len(points), 2))))
    tree: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": [], "path": []}
    todo = [(np.arange(len(points)), 0, -1, "")]
    while todo:
        rows, depth, parent, side = todo.pop()
        node = len(tree["feature"])
        if parent >= 0:
            tree[side][parent] = node
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        free = np.flatnonzero(high > low)
        leaf = depth >= limit or len(rows) <= 1 or not len(free)
        f = -1 if leaf else int(rng.choice(free))
        cut = 0.0 if leaf else float(rng.uniform(low[f], high[f]))
        tree["feature"].append(f)
        tree["cut"].append(cut)
        tree["left"].append(-1)
        tree["right"].append(-1)
        tree["path"].append(depth + float(mean_path(len(rows))) if leaf else 0.0)
        if not leaf:
            below = points[rows, f] <= cut
            todo.append((rows[~below], depth + 1, node, "right"))
            todo.append((rows[below], depth + 1, node, "left"))
    return tree


@dataclass
class IsolationForest:
    """A fitted forest: small arrays, the scaling, and the score cut."""

    features: list[str]
    scaling: dict[str, tuple[float, float]]
    trees: list[dict[str, np.ndarray]]
    sample: int
    cut: float | None = None

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``anomaly_score``: between −1 and 0, lower is stranger."""
        check_features(df, self.features)
        shared = df.sparkSession.sparkContext.broadcast((self.trees, float(mean_path(self.sample))))

        @F.pandas_udf("double")
        def scores(vectors: pd.Series) -> pd.Series:
            trees, usual = shared.value
            if not len(vectors):
                return pd.Series([], dtype=float)
            points = np.stack(vectors.to_numpy()).astype(float)
            rows = np.arange(len(points))
            total = np.zeros(len(points))
            for t in trees:
                at = np.zeros(len(points), dtype=np.int64)
                active = rows
                while len(active):
                    here = at[active]
                    f = t["feature"][here]
                    inner = f >= 0
                    active, here, f = active[inner], here[inner], f[inner]
                    below = points[active, f] <= t["cut"][here]
                    at[active] = np.where(below, t["left"][here], t["right"][here])
                total += t["path"][at]
            return pd.Series(-np.power(2.0, -(total / len(trees)) / usual))

        known = df.na.drop(subset=self.features)
        return known.withColumn("anomaly_score", scores(vector_of(self.features, self.scaling)))

    def detect(self, df: DataFrame) -> DataFrame:
        """Add the score and ``is_anomaly`` by the fitted cut."""
        return self.score(df).withColumn("is_anomaly", F.col("anomaly_score") < F.lit(self.cut))


def _samples(
    rows: DataFrame, keys: Sequence[str], trees: int, size: int, n: int, seed: int
) -> DataFrame:
    """``size`` rows for each tree, without replacement, by row hash.

    The number of trees that a row enters is drawn first, from the binomial
    distribution, so rows that enter none are dropped before any is copied.
    The share per tree has room for chance.
    """
    share = min(1.0, (size + 6.0 * math.sqrt(size) + 6.0) / n)
    below, cuts = 0.0, []
    for i in range(trees):
        log = math.lgamma(trees + 1) - math.lgamma(i + 1) - math.lgamma(trees - i + 1)
        below += math.exp(log + i * math.log(share) + (trees - i) * math.log1p(-share)) if share < 1 else 0.0
        cuts.append(below)
    u = uniform(keys, seed)
    entered = rows.withColumn("_n", F.size(F.filter(F.lit(cuts), lambda c: u >= c))).filter("_n > 0")
    mixed = lambda t: F.struct(F.xxhash64(*[col(k) for k in keys], F.lit(seed), t).alias("h"), t.alias("t"))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), mixed))
    drawn = entered.withColumn("_in", F.explode(F.slice(order, 1, F.col("_n"))))
    drawn = drawn.withColumn("_tree", F.col("_in.t").cast("int"))
    drawn = drawn.withColumn("_h", F.xxhash64(*[col(k) for k in keys], F.lit(seed + 1), "_tree")).drop("_n", "_in")
    first = Window.partitionBy("_tree").orderBy("_h", *[col(k) for k in keys])
    return drawn.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= size)


def fit_isolation_forest(
    df: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    trees: int = 100,
    sample: int | None = None,
    contamination: float = 0.1,
    scale: bool = True,
    seed: int = 42,
) -> tuple[IsolationForest, DataFrame]:
    """(forest, scored rows). Trees see only their sample; one grows per group,
    and the forest, at most 500 trees of twice ``sample`` nodes, is shared with
    all tasks.
    """
    if not 1 <= trees <= MAX_TREES:
        raise ValueError(f"1 to {MAX_TREES} trees")
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")
    rows, scaling = prepared(df, features, scale)
    n = rows.count()
    size = min(sample or 256, n)
    vector = vector_of(list(features), scaling)
    drawn = _samples(rows.select(*[col(k) for k in dict.fromkeys([*keys, *features])]), keys, trees, size, n, seed)
    drawn = drawn.select("_tree", "_r", vector.alias("vec"))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_r")
        number = int(group["_tree"].iloc[0])
        points = np.stack(group["vec"].to_numpy()).astype(float)
        tree = _grow(points, np.random.default_rng([seed, number]))
        return pd.DataFrame({"tree": [number], **{k: [v] for k, v in tree.items()}})

    grown = drawn.groupBy("_tree").applyInPandas(
        grow,
        "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, "
        "path array<double>",
    )
    forest = [
        {k: np.asarray(r[k]) for k in ("feature", "cut", "left", "right", "path")}
        for r in sorted(grown.collect(), key=lambda r: r["tree"])
    ]
    model = IsolationForest(list(features), scaling, forest, size)
    scored = checkpoint(model.score(rows))
    model.cut = quantiles(scored, ["anomaly_score"], [contamination])["anomaly_score"][0]
    return model, scored.withColumn("is_anomaly", F.col("anomaly_score") < F.lit(model.cut))


def lof_scores(neighbors: DataFrame) -> DataFrame:
    """(id, lof) from a neighbour table.

    Neighbours that many rows share are looked up as hot keys.
    """
    table = checkpoint(neighbors.select("id", "neighbor", "distance"))
    reach = table.groupBy("id").agg(F.max("distance").alias("_kd"))
    used = table.groupBy("neighbor").agg(F.count(F.lit(1)).alias("_used"))

    def of_neighbor(values: DataFrame) -> DataFrame:
        found = values.join(used, values["id"] == used["neighbor"]).drop("id")
        return attach(table, found, ["neighbor"], rows="_used").drop("_used")

    density = (
        of_neighbor(reach)
        .groupBy("id")
        .agg((1 / (F.avg(F.greatest("distance", "_kd")) + F.lit(1e-10))).alias("_lrd"))
    )
    density = checkpoint(density)
    around = of_neighbor(density).groupBy("id").agg(F.avg("_lrd").alias("_mean"))
    return around.join(density, "id").select("id", (F.col("_mean") / F.col("_lrd")).alias("lof"))


def local_outliers(
    df: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    k: int = 20,
    contamination: float = 0.1,
    scale: bool = True,
    vector: Column | None = None,
) -> DataFrame:
    """Add ``anomaly_score`` (−LOF) and ``is_anomaly``; ``keys`` identify rows.

    ``vector`` replaces the features by an array column, taken as it is.
    """
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")
    if vector is None:
        rows, scaling = prepared(df, features, scale)
        vector = vector_of(list(features), scaling)
    else:
        rows = df.filter(vector.isNotNull())
    placed = with_position(rows.withColumn("_vec", vector), keys, "_id")
    n = placed.count()
    if n < 10:
        raise ValueError("At least 10 rows")
    points = placed.select(F.col("_id").alias("id"), F.col("_vec").alias("vec"))
    scores = lof_scores(neighbor_table(points, min(k, n - 1)))
    scores = scores.select(F.col("id").alias("_id"), (-F.col("lof")).alias("anomaly_score"))
    scored = checkpoint(placed.join(scores, "_id").drop("_id", "_vec"))
    cut = quantiles(scored, ["anomaly_score"], [contamination])["anomaly_score"][0]
    return scored.withColumn("is_anomaly", F.col("anomaly_score") < F.lit(cut))


def report(scored: DataFrame, contamination: float) -> DataFrame:
    """Rows, anomalies found, their share, and the expected share."""
    n, found = F.count(F.lit(1)), F.count_if("is_anomaly")
    return scored.agg(
        n.alias("total"),
        found.alias("anomalies"),
        F.round(F.try_divide(found * 100.0, n), 2).cast("double").alias("rate_pct"),
        F.lit(contamination * 100.0).alias("expected_pct"),
    )


def top_anomalies(scored: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """The strangest rows with their values."""
    return (
        scored.filter("is_anomaly").orderBy("anomaly_score", *[col(k) for k in keys]).limit(n)
    )


def feature_shift(scored: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature, how far anomalies lie from normal rows, in deviations."""
    require(scored, features, "numeric")
    wide, cells = [], []
    for i, f in enumerate(features):
        x = col(f).cast("double")
        wide += [
            F.avg(F.when(F.col("is_anomaly"), x)).alias(f"a{i}"),
            F.avg(F.when(~F.col("is_anomaly"), x)).alias(f"n{i}"),
            F.stddev_pop(x).alias(f"s{i}"),
        ]
        gap = F.abs(F.col(f"a{i}") - F.col(f"n{i}"))
        cells.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.coalesce(gap / F.nullif(F.col(f"s{i}"), F.lit(0.0)), F.lit(0.0)).alias(
                    "importance"
                ),
            )
        )
    return scored.agg(*wide).select(F.inline(F.array(*cells)))

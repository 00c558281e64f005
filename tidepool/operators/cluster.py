"""K-Means clusters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.columns import col, require
from tidepool.session import cached, in_parallel
from tidepool.sources.files import check_features


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    cast = {f"_f{i}": col(f).cast("double") for i, f in enumerate(features)}
    return VectorAssembler(inputCols=list(cast), outputCol="_features").transform(
        df.withColumns(cast)
    ).drop(*cast)


def fit_kmeans(
    df: DataFrame, features: Sequence[str], k: int = 3, starts: int = 10, seed: int = 42
) -> tuple[list[list[float]], float]:
    """(centres, cost) of the best of several starts; incomplete rows left out."""
    if not 2 <= k <= 10:
        raise ValueError("2 to 10 clusters")
    require(df, features, "numeric")
    vectors = _vectors(df.na.drop(subset=list(features)), features).select("_features")
    with cached(vectors) as rows:
        def one(start: int) -> KMeansModel:
            return KMeans(k=k, seed=seed + start, featuresCol="_features").fit(rows)

        found = in_parallel(df.sparkSession, [partial(one, i) for i in range(starts)])
        best = min(found, key=lambda m: m.summary.trainingCost)
        return [list(map(float, c)) for c in best.clusterCenters()], best.summary.trainingCost


def _distances(features: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    cells = []
    for centre in centres:
        square = F.lit(0.0)
        for f, c in zip(features, centre):
            gap = col(f).cast("double") - F.lit(float(c))
            square = square + gap * gap
        cells.append(F.sqrt(square))
    return F.array(*cells)


def assign(
    df: DataFrame,
    features: Sequence[str],
    centres: Sequence[Sequence[float]],
    name: str = "Predicted_Cluster",
) -> DataFrame:
    """Add the nearest centre's number, the distance to each centre, and
    ``Distance_to_Center``. Plain expressions, for batch and stream alike."""
    check_features(df, features)
    placed = df.withColumn("_d", _distances(features, centres))
    new = {
        name: (F.array_position("_d", F.array_min("_d")) - 1).cast("int"),
        "Distance_to_Center": F.array_min("_d"),
    }
    for i in range(len(centres)):
        new[f"Distance_to_Cluster_{i}"] = F.col("_d")[i]
    return placed.withColumns(new).drop("_d")


@dataclass
class Clusters:
    """Fitted centres as a step of a chain: scores with the cluster's number."""

    features: list[str]
    centres: list[list[float]]
    problem: str = "clustering"
    algorithm: str = "K-Means"

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], k: int = 3, starts: int = 10, seed: int = 42) -> Clusters:
        return cls(list(features), fit_kmeans(df, features, k, starts, seed)[0])

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``_prediction``: the nearest centre's number, NULL where a feature is NULL."""
        check_features(df, self.features)
        d = _distances(self.features, self.centres)
        number = (F.array_position(d, F.array_min(d)) - 1).cast("double")
        complete = F.lit(True)
        for f in self.features:
            complete = complete & col(f).isNotNull()
        return df.withColumn("_prediction", F.when(complete, number))


def cluster(
    df: DataFrame, features: Sequence[str], k: int = 3, starts: int = 10, seed: int = 42
) -> DataFrame:
    """Add ``Cluster``; incomplete rows are left out."""
    centres, _ = fit_kmeans(df, features, k, starts, seed)
    rows = df.na.drop(subset=list(features))
    d = _distances(features, centres)
    return rows.withColumn("Cluster", (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def sizes(clustered: DataFrame, name: str = "Cluster") -> DataFrame:
    return clustered.groupBy(name).agg(F.count(F.lit(1)).alias("rows"))

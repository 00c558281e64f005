"""Exact nearest neighbours (Euclidean), and models that vote among them.

Copies of one vector are searched once. A small point set, by checked size, is
broadcast. Beyond that, points and queries are divided among pivots, and the
triangle inequality decides which points a cell of queries can need; the rest
never meet. Large cells are cut into chunks, so no task gets a whole cell.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.columns import col
from tidepool.operators.lookup import attach
from tidepool.operators.ordering import with_position
from tidepool.session import checkpoint, limit_of

# Points are broadcast up to this many bytes of vectors.
POINT_BYTES = 64 * 1024 * 1024
PIVOTS = 256
CHUNK = 20_000


def closest(
    queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, ids, distances) of the ``k`` nearest points, ties by id.

    Squared distances by matrix product pick candidates with a margin for
    rounding; the candidates' distances are then computed directly.
    """
    square = (points * points).sum(axis=1)
    step = max(1, 4_000_000 // max(len(points), 1))
    k = min(k, len(points))
    for start in range(0, len(queries), step):
        block = queries[start : start + step]
        size = (block * block).sum(axis=1)
        rough = size[:, None] + square[None, :] - 2.0 * (block @ points.T)
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
        margin = 1e-9 * (1.0 + size + square.max())
        for i in range(len(block)):
            near = np.flatnonzero(rough[i] <= kth[i] + margin[i])
            exact = np.sqrt(((points[near] - block[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[near], exact))[:k]
            yield start + i, ids[near][best], exact[best]


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, 0))


_PAIRS = "qid long, pid long, distance double"


def _pairs(qids: np.ndarray, found) -> pd.DataFrame:
    q, p, d = [], [], []
    for i, ids, dist in found:
        q.append(np.full(len(ids), qids[i]))
        p.append(ids)
        d.append(dist)
    if not q:
        return pd.DataFrame({"qid": [], "pid": [], "distance": []}).astype(
            {"qid": "int64", "pid": "int64", "distance": "float64"}
        )
    return pd.DataFrame(
        {"qid": np.concatenate(q), "pid": np.concatenate(p), "distance": np.concatenate(d)}
    )


def vector_bytes(points: DataFrame, vector: str = "vec") -> int:
    row = points.agg(F.sum(F.size(vector).cast("long") * 8 + 16)).first()
    return row[0] or 0


def fits(points: DataFrame) -> bool:
    return vector_bytes(points) <= limit_of(points.sparkSession, "pointBytes", POINT_BYTES)


def _search_broadcast(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    rows = points.select("id", "vec").toPandas()
    shared = points.sparkSession.sparkContext.broadcast(
        (rows["id"].to_numpy(), _stack(rows["vec"]))
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = shared.value
        for batch in batches:
            if len(batch) and len(ids):
                yield _pairs(
                    batch["id"].to_numpy(), closest(_stack(batch["vec"]), vectors, ids, k)
                )

    return queries.select("id", "vec").mapInPandas(search, _PAIRS)


def _search_cells(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    spark = points.sparkSession
    pivots = limit_of(spark, "pivots", PIVOTS)
    chosen = points.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vec").toPandas()
    shared = spark.sparkContext.broadcast(_stack(chosen["vec"]))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for batch in batches:
            if len(batch):
                far = np.stack(
                    [np.sqrt(((centres - v) ** 2).sum(axis=1)) for v in _stack(batch["vec"])]
                )
                cell = far.argmin(axis=1)
                batch["cell"] = cell
                batch["off"] = far[np.arange(len(cell)), cell]
                yield batch

    placed = "id long, vec array<double>, cell long, off double"
    q = checkpoint(queries.select("id", "vec").mapInPandas(place, placed))
    p = points.select("id", "vec").mapInPandas(place, placed)
    # Bounded by pivots × k rows.
    first = Window.partitionBy("cell").orderBy("off", "id")
    nearest = (
        p.withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= k)
        .select("cell", "off")
        .toPandas()
    )
    reach = {r["cell"]: r["u"] for r in q.groupBy("cell").agg(F.max("off").alias("u")).collect()}
    centres = shared.value
    between = np.stack([np.sqrt(((centres - c) ** 2).sum(axis=1)) for c in centres])
    cells, bounds = [], []
    for cell, u in sorted(reach.items()):
        upper = u + between[cell][nearest["cell"].to_numpy()] + nearest["off"].to_numpy()
        kth = np.sort(upper)[min(k, len(upper)) - 1]
        cells.append(cell)
        # A point can be needed if it is this close to the pivot.
        bounds.append((u + kth) * (1 + 1e-9) + 1e-12)
    wanted = spark.sparkContext.broadcast((np.array(cells), np.array(bounds)))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        cells, bounds = wanted.value
        for batch in batches:
            if not len(batch):
                continue
            homes = []
            for v in _stack(batch["vec"]):
                far = np.sqrt(((centres[cells] - v) ** 2).sum(axis=1))
                homes.append(cells[far <= bounds].astype("int64"))
            batch["cells"] = homes
            yield batch

    sent = points.select("id", "vec").mapInPandas(
        send, "id long, vec array<double>, cells array<long>"
    )
    sent = checkpoint(sent.select(F.explode("cells").alias("cell"), "id", "vec"))
    chunk = limit_of(spark, "neighborChunk", CHUNK)

    def chunks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).alias(name))

    # One row per pivot.
    plan = F.broadcast(chunks(q, "_nq").join(chunks(sent, "_np"), "cell"))

    def spread(df: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        return (
            df.join(plan, "cell")
            .withColumn(names[0], F.pmod(F.xxhash64("id"), F.col(own)))
            .withColumn(names[1], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
            .select("cell", "_q", "_p", "id", "vec")
        )

    left = spread(q, "_nq", "_np", ("_q", "_p"))
    right = spread(sent, "_np", "_nq", ("_p", "_q"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return _pairs(np.zeros(0), [])
        found = closest(_stack(a["vec"]), _stack(b["vec"]), b["id"].to_numpy(), k)
        return _pairs(a["id"].to_numpy(), found)

    partial = (
        left.groupBy("cell", "_q", "_p")
        .cogroup(right.groupBy("cell", "_q", "_p"))
        .applyInPandas(search, _PAIRS)
    )
    best = Window.partitionBy("qid").orderBy("distance", "pid")
    return (
        partial.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).drop("_r")
    )


def search(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(qid, pid, distance): the ``k`` nearest of distinct points (id, vec)."""
    if fits(points):
        return _search_broadcast(queries, points, k)
    return _search_cells(queries, points, k)


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct vectors named by their smallest id, rows with that name)."""
    vectors = checkpoint(
        rows.groupBy("vec").agg(F.min("id").alias("vid"), F.count(F.lit(1)).alias("_n"))
    )
    named = attach(rows, vectors, ["vec"], rows="_n").select("id", "vid")
    return vectors.select(F.col("vid").alias("id"), "vec"), named


def neighbor_table(rows: DataFrame, k: int) -> DataFrame:
    """(id, neighbor, distance, rank) for every row of (id, vec), itself left out.

    ``id`` is a unique whole number; equal distances are ordered by it.
    """
    rows = checkpoint(rows.select("id", "vec"))
    vectors, named = distinct_vectors(rows)
    named = checkpoint(named)
    found = search(vectors, vectors, k + 1)
    # The first k + 1 ids of each vector can be neighbours; a row itself may be
    # one of them. The row limit is applied before the shuffle.
    by_id = Window.partitionBy("vid").orderBy("id")
    members = (
        named.withColumn("_r", F.row_number().over(by_id))
        .filter(F.col("_r") <= k + 1)
        .groupBy("vid")
        .agg(F.collect_list("id").alias("ids"))
    )
    usage = found.groupBy("pid").agg(F.count(F.lit(1)).alias("_used"))
    members = members.join(usage, members["vid"] == usage["pid"]).select("pid", "ids", "_used")
    expanded = attach(found, members, ["pid"], rows="_used").select(
        F.col("qid").alias("vid"), "distance", F.explode("ids").alias("neighbor")
    )
    best = Window.partitionBy("vid").orderBy("distance", "neighbor")
    lists = (
        expanded.withColumn("_r", F.row_number().over(best))
        .filter(F.col("_r") <= k + 1)
        .groupBy("vid")
        .agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor"))).alias("near"))
    )
    sizes = named.groupBy("vid").agg(F.count(F.lit(1)).alias("_rows"))
    per_row = attach(named, lists.join(sizes, "vid"), ["vid"], rows="_rows")
    others = F.filter("near", lambda n: n["neighbor"] != F.col("id"))
    return per_row.select("id", F.posexplode(F.slice(others, 1, k)).alias("_i", "n")).select(
        "id",
        F.col("n.neighbor").alias("neighbor"),
        F.col("n.distance").alias("distance"),
        (F.col("_i") + 1).cast("long").alias("rank"),
    )


def vector_of(
    features: Sequence[str],
    widths: dict[str, tuple[float, float]] | None = None,
    fill: dict[str, Any] | None = None,
) -> Column:
    cells = []
    for f in features:
        c = col(f).cast("double")
        if (fill or {}).get(f) is not None:
            c = F.coalesce(c, F.lit(float(fill[f])))
        if widths and f in widths:
            c = (c - F.lit(widths[f][0])) / F.lit(widths[f][1])
        cells.append(c)
    return F.array(*cells)


class NeighborModel:
    """k-nearest-neighbour classifier or regressor over stored points."""

    def __init__(self, points: DataFrame, settings: dict[str, Any]):
        self.points, self.settings = points, settings

    @classmethod
    def fit(
        cls, rows: DataFrame, features: Sequence[str], label: Column, keys: Sequence[str],
        problem: str, n_classes: int, k: int, weights: str,
        widths: dict[str, tuple[float, float]], fill: dict[str, Any],
    ) -> NeighborModel:
        if weights not in ("uniform", "distance"):
            raise ValueError(f"Unknown weights '{weights}'")
        fill = {f: fill[f] for f in features if fill.get(f) is not None}
        points = with_position(
            rows.select(
                *[col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
                vector_of(features, widths, fill).alias("vec"),
                label.alias("label"),
            ),
            [f"_k{i}" for i in range(len(keys))],
            "id",
        ).select("id", "vec", "label")
        settings = {
            "features": list(features), "problem": problem, "n_classes": n_classes, "k": k,
            "weights": weights, "widths": widths, "fill": fill,
        }
        return cls(points, settings)

    def _vector(self) -> Column:
        s = self.settings
        widths = {f: tuple(w) for f, w in s["widths"].items()}
        return vector_of(s["features"], widths, s["fill"])

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the prediction and, for classes, the share of the votes."""
        scored = self._broadcast(df) if fits(self.points) else self._joined(df)
        if self.settings["problem"] == "classification":
            return scored.withColumn(
                "_prediction",
                (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double"),
            ).withColumnRenamed("_votes", "_probability")
        return scored.withColumn("_prediction", F.get("_votes", F.lit(0))).drop("_votes")

    def _broadcast(self, df: DataFrame) -> DataFrame:
        s = self.settings
        rows = self.points.toPandas()
        shared = df.sparkSession.sparkContext.broadcast(
            (rows["id"].to_numpy(), _stack(rows["vec"]), rows["label"].to_numpy())
        )
        k, n, weights, classify = (
            s["k"], s["n_classes"], s["weights"], s["problem"] == "classification",
        )

        @F.pandas_udf("array<double>")
        def votes(vectors: pd.Series) -> pd.Series:
            ids, points, labels = shared.value
            place = np.argsort(ids)
            out: list[Any] = [None] * len(vectors)
            known = np.array([v is not None and not np.isnan(np.asarray(v, float)).any() for v in vectors])
            at = np.flatnonzero(known)
            if len(at):
                found = closest(_stack(vectors.iloc[at]), points, ids, k)
                for i, near, dist in found:
                    got = labels[place[np.searchsorted(ids[place], near)]]
                    out[at[i]] = _vote(got, dist, n, weights, classify)
            return pd.Series(out)

        return df.withColumn("_votes", votes(self._vector()))

    def _joined(self, df: DataFrame) -> DataFrame:
        s = self.settings
        kept = checkpoint(
            df.withColumn("_vec", self._vector()).withColumn(
                "_row", F.monotonically_increasing_id()
            )
        )
        rows = kept.select(F.col("_row").alias("id"), F.col("_vec").alias("vec"))
        rows = rows.filter(~F.exists("vec", lambda x: x.isNull()))
        wanted, named = distinct_vectors(rows)
        unique, members = distinct_vectors(self.points.select("id", "vec"))
        found = search(wanted, unique, s["k"])
        by_id = Window.partitionBy("vid").orderBy("id")
        first = (
            members.withColumn("_r", F.row_number().over(by_id))
            .filter(F.col("_r") <= s["k"])
            .join(self.points.select("id", "label"), "id")
            .groupBy("vid")
            .agg(F.collect_list(F.struct("id", "label")).alias("ids"))
        )
        usage = found.groupBy("pid").agg(F.count(F.lit(1)).alias("_used"))
        first = first.join(usage, first["vid"] == usage["pid"]).select("pid", "ids", "_used")
        expanded = attach(found, first, ["pid"], rows="_used").select(
            F.col("qid").alias("vid"), "distance", F.inline("ids")
        )
        best = Window.partitionBy("vid").orderBy("distance", "id")
        near = expanded.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= s["k"])
        lists = near.groupBy("vid").agg(
            F.collect_list("label").alias("labels"), F.collect_list("distance").alias("dists")
        )
        n, weights, classify = s["n_classes"], s["weights"], s["problem"] == "classification"

        @F.pandas_udf("array<double>")
        def votes(labels: pd.Series, dists: pd.Series) -> pd.Series:
            return pd.Series(
                [
                    _vote(np.asarray(a), np.asarray(b), n, weights, classify)
                    for a, b in zip(labels, dists)
                ]
            )

        lists = lists.select("vid", votes("labels", "dists").alias("_votes"))
        sizes = named.groupBy("vid").agg(F.count(F.lit(1)).alias("_rows"))
        per_row = attach(named, lists.join(sizes, "vid"), ["vid"], rows="_rows")
        per_row = per_row.select(F.col("id").alias("_row"), "_votes")
        return kept.join(per_row, "_row", "left").drop("_row", "_vec")

    def save(self, path: str) -> None:
        self.points.write.mode("overwrite").parquet(f"{path}/points")
        spark = self.points.sparkSession
        spark.createDataFrame([(json.dumps(self.settings),)], "settings string").coalesce(
            1
        ).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeighborModel:
        row = spark.read.parquet(f"{path}/settings").first()
        return cls(spark.read.parquet(f"{path}/points"), json.loads(row["settings"]))


def _vote(
    labels: np.ndarray, dist: np.ndarray, n: int, weights: str, classify: bool
) -> list[float]:
    if weights == "distance":
        w = (dist == 0).astype(float) if (dist == 0).any() else 1.0 / dist
    else:
        w = np.ones(len(dist))
    if classify:
        votes = np.bincount(labels.astype(int), weights=w, minlength=n)
        return list(votes / votes.sum())
    return [float((labels * w).sum() / w.sum())]

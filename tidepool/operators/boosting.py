"""Gradient boosting for many classes: one softmax model, a tree per class and round.

A round grows a regression tree on the residuals of each class and gives its
leaves a Newton step. Rows are packed once into blocks of bin numbers, classes
and scores. One pass a level sums residuals by class, node and bin for the trees
of all classes; only these sums reach the driver. The last level's sums hold
those of the leaves, and the next round's first pass moves the scores. Trees
become column expressions.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import feature as MF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.gradients import BLOCK_ROWS, _added, held, number
from tidepool.session import checkpoint

# Rounds after which the scores are written; a lost executor costs as many at most.
WRITTEN_EVERY = 10
LEAST_STEP = 1e-150
# Bins of a feature, and rows whose values tell the bounds of bins, as in Spark's trees.
BINS = 32
BOUND_ROWS = 10_000


def _bounds(rows: DataFrame, inputs: Sequence[str], n: int, seed: int) -> list[np.ndarray]:
    """Thresholds of each input at shares of its values, those of Spark's trees: between all values if they are few."""
    fraction = min(1.0, max(BINS * BINS, BOUND_ROWS) / n)
    spark = rows.sparkSession
    jdf = rows.select(*inputs)._jdf
    start = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    drawn = jdf.toJavaRDD().sample(False, fraction, start)
    table = DataFrame(spark._jsparkSession.createDataFrame(drawn, jdf.schema()), spark).toPandas().to_numpy(float)
    return [_cuts(table[:, i], fraction * n) for i in range(len(inputs))]


def _cuts(values: np.ndarray, expected: float) -> np.ndarray:
    found, count = np.unique(values[values != 0], return_counts=True)
    count = count.astype(float)
    rest = expected - count.sum()  # Spark takes what is missing for zeros
    if rest > 2.220446049250313e-16 * max(len(values), 1) * 100:
        at = int(np.searchsorted(found, 0.0))
        found, count = np.insert(found, at, 0.0), np.insert(count, at, rest)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) < BINS:
        return middles
    stride, cuts = expected / BINS, []
    target, reached = stride, count[0]
    for i in range(1, len(found)):
        before, reached = reached, reached + count[i]
        if abs(before - target) < abs(reached - target):
            cuts.append(middles[i - 1])
            target += stride
    return np.array(cuts)


def _pack(batches: Iterable[pa.RecordBatch], bounds: Sequence[np.ndarray], start: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            y = np.asarray(part.column(0), np.float64).astype(np.int32)
            bins = [np.searchsorted(b, np.asarray(part.column(i + 1), np.float64)).astype(np.uint8) for i, b in enumerate(bounds)]
            scores = np.repeat(start[:, None], len(y), axis=1)
            cells = [pa.array([c], pa.binary()) for c in (y.tobytes(), np.array(bins).tobytes(), scores.tobytes())]
            yield pa.RecordBatch.from_arrays(cells, ["y", "bins", "scores"])


class Tree:
    """A tree while it grows: node i has the children 2 i + 1 and 2 i + 2; a feature of -1 marks a leaf."""

    def __init__(self, depth: int):
        nodes = 2 ** (depth + 1) - 1
        self.feature, self.bin, self.value = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)

    def places(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels."""
        at = np.zeros(bins.shape[1], int)
        every = np.arange(bins.shape[1])
        for _ in range(levels):
            f = self.feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (bins[f, every] > self.bin[at]))
        return at

    def text(self, inputs: Sequence[str], bounds: Sequence[np.ndarray], node: int = 0) -> str:
        f = self.feature[node]
        if f < 0:
            return number(self.value[node])
        low, high = self.text(inputs, bounds, 2 * node + 1), self.text(inputs, bounds, 2 * node + 2)
        return f"CASE WHEN {inputs[f]} <= {number(bounds[f][self.bin[node]])} THEN {low} ELSE {high} END"


def _block(item: tuple, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y = np.frombuffer(item[0], np.int32)
    return y, np.frombuffer(item[1], np.uint8).reshape(-1, len(y)), np.frombuffer(item[2], np.float64).reshape(n_classes, -1)


def _moved(item: tuple, trees: Sequence[Tree], depth: int) -> tuple:
    y, bins, scores = _block(item, len(trees))
    return item[0], item[1], np.array([s + t.value[t.places(bins, depth)] for s, t in zip(scores, trees)]).tobytes()


def _level(blocks: Iterable[tuple], trees: Sequence[Tree], level: int, width: int, last: bool) -> Iterator[np.ndarray]:
    """Rows, residuals and curvatures by class, node of the level, input and bin."""
    k, nodes, total = len(trees), 2**level, None
    for item in blocks:
        y, bins, scores = _block(item, k)
        total = np.zeros((k, nodes + 1, 3, len(bins), width)) if total is None else total
        p = np.exp(scores - scores.max(axis=0))
        p /= p.sum(axis=0)
        wide = bins.astype(np.int64)
        for i, tree in enumerate(trees):
            r = (y == i) - p[i]
            down = np.abs(r)
            down *= 1 - down
            at = tree.places(bins, level) - (nodes - 1)
            at[at < 0] = nodes  # leaves above this level
            for j in range(len(bins)):
                cell = at * width + wide[j]
                for q, w in enumerate((None, r, down)):
                    if q == 2 and j and not last:
                        break  # only the last level asks for the curvature of parts of a node
                    total[i, :, q, j] += np.bincount(cell, w, (nodes + 1) * width).reshape(-1, width)
    if total is not None:
        yield total[:, :nodes]


def _grow(tree: Tree, level: int, depth: int, sums: np.ndarray, rate: float) -> None:
    """Split the nodes of a level where this lowers the variance most, first among equal ones; value the others."""

    def step(up: float, down: float) -> float:
        return rate * up / down if abs(down) > LEAST_STEP else 0.0

    for local in range(2**level):
        node = 2**level - 1 + local
        if level and tree.feature[(node - 1) // 2] < 0:
            continue
        rows, up, down = sums[local]
        if not rows.size:
            continue
        n, whole = rows[0].sum(), up[0].sum()
        left, above = rows.cumsum(axis=1)[:, :-1], up.cumsum(axis=1)[:, :-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = above**2 / left + (whole - above) ** 2 / (n - left) - whole**2 / n
        gain = np.where((left > 0) & (left < n), gain, -np.inf)
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if not gain[f, b] > 1e-13 * max(n, 1):
            tree.value[node] = step(whole, down[0].sum())
            continue
        tree.feature[node], tree.bin[node] = f, b
        if level + 1 == depth:
            for child, part in ((2 * node + 1, slice(None, b + 1)), (2 * node + 2, slice(b + 1, None))):
                tree.value[child] = step(up[f, part].sum(), down[f, part].sum())


def _delete(rdd: RDD) -> None:
    """Drop the written form of blocks that nothing will read again."""
    if path := rdd.getCheckpointFile():
        context = rdd.context
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def probabilities(scores: Sequence[str]) -> str:
    """Softmax of scores as SQL text, safe for large ones."""
    top = f"greatest({', '.join(scores)})"
    parts = [f"exp({s} - {top})" for s in scores]
    return f"transform(array({', '.join(parts)}), x -> x / ({' + '.join(parts)}))"


def softmax(
    rows: DataFrame, inputs: Sequence[str], label: str, n_classes: int, output: str, probability: str,
    rounds: int = 100, rate: float = 0.1, depth: int = 3, seed: int = 42,
) -> list[MF.SQLTransformer]:
    """Column expressions for the class number ``output`` and the array ``probability``.

    Scores start at the logarithm of the class shares. The label is a class
    number from 0; every class must have a row.
    """
    k = range(n_classes)
    count = {int(r[0]): r[1] for r in rows.groupBy(label).agg(F.count(F.lit(1))).collect()}
    total = sum(count.values())
    scores = [f"_s{i}" for i in k]
    base = checkpoint(rows.select(F.col(label).alias("_y"), *[F.col(c).cast("double").alias(c) for c in inputs]))
    bounds = _bounds(base, inputs, total, seed)
    width = max([len(b) for b in bounds], default=0) + 1
    logs = np.log(np.array([count[i] / total for i in k]))
    trees: list[list[str]] = [[] for _ in k]
    packed = base.mapInArrow(functools.partial(_pack, bounds=bounds, start=logs), "y binary, bins binary, scores binary")
    with held(packed, total) as first_blocks:
        blocks, before, written = first_blocks, None, None
        try:
            for done in range(rounds):
                made = [Tree(depth) for _ in k]
                for level in range(depth):
                    step = functools.partial(_level, trees=made, level=level, width=width, last=level + 1 == depth)
                    for tree, own in zip(made, _added(blocks.mapPartitions(step))):
                        _grow(tree, level, depth, own, rate * (n_classes - 1) / n_classes)
                    if before is not None:  # the first pass has moved the scores
                        before.unpersist()
                        if done % WRITTEN_EVERY == 0:
                            if written is not None:
                                _delete(written)
                            written = blocks
                        before = None
                for i, tree in enumerate(made):
                    trees[i].append(tree.text(inputs, bounds))
                if done + 1 < rounds:
                    before, blocks = blocks, blocks.map(functools.partial(_moved, trees=made, depth=depth)).persist(StorageLevel.MEMORY_AND_DISK)
                    if (done + 1) % WRITTEN_EVERY == 0:
                        blocks.checkpoint()
        finally:
            blocks.unpersist()
            if written is not None:
                _delete(written)
    first = [number(v) for v in logs]
    stages = []
    for lo in range(0, rounds, WRITTEN_EVERY):  # one stage for a few rounds, as while fitting
        parts = [" + ".join([first[i] if not lo else f"_s{i}", *trees[i][lo : lo + WRITTEN_EVERY]]) for i in k]
        names = [f"_s{i}" for i in k] if not lo else [f"_t{i}" for i in k]
        text = f"SELECT *, {', '.join(f'{p} AS {n}' for p, n in zip(parts, names))} FROM __THIS__"
        stages.append(MF.SQLTransformer(statement=text))
        if lo:
            swap = ", ".join(f"_t{i} AS _s{i}" for i in k)
            drop = ", ".join([*scores, *names])
            stages.append(MF.SQLTransformer(statement=f"SELECT * EXCEPT ({drop}), {swap} FROM __THIS__"))
    best = f"array_position(array({', '.join(scores)}), greatest({', '.join(scores)}))"
    text = f"SELECT *, CAST({best} - 1 AS DOUBLE) AS {output}, {probabilities(scores)} AS {probability} FROM __THIS__"
    return [*stages, MF.SQLTransformer(statement=text)]

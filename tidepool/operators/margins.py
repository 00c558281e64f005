"""Support vector classes with probabilities: pairs of classes, Platt scaling, coupling.

Each pair of classes has a linear support vector model, fitted together with
those of its folds on a hinge whose corner is rounded less and less. Its
margins become probabilities by a sigmoid that is fitted on margins of rows
which the model behind them has not seen. More than two classes vote, and the pairwise
probabilities are coupled into one distribution. All of it is one column
expression over the inputs.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
from pyspark.ml import classification as C
from pyspark.ml import feature as MF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.gradients import Waves, _pack, _sum, held, minimise, number, weighted
from tidepool.session import cached, in_parallel

FOLDS = 3
# Relative gain of a step that ends a fit, as in Spark's linear model.
TOLERANCE = 1e-6


def _hinges(weights: np.ndarray, x: np.ndarray, code: np.ndarray, a: int, b: int, leave: Sequence[int], soft: float, curved: bool = False) -> tuple[float, np.ndarray]:
    """Summed losses of models of class ``b`` against ``a``, each without the fold that it leaves (-1: none).

    ``code`` is the class number times ``FOLDS`` plus the fold. The corner is rounded over ``soft``, inside of the margin.
    With ``curved``, the second derivatives of the first model follow the gradients.
    """
    label, fold = np.divmod(code.astype(int), FOLDS)
    own = np.flatnonzero((label == a) | (label == b))
    if len(own) < len(label):
        x, label, fold = x[own], label[own], fold[own]
    models = weights.reshape(len(leave), -1)
    side = np.where(label == b, 1.0, -1.0)[:, None]
    out = np.maximum(1 - side * (x @ models[:, :-1].T + models[:, -1]), 0)
    out[fold[:, None] == np.asarray(leave)] = 0
    near = np.minimum(out, soft)
    value = ((near * out).sum() - 0.5 * (near * near).sum()) / soft
    pull = -side * near / soft
    gradient = np.column_stack([pull.T @ x, pull.sum(axis=0)]).ravel()
    if not curved:
        return float(value), gradient
    corner = np.flatnonzero((out[:, 0] > 0) & (out[:, 0] < soft))
    inner = np.column_stack([x[corner], np.ones(len(corner))])
    return float(value), np.concatenate([gradient, (inner.T @ inner).ravel() / soft])


def _sizes(weights: np.ndarray, x: np.ndarray, code: np.ndarray, n_classes: int) -> tuple[float, np.ndarray]:
    """Rows by class and fold, in the place of a gradient."""
    return 0.0, np.bincount(code.astype(int), minlength=n_classes * FOLDS).astype(float)


def _fitted(total: Callable, a: int, b: int, leave: Sequence[int], d: int, c: float, steps: int) -> np.ndarray:
    """Weights and intercept of each model, in a row each; one pass over the rows serves them all.

    Newton's steps, of which a corner takes a few; where none goes down, L-BFGS goes on.
    """
    k, size = len(leave), len(leave) * (d + 1)
    w = np.zeros(size)
    free = np.tile(np.append(np.ones(d), 0.0), k)  # intercepts are not penalised
    for soft in (1.0, 0.1, 0.01):
        loss = partial(_hinges, a=a, b=b, leave=leave, soft=soft)

        def whole(weights: list[np.ndarray], loss: Callable = loss) -> list[tuple[float, np.ndarray]]:
            return [
                (0.5 * float(free * w @ w) + c * value, free * w + c * gradient)
                for w, (value, gradient) in zip(weights, total(loss, weights))
            ]

        def here(w: np.ndarray, loss: Callable = loss) -> tuple[float, np.ndarray, np.ndarray]:
            """Value, gradient and the step to take."""
            [(value, found)] = total(partial(loss, curved=True), [w])
            gradient = free * w + c * found[:size]
            bent = c * found[size:].reshape(d + 1, d + 1)  # models without a fold are much like the whole one
            step = [
                np.linalg.lstsq(bent * (1.0 if f < 0 else 1 - 1 / FOLDS) + np.diag(free[: d + 1]), g, rcond=None)[0]
                for f, g in zip(leave, gradient.reshape(k, -1))
            ]
            return 0.5 * float(free * w @ w) + c * value, gradient, np.concatenate(step)

        value, gradient, step = here(w)
        for _ in range(steps):
            slope = float(gradient @ step)
            if slope <= TOLERANCE * 1e-3 * max(abs(value), 1e-12):
                break
            tried = w - step
            found = here(tried)
            if not found[0] <= value - 1e-4 * slope:
                lengths = np.array([0.5, 0.25, 0.1, 0.01, 0.0001])
                values = [v for v, _ in whole([w - t * step for t in lengths])]
                best = int(np.argmin(values))
                if not values[best] < value:
                    w = minimise(whole, w, steps, TOLERANCE)
                    break
                tried = w - lengths[best] * step
                found = here(tried)
            better = value - found[0]
            w, (value, gradient, step) = tried, found
            if better <= TOLERANCE * max(abs(value), 1e-12):
                break
    return w.reshape(k, -1)


def sigmoid(rows: DataFrame) -> tuple[float, float]:
    """(slope, shift) of the sigmoid of Platt from (``_margin``, ``_side``).

    The targets are those of Platt, a little off 0 and 1, so that it stays finite
    on separable rows: each row counts as two, with the weights of its target.
    """
    count = {int(r[0]): r[1] for r in rows.groupBy("_side").agg(F.count(F.lit(1))).collect()}
    high, low = (count.get(1, 0) + 1) / (count.get(1, 0) + 2), 1 / (count.get(0, 0) + 2)
    target = F.when(F.col("_side") == 1, high).otherwise(low)
    both = rows.select("_margin", F.explode(F.array(
        F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - target).alias("w"))
    )).alias("t")).select("_margin", "t.y", "t.w")
    data = MF.VectorAssembler(inputCols=["_margin"], outputCol="_x").transform(both)
    fitted = C.LogisticRegression(featuresCol="_x", labelCol="y", weightCol="w", maxIter=100, tol=1e-9).fit(data)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def _pair(
    rows: DataFrame, total: Callable, inputs: Sequence[str], count: dict[tuple[int, int], int], a: int, b: int, c: float, steps: int
) -> tuple[str, str]:
    """(margin, probability) of class ``b`` against ``a`` as SQL text; ``count`` has the rows by class and fold."""
    # A fold that leaves one class only says nothing; its rows are judged by the whole model.
    both = [f for f in range(FOLDS) if all(any(count.get((k, g), 0) for g in range(FOLDS) if g != f) for k in (a, b))]
    made = _fitted(total, a, b, [-1, *both], len(inputs), c, steps)
    whole, *parts = [weighted(list(w[:-1]), inputs, w[-1]) for w in made]
    margin = " ".join(["CASE _fold", *(f"WHEN {f} THEN {p}" for f, p in zip(both, parts)), f"ELSE {whole} END"]) if both else whole
    own = rows.where(F.col("_y").isin([float(a), float(b)]))
    with cached(own.select(F.expr(margin).alias("_margin"), (F.col("_y") == b).cast("double").alias("_side"))) as unseen:
        slope, shift = sigmoid(unseen)
    return whole, f"1 / (1 + exp(-({number(slope)} * ({whole}) + {number(shift)})))"


def support_vectors(
    rows: DataFrame, inputs: Sequence[str], label: str, n_classes: int, output: str, probability: str,
    c: float = 1.0, steps: int = 1000, lift: Waves | None = None,
) -> list[MF.SQLTransformer]:
    """Column expressions for the class number ``output`` and the array ``probability``.

    The class is that of most votes of its pairs, the first of equal ones; with
    two classes, the side of the margin. Probabilities come from the coupling
    p = 1 / (sum over others of 1 / r - (classes - 2)), made to sum to 1. Folds
    follow a hash of the inputs, so equal rows stay together. ``lift`` says how
    ``inputs`` come from fewer columns, which are kept in their place.
    """
    kept = lift.inputs if lift else list(inputs)
    rows = rows.select(F.col(label).alias("_y"), *dict.fromkeys([*inputs, *kept]))
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64(*inputs), F.lit(FOLDS)))
    code = (F.col("_y") * FOLDS + F.col("_fold")).cast("double")
    table = rows.select(code.alias("_code"), *[F.col(x).cast("double") for x in kept])
    packed = table.mapInArrow(partial(_pack, middle=np.zeros(len(kept) + 1), width=np.ones(len(kept) + 1)), "y binary, x binary")
    pairs = list(itertools.combinations(range(n_classes), 2))
    with held(packed, rows.count()) as blocks:
        [(_, sizes)] = _sum(blocks, partial(_sizes, n_classes=n_classes), [np.zeros(0)])
        count = {(k, f): int(sizes[k * FOLDS + f]) for k in range(n_classes) for f in range(FOLDS)}
        total = partial(_sum, blocks, lift=lift)
        made = in_parallel(rows.sparkSession, [partial(_pair, rows, total, inputs, count, a, b, c, steps) for a, b in pairs])
    names = {p: f"_{p[0]}_{p[1]}" for p in pairs}
    cells = ", ".join(f"{m} AS _m{names[p]}, {q} AS _q{names[p]}" for p, (m, q) in zip(pairs, made))
    first = MF.SQLTransformer(statement=f"SELECT *, {cells} FROM __THIS__")

    def beats(a: int, b: int) -> str:
        return f"_m{names[a, b]} <= 0" if a < b else f"_m{names[b, a]} > 0"

    def share(a: int, b: int) -> str:
        """The probability of ``a`` against ``b``, kept off 0."""
        q = f"1 - _q{names[a, b]}" if a < b else f"_q{names[b, a]}"
        return f"greatest({q}, 1e-7D)"

    others = [[b for b in range(n_classes) if b != a] for a in range(n_classes)]
    votes = [" + ".join(f"CAST({beats(a, b)} AS INT)" for b in others[a]) for a in range(n_classes)]
    coupled = [
        "1 / (" + " + ".join(f"1 / {share(a, b)}" for b in others[a]) + f" - {n_classes - 2})" for a in range(n_classes)
    ]
    whole = f"array({', '.join(coupled)})"
    total = f"aggregate({whole}, 0D, (s, x) -> s + x)"
    text = (
        f"SELECT *, CAST(array_position(array({', '.join(votes)}), array_max(array({', '.join(votes)}))) - 1 AS DOUBLE) AS {output}, "
        f"transform({whole}, x -> x / {total}) AS {probability} FROM __THIS__"
    )
    return [first, MF.SQLTransformer(statement=text)]


def margins(rows: DataFrame, model: C.LinearSVCModel) -> DataFrame:
    """Rows with the signed distance that a plain linear model gives, as ``_margin``."""
    return model.transform(rows).withColumn("_margin", F.get(vector_to_array(model.getRawPredictionCol()), F.lit(1)))

"""Full-batch training of small models: each step sums one vector per task.

Training rows are standardised and packed once into blocks of a few thousand
rows, which are kept. A step sends the weights to all tasks; each returns the
sum of its losses and gradients, and many tasks are added up by a few more
before the driver sees them. Steps are those of L-BFGS, so a fit takes tens of passes. A fitted model
is a column expression.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import feature as MF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
# Halves of a step that are tried in one pass.
HALVES = 8
# Rows that a task sums in one pass.
PASS_ROWS = 600_000
# Sums that the driver adds up itself.
DIRECT = 64

# weights, inputs and targets of a block -> (loss, gradient), both sums over its rows
Loss = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[float, np.ndarray]]


def number(value: float) -> str:
    """A double as SQL text."""
    return f"({float(value)!r}D)" if math.isfinite(value) else "CAST(NULL AS DOUBLE)"


def weighted(weights: Sequence[float], inputs: Sequence[str], intercept: float) -> str:
    """A linear expression as SQL text."""
    return " + ".join([number(intercept), *(f"{number(w)} * {c}" for w, c in zip(weights, inputs))])


def _pack(batches: Iterable[pa.RecordBatch], middle: np.ndarray, width: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of standardised rows; ``middle`` and ``width`` hold the target first."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            columns = [(np.asarray(part.column(i), np.float64) - m) / w for i, (m, w) in enumerate(zip(middle, width))]
            x = np.stack(columns[1:], axis=1) if len(columns) > 1 else np.zeros((part.num_rows, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([columns[0].tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["y", "x"]
            )


@dataclass
class Waves:
    """Cosine columns of an RBF kernel, made from ``inputs`` where they are needed: kept rows hold the inputs only."""

    inputs: list[str]
    weights: np.ndarray
    shifts: np.ndarray
    factor: float
    middle: np.ndarray | float = 0.0
    width: np.ndarray | float = 1.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        turns = (x @ self.weights.T + self.shifts) / (2 * math.pi)
        return (self.factor * _cosine_of_turns(turns) - self.middle) / self.width


# Taylor's series of the sine, which a quarter of a turn needs to full precision.
_SINE = [(-1.0) ** i * (2 * math.pi) ** (2 * i + 1) / math.factorial(2 * i + 1) for i in range(12)]


def _cosine_of_turns(turns: np.ndarray) -> np.ndarray:
    """cos(2 pi ``turns``) in a few sweeps, which takes a third of the time of the library's; ``turns`` is used up."""
    turns -= np.rint(turns)
    np.abs(turns, out=turns)
    np.subtract(0.25, turns, out=turns)
    square = turns * turns
    out = np.full_like(square, _SINE[-1])
    for c in reversed(_SINE[:-1]):
        out *= square
        out += c
    out *= turns
    return out


def _step(blocks: Iterable[tuple], loss: Loss, weights: Sequence[np.ndarray], lift: Waves | None = None) -> Iterator[np.ndarray]:
    total = None
    for y, x in blocks:
        target = np.frombuffer(y, np.float64)
        data = np.frombuffer(x, np.float64).reshape(len(target), -1)
        data = lift(data) if lift else data
        for i, w in enumerate(weights):
            value, gradient = loss(w, data, target)
            total = np.zeros((len(weights), len(gradient) + 1)) if total is None else total
            total[i, 0] += value
            total[i, 1:] += gradient
    if total is not None:
        yield total


def _added(sums: RDD) -> np.ndarray:
    if sums.getNumPartitions() > DIRECT:
        return sums.treeReduce(np.add, 2)
    return np.sum(sums.collect(), axis=0)


def _sum(
    blocks: RDD, loss: Loss, weights: Sequence[np.ndarray], lift: Waves | None = None
) -> list[tuple[float, np.ndarray]]:
    """(loss, gradient) for each of a few weights, in one pass."""
    total = _added(blocks.mapPartitions(functools.partial(_step, loss=loss, weights=weights, lift=lift)))
    return [(float(t[0]), t[1:]) for t in total]


@contextmanager
def held(packed: DataFrame, n: int) -> Iterator[RDD]:
    """Blocks of ``n`` packed rows as tuples, kept for many passes, in as many tasks as their rows need.

    The number of tasks follows rows, not blocks, and is 1 or a multiple of the
    cores. Blocks go to Python one by one, so no task holds more than a few.
    """
    blocks = packed.rdd.map(lambda r: tuple(bytes(c) if isinstance(c, bytearray) else c for c in r))
    tasks, cores = max(1, math.ceil(n / PASS_ROWS)), blocks.context.defaultParallelism
    if tasks > 1:
        tasks = cores * math.ceil(tasks / cores)
    found = blocks.getNumPartitions()
    if found > tasks:
        blocks = blocks.coalesce(tasks)
    elif found < tasks:
        blocks = blocks.repartition(tasks)
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield blocks
    finally:
        blocks.unpersist()


def minimise(
    fn: Callable[[list[np.ndarray]], list[tuple[float, np.ndarray]]], start: np.ndarray, steps: int, tolerance: float = 1e-9
) -> np.ndarray:
    """L-BFGS with ten remembered steps and a halving line search.

    ``fn`` gives values and gradients at several places, in one pass over the rows. A step whose whole length failed
    tries its next halves together, and so does the step after it.
    """
    w = start
    [(value, gradient)] = fn([w])
    tries = 1
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if not np.abs(gradient).max(initial=0.0) > 1e-10:
            break
        q, kept = gradient.copy(), []
        for s, y, r in reversed(moves):
            a = r * (s @ q)
            q -= a * y
            kept.append(a)
        if moves:
            s, y, _ = moves[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(moves, reversed(kept)):
            q += s * (a - r * (y @ q))
        slope = float(gradient @ q)
        if slope <= 0:
            q, slope, moves = gradient, float(gradient @ gradient), []
        length = 1.0 if moves else min(1.0, 1.0 / np.abs(gradient).sum())
        first, found = length, False
        while not found:
            for new, slopes in fn([w - length / 2**i * q for i in range(tries)]):
                if found := bool(new <= value - 1e-4 * length * slope or length < 1e-12):
                    break
                length /= 2
            tries = HALVES
        tries = 1 if length == first else HALVES // 2
        if length < 1e-12:
            break
        s, y = -length * q, slopes - gradient
        if s @ y > 1e-12 * (y @ y):
            moves = [*moves[-9:], (s, y, 1.0 / (s @ y))]
        better = value - new
        w, value, gradient = w + s, new, slopes
        if better <= tolerance * max(abs(value), 1e-12):
            break
    return w


def trained(
    rows: DataFrame, inputs: Sequence[str], label: str, n: int, middle: np.ndarray, width: np.ndarray,
    fit: Callable[[Callable], np.ndarray], lift: Waves | None = None,
) -> np.ndarray:
    """Weights from ``fit``, which gets a function from (loss, a few weights) to summed losses and gradients over ``rows``.

    Losses see ``n`` rows less ``middle``, divided by ``width``; both hold the target first. With ``lift``, ``inputs`` are
    kept and losses see what it makes of them.
    """
    table = rows.select(F.col(label).cast("double"), *[F.col(c).cast("double") for c in inputs])
    packed = table.mapInArrow(functools.partial(_pack, middle=middle, width=width), "y binary, x binary")
    with held(packed, n) as blocks:
        return fit(functools.partial(_sum, blocks, lift=lift))


def spreads(rows: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, deviations) of columns; a constant column has deviation 1."""
    marks = [m for c in columns for m in (F.avg(F.col(c).cast("double")), F.stddev_pop(F.col(c).cast("double")))]
    row = rows.agg(F.count(F.lit(1)), *marks).first()
    if not row[0]:
        raise ValueError("No complete rows to train on")
    deviation = np.array(row[2::2], float)
    return row[0], np.array(row[1::2], float), np.where(deviation > 0, deviation, 1.0)


# A network of one hidden layer for values


def _network(weights: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int) -> tuple[float, np.ndarray]:
    d = x.shape[1]
    first, shift, last = weights[: hidden * d].reshape(hidden, d), weights[hidden * d : hidden * (d + 1)], weights[hidden * (d + 1) :]
    h = first @ x.T  # a unit a row
    h += shift[:, None]
    np.tanh(h, out=h)
    error = last[:-1] @ h
    error += last[-1] - y
    out = h @ error
    h *= h
    np.subtract(1, h, out=h)
    h *= error
    pull = last[:-1]
    gradient = [(pull[:, None] * (h @ x)).ravel(), pull * h.sum(axis=1), out, [error.sum()]]
    return 0.5 * float(error @ error), np.concatenate(gradient)


def network(
    rows: DataFrame, inputs: Sequence[str], label: str, output: str, hidden: int, steps: int, penalty: float = 1e-4, seed: int = 42
) -> MF.SQLTransformer:
    """A network with one layer of tanh units and a linear output, as a column expression.

    Inputs and target are standardised while it is fitted; the penalty is that
    of the squared weights per row.
    """
    n, middle, width = spreads(rows, [label, *inputs])
    d = len(inputs)
    rng = np.random.default_rng(seed)
    bound, out = math.sqrt(6 / (d + hidden)), math.sqrt(6 / (hidden + 1))
    start = np.concatenate([rng.uniform(-bound, bound, hidden * (d + 1)), rng.uniform(-out, out, hidden + 1)])
    free = np.ones(len(start))  # shifts are not penalised
    free[hidden * d : hidden * (d + 1)] = 0
    free[-1] = 0
    loss = functools.partial(_network, hidden=hidden)

    def fit(total: Callable) -> np.ndarray:
        def mean(weights: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
            return [
                ((value + 0.5 * penalty * float(free * w @ w)) / n, (gradient + penalty * free * w) / n)
                for w, (value, gradient) in zip(weights, total(loss, weights))
            ]

        return minimise(mean, start, steps)

    w = trained(rows, inputs, label, n, middle, width, fit)
    first = w[: hidden * d].reshape(hidden, d) / width[1:]
    shift = w[hidden * d : hidden * (d + 1)] - first @ middle[1:]
    last = w[hidden * (d + 1) :] * width[0]
    units = [f"{number(v)} * tanh({weighted(a, inputs, b)})" for v, a, b in zip(last[:-1], first, shift)]
    text = " + ".join([number(last[-1] + middle[0]), *units])
    return MF.SQLTransformer(statement=f"SELECT *, {text} AS {output} FROM __THIS__")


def _rounded(out: np.ndarray, soft: float) -> tuple[float, np.ndarray]:
    """The sum of what is ``out``, squares up to ``soft`` and a line from there, and ``out`` up to ``soft``."""
    out = np.maximum(out, 0)
    near = np.minimum(out, soft)
    return float(near @ out - 0.5 * (near @ near)) / soft, near


# Values within a tube


def _tube(weights: np.ndarray, x: np.ndarray, y: np.ndarray, epsilon: float, soft: float) -> tuple[float, np.ndarray]:
    """What lies outside the tube; the corner is rounded over ``soft``, outside of it."""
    error = x @ weights[:-1]
    error += weights[-1] - y
    value, near = _rounded(np.abs(error) - epsilon, soft)
    pull = np.copysign(near, error)
    return value, np.append(pull @ x, pull.sum()) / soft


def tube(
    rows: DataFrame, inputs: Sequence[str], label: str, output: str, c: float = 1.0, epsilon: float = 0.1, steps: int = 1000,
    lift: Waves | None = None,
) -> MF.SQLTransformer:
    """Support vector regression: half the squared weights plus ``c`` times what lies outside ``epsilon``.

    Errors up to ``epsilon`` cost nothing. The loss beyond is linear, with a
    corner that is rounded less and less from one fit to the next. ``lift`` says
    how ``inputs`` come from fewer columns, which are kept in their place.
    """
    n, middle, width = spreads(rows, [label, *inputs])
    scale = np.append(width[1:], 1.0)  # weights are of inputs of mean 0 and deviation 1

    def fit(total: Callable) -> np.ndarray:
        w = np.zeros(len(inputs) + 1)
        for soft in (1.0, 0.1, 0.01, 0.001):
            loss = functools.partial(_tube, epsilon=epsilon, soft=soft * max(epsilon, 1e-3 * width[0]))

            def whole(weights: list[np.ndarray], loss: Loss = loss) -> list[tuple[float, np.ndarray]]:
                made = []
                for w, (value, gradient) in zip(weights, total(loss, weights)):
                    own = np.append(w[:-1] / scale[:-1], 0.0)  # the penalty is that of the unscaled weights
                    made.append((0.5 * float(own @ own) + c * value, own / scale + c * gradient))
                return made

            w = minimise(whole, w, steps)
        return w

    if lift:
        lift, kept = replace(lift, middle=middle[1:], width=width[1:]), lift.inputs
        w = trained(rows, kept, label, n, np.append(middle[0], np.zeros(len(kept))), np.ones(len(kept) + 1), fit, lift)
    else:
        w = trained(rows, inputs, label, n, middle, np.append(1.0, width[1:]), fit)
    slope = w[:-1] / scale[:-1]
    text = weighted(slope, inputs, w[-1] + middle[0] - float(slope @ middle[1:]))
    return MF.SQLTransformer(statement=f"SELECT *, {text} AS {output} FROM __THIS__")

"""Voting, weighting, bagging, chaining and stacking."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.columns import classify, col
from tidepool.operators import metrics, models, prepare, sampling
from tidepool.operators.cluster import Clusters
from tidepool.operators.models import PREDICTION, Trained
from tidepool.operators.profile import correlations, high_correlations, rows_from
from tidepool.session import cached, checkpoint, in_parallel


def _weights(n: int, weights: Sequence[float] | None) -> list[float]:
    got = [1.0] * n if weights is None else [float(w) for w in weights]
    if len(got) != n:
        raise ValueError(f"{n} weights needed, {len(got)} given")
    if sum(got) <= 0 or min(got) < 0:
        raise ValueError("Weights must be positive")
    return got


def _first_best(votes: Column) -> Column:
    return F.array_position(votes, F.array_max(votes)) - 1


def hard_vote(
    votes: Sequence[Column], classes: Sequence[Any], weights: Sequence[float] | None = None
) -> Column:
    """The class with most votes, the smallest of equals. Classes are sorted."""
    w = _weights(len(votes), weights)
    totals = [
        sum((F.when(v == F.lit(c), F.lit(x)).otherwise(F.lit(0.0)) for v, x in zip(votes, w)), F.lit(0.0))
        for c in classes
    ]
    return models.class_of(_first_best(F.array(*totals)), classes)


def _times(values: Column, factor: float) -> Column:
    return F.transform(values, lambda v: v * F.lit(factor))


def mean_probability(
    probabilities: Sequence[Column], weights: Sequence[float] | None = None
) -> Column:
    """Weighted mean of probability arrays."""
    w = _weights(len(probabilities), weights)
    total = None
    for p, x in zip(probabilities, w):
        part = _times(p, x / sum(w))
        total = part if total is None else F.zip_with(total, part, lambda a, b: a + b)
    return total


def soft_vote(
    probabilities: Sequence[Column],
    classes: Sequence[Any],
    weights: Sequence[float] | None = None,
) -> Column:
    """The class with the largest weighted mean probability."""
    return models.class_of(_first_best(mean_probability(probabilities, weights)), classes)


def weighted_mean(values: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    w = _weights(len(values), weights)
    return sum((v * F.lit(x / sum(w)) for v, x in zip(values, w)), F.lit(0.0))


def score_weights(scores: Sequence[float]) -> list[float]:
    """Weights proportional to test scores; worthless models count nothing."""
    kept = [max(float(s), 0.0) for s in scores]
    if sum(kept) <= 0:
        raise ValueError("No model has a positive score")
    return [s / sum(kept) for s in kept]


@dataclass
class Ensemble:
    """Several models that answer together; scores like one model."""

    members: list[Trained]
    kind: str
    weights: list[float]
    info: dict[str, Any] = field(default_factory=dict)
    model_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])

    @property
    def algorithm(self) -> str:
        return f"Ensemble ({self.kind})"

    @property
    def parts(self) -> list[Any]:
        return self.members

    @property
    def params(self) -> dict[str, Any]:
        return {"kind": self.kind, "weights": self.weights}

    @classmethod
    def of_parts(cls, parts: Sequence[Any], params: dict[str, Any], info: dict[str, Any], model_id: str) -> Ensemble:
        return cls(list(parts), params["kind"], list(params["weights"]), info, model_id)

    @property
    def problem(self) -> str:
        return self.members[0].problem

    @property
    def target(self) -> str:
        return self.members[0].target

    @property
    def classes(self) -> list[Any]:
        return self.members[0].classes

    @property
    def features(self) -> list[str]:
        return list(dict.fromkeys(f for m in self.members for f in m.features))

    def member_outputs(self, df: DataFrame) -> DataFrame:
        """Add ``_p<i>`` (prediction) and ``_q<i>`` (probabilities) per member."""
        out = df
        for i, m in enumerate(self.members):
            out = m.score(out).withColumnRenamed(PREDICTION, f"_p{i}")
            if "_probability" in out.columns:
                out = out.withColumnRenamed("_probability", f"_q{i}")
        return out

    def score(self, df: DataFrame) -> DataFrame:
        out = self.member_outputs(df)
        n = range(len(self.members))
        if self.problem == "regression":
            got = {PREDICTION: weighted_mean([F.col(f"_p{i}") for i in n], self.weights)}
        else:
            numbers = [float(i) for i in range(len(self.classes))]
            known = all(f"_q{i}" in out.columns for i in n)
            if self.kind == "soft" and known:
                mean = mean_probability([F.col(f"_q{i}") for i in n], self.weights)
                got = {"_probability": mean, PREDICTION: _first_best(mean).cast("double")}
            else:
                # A member without probabilities leaves only votes to count.
                votes = [F.col(f"_p{i}") for i in n]
                got = {PREDICTION: hard_vote(votes, numbers, self.weights)}
        out = out.withColumns(got)
        return out.drop(*[f"_p{i}" for i in n], *[f"_q{i}" for i in n])


def voting(
    members: Sequence[Trained], kind: str = "hard", weights: Sequence[float] | None = None
) -> Ensemble:
    """Hard or soft voting, or weighted averaging for regression."""
    if len(members) < 2:
        raise ValueError("At least two models")
    if len({(m.problem, m.target) for m in members}) != 1:
        raise ValueError("Models must share target and problem type")
    if kind not in ("hard", "soft", "weighted"):
        raise ValueError(f"Unknown voting '{kind}'")
    if any(list(m.classes) != list(members[0].classes) for m in members):
        raise ValueError("Models must know the same classes; fit them with the same ``classes``")
    return Ensemble(list(members), kind, _weights(len(members), weights))


def bagging(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    algorithm: str,
    keys: Sequence[str],
    n: int = 10,
    fraction: float = 1.0,
    replace: bool = True,
    seed: int = 42,
    **options: Any,
) -> Ensemble:
    """Models of one kind on different samples, averaged."""
    if not 3 <= n <= 50:
        raise ValueError("3 to 50 models")
    if not 0.3 <= fraction <= 1.0:
        raise ValueError("fraction must be between 0.3 and 1.0")
    problem = options.pop("problem", None) or prepare.problem_type(df, target)
    names = list(dict.fromkeys([*keys, target, *features]))
    with cached(df.select(*[col(c) for c in names])) as rows:
        # A sample may miss a class; all members number the classes of the whole table.
        options.setdefault("classes", _classes(rows, target, problem))

        def one(i: int) -> Trained:
            return models.fit(
                sampling.bootstrap(rows, keys, fraction, replace, seed + i),
                target, features, algorithm, problem=problem, keys=keys, seed=seed + i, **options,
            )

        members = in_parallel(df.sparkSession, [partial(one, i) for i in range(n)])
    return Ensemble(members, "soft", [1.0] * n)


def _classes(df: DataFrame, target: str, problem: str) -> list[Any] | None:
    return models.class_values(df, target) if problem == "classification" else None


def compatible(first: str, second: str) -> bool:
    """Whether one kind of model may feed another."""
    allowed = {
        "regression": {"regression", "classification", "clustering"},
        "classification": {"classification"},
        "clustering": {"classification", "regression"},
    }
    return second in allowed.get(first, set())


FLOWS = ("prediction_only", "with_original", "custom")


def chain(
    df: DataFrame,
    steps: Sequence[Trained | Ensemble | Stack | Clusters],
    flow: str = "with_original",
    custom: Sequence[Sequence[str]] | None = None,
    positional: bool = False,
) -> DataFrame:
    """Run models one after the other; step i sees ``prev_prediction``.

    By name, a step gets its own features, one of which may be
    ``prev_prediction``. By position, the previous prediction comes first, then
    the numeric columns in order, cut or padded with zeros to the step's size.
    ``custom`` lists the columns of each later step. The result keeps
    ``step_<i>`` per step, with the last also as ``prev_prediction``.
    """
    if flow not in FLOWS:
        raise ValueError(f"Unknown flow '{flow}'")
    for a, b in zip(steps, steps[1:]):
        if not compatible(a.problem, b.problem):
            raise ValueError(f"A {a.problem} model cannot feed a {b.problem} model")
    numbers = classify(df)["numeric"]
    out = df
    for i, step in enumerate(steps):
        names = list(step.features)
        if i and (positional or flow != "with_original"):
            source = ["prev_prediction"]
            if flow == "custom":
                source += list((custom or [[]] * len(steps))[i])
            elif flow == "with_original":
                source += numbers
            cells = [col(c).cast("double") for c in source][: len(names)]
            cells += [F.lit(0.0)] * (len(names) - len(cells))
            saved = {f"_saved{j}": col(n) for j, n in enumerate(names) if n in out.columns}
            fed = out.withColumns(saved) if saved else out
            fed = fed.withColumns({f"_in{j}": c for j, c in enumerate(cells)})
            fed = fed.withColumns({n: F.col(f"_in{j}") for j, n in enumerate(names)})
            got = step.score(fed)
            back = {n: F.col(f"_saved{j}") for j, n in enumerate(names) if f"_saved{j}" in saved}
            got = got.withColumns(back) if back else got
            got = got.drop(*saved, *[f"_in{j}" for j in range(len(cells))])
            got = got.drop(*[n for n in names if n not in out.columns])
        else:
            got = step.score(out)
        got = got.withColumn(f"step_{i + 1}", F.col(PREDICTION)).drop("_probability")
        out = got.drop("prev_prediction").withColumnRenamed(PREDICTION, "prev_prediction")
    return out


def chain_report(done: DataFrame, steps: int) -> DataFrame:
    """Per step: rows, and mean, deviation and range of its predictions."""
    wide, records = [], []
    for i in range(1, steps + 1):
        x = F.col(f"step_{i}")
        wide += [
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"m{i}"),
            F.stddev_pop(x).alias(f"s{i}"),
            F.min(x).alias(f"lo{i}"),
            F.max(x).alias(f"hi{i}"),
        ]
        records.append(
            {
                "step": F.lit(i).cast("long"),
                "rows": F.col(f"n{i}"),
                "mean": F.col(f"m{i}"),
                "std": F.col(f"s{i}"),
                "min": F.col(f"lo{i}"),
                "max": F.col(f"hi{i}"),
            }
        )
    return rows_from(done.agg(*wide), records)


def _meta_columns(out: DataFrame, i: int, classes: Sequence[Any], with_proba: bool) -> DataFrame:
    """Flatten one member's output to meta-feature columns ``meta_<i>[_<class>]``."""
    if with_proba and "_probability" in out.columns:
        new = {f"meta_{i}_{j}": F.get("_probability", F.lit(j)) for j in range(len(classes))}
        return out.withColumns(new).drop("_probability", PREDICTION)
    return out.withColumnRenamed(PREDICTION, f"meta_{i}").drop("_probability")


@dataclass
class Stack:
    """Base models and the model that learns from their predictions."""

    bases: list[Trained]
    meta: Trained
    probabilities: bool
    info: dict[str, Any] = field(default_factory=dict)
    model_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    algorithm: str = "Stack"

    @property
    def parts(self) -> list[Any]:
        return [*self.bases, self.meta]

    @property
    def params(self) -> dict[str, Any]:
        return {"probabilities": self.probabilities}

    @classmethod
    def of_parts(cls, parts: Sequence[Any], params: dict[str, Any], info: dict[str, Any], model_id: str) -> Stack:
        return cls(list(parts[:-1]), parts[-1], params["probabilities"], info, model_id)

    @property
    def problem(self) -> str:
        return self.meta.problem

    @property
    def target(self) -> str:
        return self.meta.target

    @property
    def classes(self) -> list[Any]:
        return self.meta.classes

    @property
    def features(self) -> list[str]:
        return list(dict.fromkeys(f for m in self.bases for f in m.features))

    def meta_features(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.bases):
            out = _meta_columns(m.score(out), i, m.classes, self.probabilities)
        return out

    def score(self, df: DataFrame) -> DataFrame:
        done = self.meta.score(self.meta_features(df))
        return done.drop(*[c for c in done.columns if c.startswith("meta_")])


Base = tuple[str, dict[str, Any]]


def out_of_fold(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    bases: Sequence[Base],
    keys: Sequence[str],
    k: int = 5,
    problem: str | None = None,
    probabilities: bool = True,
    seed: int = 42,
) -> DataFrame:
    """Every row with the predictions of models that never saw it.

    Folds hold the same share of each class, and all models number the classes
    of the whole table, also those that their folds lack.
    """
    problem = problem or prepare.problem_type(df, target)
    names = list(dict.fromkeys([*keys, target, *features]))
    rows = df.select(*[col(c) for c in names]).na.drop(subset=[target, *features])
    rows = sampling.folds(rows, k, keys, seed, target if problem == "classification" else None, "_fold")
    with cached(rows) as rows:
        classes = _classes(rows, target, problem)

        def one(f: int, base: Base) -> Trained:
            seen = rows.filter(F.col("_fold") != f)
            return models.fit(
                seen, target, features, base[0], problem, base[1], keys=keys, seed=seed, classes=classes
            )

        jobs = [partial(one, f, base) for f in range(k) for base in bases]
        fitted = in_parallel(df.sparkSession, jobs)
        parts = None
        for f in range(k):
            held = rows.filter(F.col("_fold") == f)
            for i in range(len(bases)):
                m = fitted[f * len(bases) + i]
                held = _meta_columns(m.score(held), i, m.classes, probabilities)
            parts = held if parts is None else parts.unionByName(held)
        return checkpoint(parts.drop("_fold"))


def stacking(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    bases: Sequence[Base],
    meta: Base,
    keys: Sequence[str],
    k: int = 5,
    passthrough: bool = False,
    probabilities: bool = True,
    problem: str | None = None,
    seed: int = 42,
) -> tuple[Stack, DataFrame]:
    """(stack, out-of-fold table). Base models are refitted on all rows."""
    if len(bases) < 2:
        raise ValueError("At least two base models")
    problem = problem or prepare.problem_type(df, target)
    held_out = out_of_fold(df, target, features, bases, keys, k, problem, probabilities, seed)
    inputs = [c for c in held_out.columns if c.startswith("meta_")]
    inputs += list(features) if passthrough else []
    classes = _classes(held_out, target, problem)
    learner = models.fit(
        held_out, target, inputs, meta[0], problem, meta[1], keys=keys, seed=seed, classes=classes
    )
    full = [
        models.fit(df, target, features, a, problem, p, keys=keys, seed=seed, classes=classes)
        for a, p in bases
    ]
    return Stack(full, learner, probabilities), held_out


def meta_summary(held_out: DataFrame) -> DataFrame:
    """Mean and deviation of each meta-feature."""
    names = [c for c in held_out.columns if c.startswith("meta_")]
    wide, records = [], []
    for i, c in enumerate(names):
        wide += [F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}")]
        records.append(
            {"feature": F.lit(c), "mean": F.col(f"m{i}"), "std": F.col(f"s{i}")}
        )
    return rows_from(held_out.agg(*wide), records)


def meta_correlations(held_out: DataFrame, above: float = 0.9) -> DataFrame:
    """Pairs of meta-features that say nearly the same."""
    names = [c for c in held_out.columns if c.startswith("meta_")]
    return high_correlations(correlations(held_out, names), above)


def compare_columns(
    df: DataFrame, actual: str, predictions: Sequence[str], ensemble: str, problem: str
) -> DataFrame:
    """Scores of the ensemble's and each base's prediction column, with the
    best base and the improvement over it."""
    judge = (
        metrics.classification_scores if problem == "classification" else metrics.regression_scores
    )
    best = "accuracy" if problem == "classification" else "r2"
    table = None
    for name in [ensemble, *predictions]:
        row = judge(df, actual, name).withColumn("model", F.lit(name))
        table = row if table is None else table.unionByName(row)
    table = checkpoint(table)
    top = table.filter(F.col("model") != ensemble).agg(
        F.max(best).alias("s"), F.max_by("model", F.struct(best, "model")).alias("m")
    ).first()
    gain = F.col(best) - F.lit(top["s"])
    is_ensemble = F.col("model") == ensemble
    return table.withColumns(
        {
            "best_base": F.lit(top["m"]),
            "improvement": F.when(is_ensemble, gain),
            "improvement_pct": F.when(
                is_ensemble, F.try_divide(gain * 100.0, F.abs(F.lit(top["s"])))
            ),
        }
    )


def evaluate(ensemble: Ensemble | Stack, test: DataFrame) -> DataFrame:
    """The report of an ensemble and its members on the same test rows."""
    members = ensemble.members if isinstance(ensemble, Ensemble) else ensemble.bases
    known = test.na.drop(subset=[ensemble.target, *ensemble.features])
    out, names = known, []
    for i, m in enumerate([ensemble, *members]):
        name = "ensemble" if i == 0 else f"{i}: {m.algorithm}"
        scored = m.score(out)
        guess = F.col(PREDICTION)
        if ensemble.problem == "classification":
            guess = models.class_of(guess, ensemble.classes)
        out = scored.withColumn(name, guess).drop(PREDICTION, "_probability")
        names.append(name)
    out = checkpoint(out.select(col(ensemble.target), *[col(n) for n in names]))
    return compare_columns(out, ensemble.target, names[1:], "ensemble", ensemble.problem)


def vote_table(spark: SparkSession, scores: dict[str, float]) -> DataFrame:
    """Weights by score, as a table."""
    w = score_weights(list(scores.values()))
    return spark.createDataFrame(
        [(n, float(s), float(x)) for (n, s), x in zip(scores.items(), w)],
        "model string, score double, weight double",
    )


# What a registry can build from saved parts.
models.COMPOSITES.update({"ensemble": Ensemble, "stack": Stack})

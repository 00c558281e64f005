"""Searches over parameters, scalings and algorithms."""

from __future__ import annotations

import itertools
import random
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.columns import classify, col, kind_of
from tidepool.operators import encoders, models, prepare, sampling
from tidepool.operators.lookup import attach
from tidepool.operators.models import Trained
from tidepool.session import cached, checkpoint
from tidepool.sources.files import check_features

# The algorithms that a quick and a thorough search try.
QUICK = {
    "classification": ["Random Forest", "Logistic Regression", "Gradient Boosting"],
    "regression": ["Random Forest", "Linear Regression", "Gradient Boosting"],
}
THOROUGH = {
    "classification": [
        "Random Forest",
        "Logistic Regression",
        "Gradient Boosting",
        "Support Vector Machine",
        "Decision Tree",
        "K-Nearest Neighbors",
        "Naive Bayes",
    ],
    "regression": [
        "Random Forest",
        "Linear Regression",
        "Ridge Regression",
        "Lasso Regression",
        "Gradient Boosting",
        "Support Vector Regression",
        "Decision Tree",
        "K-Nearest Neighbors",
    ],
}


def combinations(
    grid: dict[str, Sequence[Any]], draws: int | None = None, seed: int = 42
) -> list[dict[str, Any]]:
    """The full grid, or that many distinct random points of it."""
    every = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    if draws is None or draws >= len(every):
        return every
    return random.Random(seed).sample(every, draws)


def search(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    algorithm: str,
    keys: Sequence[str],
    grid: dict[str, Sequence[Any]],
    draws: int | None = None,
    folds: int = 5,
    problem: str | None = None,
    seed: int = 42,
    **options: Any,
) -> tuple[dict[str, Any], list[tuple[dict[str, Any], float, float]]]:
    """(best parameters, [(parameters, mean score, deviation)]), by folds."""
    problem = problem or prepare.problem_type(df, target)
    tried = []
    for params in combinations(grid, draws, seed):
        scores = models.cross_validate(
            df, target, features, algorithm, keys, folds, seed, problem, params=params, **options
        )
        tried.append((params, float(np.mean(scores)), float(np.std(scores))))
    best = max(tried, key=lambda t: t[1])
    return best[0], tried


def search_table(spark: SparkSession, tried) -> DataFrame:
    rows = [(str(p), m, s) for p, m, s in tried]
    return spark.createDataFrame(
        rows, "params string, cv_mean double, cv_std double"
    ).orderBy(F.desc("cv_mean"), "params")


@dataclass
class Experiment:
    """What an automatic search tried, and the model it would use."""

    best: Trained
    entries: list[dict[str, Any]]
    log: list[str] = field(default_factory=list)

    def leaderboard(self, spark: SparkSession) -> DataFrame:
        rows = [
            (
                i + 1, e["algorithm"], e["scaling"], e["cv"], e["test"], str(e["params"]),
                e["improvement_pct"],
            )
            for i, e in enumerate(self.entries)
        ]
        return spark.createDataFrame(
            rows,
            "rank long, algorithm string, scaling string, cv_score double, test_score double, "
            "params string, improvement_pct double",
        )


def run(
    df: DataFrame,
    target: str,
    keys: Sequence[str],
    features: Sequence[str] | None = None,
    thorough: bool = False,
    scalings: Sequence[str] = prepare.SCALINGS,
    algorithms: Sequence[str] | None = None,
    grids: dict[str, dict[str, Sequence[Any]]] | None = None,
    selection: str | None = None,
    folds: int = 5,
    test_size: float = 0.2,
    time_budget: float | None = None,
    select_by: str = "cv",
    seed: int = 42,
    draws: int | None = None,
) -> Experiment:
    """Try algorithms × scalings × parameters on a cached training part.

    Without ``features`` all numeric columns serve. ``draws`` limits each grid
    to so many random points; without it all are tried. The time budget is checked between combinations, and a failing one is logged. The ranking
    is by fold score, or by ``select_by="test"`` as an optimistic alternative.
    """
    if features is None:
        kinds = classify(df)["numeric"]
        features = [c for c in kinds if c != target and c not in keys]
    if len(features) < 1:
        raise ValueError("No numeric features")
    problem = prepare.problem_type(df, target)
    names = list(dict.fromkeys([*keys, target, *features]))
    rows = df.select(*[col(c) for c in names]).na.drop(subset=[target, *features])
    train, test = sampling.split(rows, keys, test_size, seed)
    started, log, entries, fitted = time.monotonic(), [], [], []
    with cached(train) as train, cached(test) as test:
        if selection:
            features = models.select_features(train, target, features, selection, problem=problem)
            log.append(f"features: {', '.join(features)}")
        chosen = algorithms or (THOROUGH if thorough else QUICK)[problem]
        for algorithm, scaling in itertools.product(chosen, scalings):
            if time_budget is not None and time.monotonic() - started > time_budget:
                log.append("time budget used up")
                break
            grid = (grids or {}).get(algorithm)
            if grid is None:
                grid = models.parameter_grid(algorithm, thorough)
            try:
                params, tried = search(
                    train, target, features, algorithm, keys, grid,
                    draws, folds, problem, seed, scaling=scaling,
                )
                model = models.fit(
                    train, target, features, algorithm, problem, params, scaling,
                    keys=keys, seed=seed,
                )
                score = models.main_score(problem, models.evaluate(model, test))
            except Exception as e:  # one bad combination must not end the search
                log.append(f"{algorithm}, {scaling}: failed: {str(e).splitlines()[0]}")
                continue
            entries.append(
                {
                    "algorithm": algorithm, "scaling": scaling, "params": params,
                    "cv": max(m for _, m, _ in tried), "test": score,
                }
            )
            fitted.append(model)
            log.append(f"{algorithm}, {scaling}: cv {entries[-1]['cv']:.4f}, test {score:.4f}")
    if not entries:
        raise ValueError("No combination could be trained: " + "; ".join(log))
    order = sorted(range(len(entries)), key=lambda i: -entries[i][select_by])
    worst = entries[order[-1]][select_by]
    for e in entries:
        e["improvement_pct"] = (e[select_by] - worst) / abs(worst) * 100 if worst else None
    return Experiment(fitted[order[0]], [entries[i] for i in order], log)


ENCODINGS = ("onehot", "label", "target", "frequency")


@dataclass
class Encoder:
    """A text feature as numbers, fitted on training rows.

    A value that training did not hold has no one-hot column, label −1,
    frequency 0 and the mean target of all training rows.
    """

    feature: str
    encoding: str
    names: list[str]
    values: tuple[list[Any], bool] | None = None
    table: DataFrame | None = None
    default: float = 0.0

    @classmethod
    def fit(cls, train: DataFrame, feature: str, target: str, encoding: str) -> Encoder:
        if encoding == "onehot":
            values = encoders.one_hot_values(train, feature)
            names = [f"{feature}_{v}" for v in values[0]] + [f"{feature}_nan"] * values[1]
            return cls(feature, encoding, names, values)
        known = train.filter(col(feature).isNotNull())
        if encoding == "label":
            name, default = f"{feature}_label_encoded", -1.0
            table = encoders.label_codes(train, feature).drop("_rows")
        elif encoding == "frequency":
            name, default = f"{feature}_frequency", 0.0
            table = known.groupBy(col(feature)).agg(F.count(F.lit(1)).alias(name))
        elif encoding == "target":
            name = f"{feature}_target_encoded"
            default = train.agg(F.avg(col(target))).first()[0]
            table = known.groupBy(col(feature)).agg(F.avg(col(target)).alias(name))
        else:
            raise ValueError(f"Unknown encoding '{encoding}'")
        return cls(feature, encoding, [name], None, checkpoint(table), default)

    def apply(self, df: DataFrame) -> DataFrame:
        df = df.drop(*[n for n in self.names if n in df.columns])
        if self.values is not None:
            out = encoders.one_hot(df, self.feature, self.values)
            return out.withColumns({n: col(n).cast("double") for n in self.names}) if self.names else out
        out = attach(df, self.table, [self.feature])
        name = self.names[0]
        return out.withColumn(name, F.coalesce(col(name).cast("double"), F.lit(self.default)))


@dataclass
class Prepared:
    """A model with all that raw rows need before it: fills and encoders."""

    trained: Trained
    features: list[str]
    fill: dict[str, Any]
    encoders: list[Encoder]
    info: dict[str, Any] = field(default_factory=dict)
    model_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])

    @property
    def algorithm(self) -> str:
        return self.trained.algorithm

    @property
    def problem(self) -> str:
        return self.trained.problem

    @property
    def target(self) -> str:
        return self.trained.target

    @property
    def classes(self) -> list[Any]:
        return self.trained.classes

    @property
    def params(self) -> dict[str, Any]:
        kept = [{"feature": e.feature, "encoding": e.encoding, "names": e.names, "values": e.values, "default": e.default}
                for e in self.encoders]
        return {"features": self.features, "fill": self.fill, "encoders": kept}

    @property
    def parts(self) -> list[Any]:
        return [self.trained]

    def tables(self) -> dict[str, DataFrame]:
        return {f"encoder{i}": e.table for i, e in enumerate(self.encoders) if e.table is not None}

    @classmethod
    def of_parts(
        cls, parts: Sequence[Any], params: dict[str, Any], info: dict[str, Any], model_id: str,
        tables: dict[str, DataFrame],
    ) -> Prepared:
        made = [
            Encoder(e["feature"], e["encoding"], e["names"], tuple(e["values"]) if e["values"] else None,
                    tables.get(f"encoder{i}"), e["default"])
            for i, e in enumerate(params["encoders"])
        ]
        return cls(parts[0], params["features"], params["fill"], made, info, model_id)

    def filled(self, df: DataFrame) -> DataFrame:
        return prepare.impute(df, {f: v for f, v in self.fill.items() if v is not None and f in df.columns})

    def score(self, df: DataFrame) -> DataFrame:
        """Score raw rows; their own values of filled features are kept."""
        check_features(df, self.features)
        saved = {f"_raw{i}": col(f) for i, f in enumerate(self.features)}
        out = self.filled(df.withColumns(saved))
        for e in self.encoders:
            out = e.apply(out)
        out = self.trained.score(out)
        made = [n for e in self.encoders for n in e.names if n not in df.columns]
        back = {f: F.col(f"_raw{i}") for i, f in enumerate(self.features)}
        return out.withColumns(back).drop(*saved, *made)


models.COMPOSITES["prepared"] = Prepared


def build(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    algorithm: str,
    keys: Sequence[str],
    imputation: str = "mean",
    scaling: str = "standard",
    encoding: str = "onehot",
    selection: str | None = None,
    n_features: int = 5,
    grid: dict[str, Sequence[Any]] | None = None,
    draws: int | None = None,
    params: dict[str, Any] | None = None,
    test_size: float = 0.2,
    folds: int = 5,
    seed: int = 42,
) -> tuple[Prepared, dict[str, float], DataFrame]:
    """Impute, encode, scale, select, tune and train: (model, scores, steps).

    The model predicts raw rows. Only rows without a target are dropped. All
    fitted numbers, encodings too, come from the training part. ``selection`` may be ``pca`` or a feature selection.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"Unknown encoding '{encoding}'")
    spark = df.sparkSession
    problem = prepare.problem_type(df, target)
    known = df.na.drop(subset=[target])
    texts = [f for f in features if kind_of(df.schema[f].dataType) != "numeric"]
    whole = known.select(*[col(c) for c in dict.fromkeys([*keys, target, *features])])
    classed = problem == "classification"
    if classed:
        train, test = sampling.stratified_split(whole, target, keys, test_size, seed)
    else:
        train, test = sampling.split(whole, keys, test_size, seed)
    steps = [("split", "stratified" if classed else "by hash", str(test_size))]
    with cached(train) as train, cached(test) as test:
        fill = prepare.fit_imputation(train, list(features), imputation)
        steps.append(("impute", imputation, str(fill)))
        numbers = {f: v for f, v in fill.items() if f not in texts}
        ready = prepare.impute(train, {f: fill[f] for f in texts})
        made = [Encoder.fit(ready, f, target, encoding) for f in texts]
        for e in made:
            ready = e.apply(ready)
        if texts:
            steps.append(("encode", encoding, ", ".join(texts)))
        by_feature = {e.feature: e.names for e in made}
        names = [n for f in features for n in by_feature.get(f, [f])]
        extra = []
        if selection == "pca":
            extra = [models.components_stage(min(n_features, len(names)))]
            steps.append(("select", "pca", str(n_features)))
        elif selection:
            chosen_from = prepare.impute(ready, numbers)
            names = models.select_features(
                chosen_from, target, names, selection, n_features, problem, seed
            )
            steps.append(("select", selection, ", ".join(names)))
        steps.append(("scale", scaling, ", ".join(names)))
        options = {"scaling": scaling, "fill": numbers, "extra_stages": extra}
        chosen = dict(params or {})
        if grid:
            found, _ = search(
                ready, target, names, algorithm, keys, grid, draws, folds, problem, seed, **options
            )
            chosen |= found
            steps.append(("tune", "random" if draws else "grid", str(found)))
        model = models.fit(
            ready, target, names, algorithm, problem, chosen, keys=keys, seed=seed, **options
        )
        steps.append(("model", algorithm, str(model.params)))
        built = Prepared(model, list(features), fill, made)
        scores = models.evaluate(built, built.filled(test))
    table = spark.createDataFrame(
        [(i + 1, *s) for i, s in enumerate(steps)], "step int, kind string, choice string, detail string"
    )
    return built, scores, table

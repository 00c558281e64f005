"""Supervised models: fit, predict, evaluate, explain, keep.

A model is one Spark ML pipeline over named numeric columns. Imputation and
scaling are column expressions with fitted numbers inside that pipeline, so
predicting takes raw rows, in batch or from a stream.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial
from typing import Any

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import feature as MF
from pyspark.ml import regression as R
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.columns import col, require
from tidepool.operators import boosting, gradients, margins, metrics, prepare, sampling
from tidepool.operators.neighbors import NeighborModel
from tidepool.session import cached, in_parallel
from tidepool.sources.files import check_features

LABEL, FEATURES, PREDICTION = "_label", "_features", "_prediction"
MAX_DEPTH = 30

# The algorithms on offer and their defaults.
CLASSIFIERS = (
    "Logistic Regression",
    "Random Forest",
    "Support Vector Machine",
    "Decision Tree",
    "K-Nearest Neighbors",
    "Naive Bayes",
    "Gradient Boosting",
    "Neural Network",
)
REGRESSORS = (
    "Linear Regression",
    "Ridge Regression",
    "Lasso Regression",
    "Random Forest",
    "Support Vector Regression",
    "Decision Tree",
    "K-Nearest Neighbors",
    "Gradient Boosting",
)
DEFAULTS: dict[str, dict[str, Any]] = {
    "Logistic Regression": {"max_iter": 1000, "C": 1.0},
    "Random Forest": {"n_estimators": 100, "max_depth": None, "min_samples_split": 2},
    "Support Vector Machine": {"kernel": "rbf", "C": 1.0, "gamma": "scale", "max_iter": 1000},
    "Support Vector Regression": {"kernel": "rbf", "C": 1.0, "gamma": "scale", "epsilon": 0.1, "max_iter": 1000},
    "Decision Tree": {"max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1},
    "K-Nearest Neighbors": {"n_neighbors": 5, "weights": "uniform"},
    "Naive Bayes": {},
    "Linear Regression": {},
    "Ridge Regression": {"alpha": 1.0},
    "Lasso Regression": {"alpha": 1.0},
    "Gradient Boosting": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
    "Neural Network": {"hidden": 50, "max_iter": 500},
}
QUICK_GRIDS: dict[str, dict[str, list[Any]]] = {
    "Random Forest": {"n_estimators": [50, 100], "max_depth": [None, 10]},
    "Logistic Regression": {"C": [0.1, 1.0, 10.0]},
    "Gradient Boosting": {"n_estimators": [50, 100], "learning_rate": [0.1, 0.2]},
    "Linear Regression": {},
    "Ridge Regression": {"alpha": [0.1, 1.0, 10.0]},
    "Lasso Regression": {"alpha": [0.1, 1.0, 10.0]},
    "Support Vector Machine": {"C": [0.1, 1.0], "kernel": ["rbf"]},
    "Support Vector Regression": {"C": [0.1, 1.0], "kernel": ["rbf"]},
    "Decision Tree": {"max_depth": [None, 5, 10]},
    "K-Nearest Neighbors": {"n_neighbors": [3, 5, 7]},
    "Naive Bayes": {},
}
THOROUGH_GRIDS: dict[str, dict[str, list[Any]]] = {
    "Random Forest": {
        "n_estimators": [50, 100, 200],
        "max_depth": [None, 5, 10, 20],
        "min_samples_split": [2, 5, 10],
    },
    "Logistic Regression": {"C": [0.01, 0.1, 1.0, 10.0, 100.0]},
    "Gradient Boosting": {
        "n_estimators": [50, 100, 200],
        "learning_rate": [0.01, 0.1, 0.2],
        "max_depth": [3, 5, 7],
    },
    "Linear Regression": {},
    "Ridge Regression": {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]},
    "Lasso Regression": {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]},
    "Support Vector Machine": {
        "C": [0.1, 1.0, 10.0],
        "kernel": ["rbf", "linear"],
        "gamma": ["scale", "auto"],
    },
    "Support Vector Regression": {
        "C": [0.1, 1.0, 10.0],
        "kernel": ["rbf", "linear"],
        "gamma": ["scale", "auto"],
    },
    "Decision Tree": {
        "max_depth": [None, 5, 10, 20],
        "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4],
    },
    "K-Nearest Neighbors": {
        "n_neighbors": [3, 5, 7, 9, 11],
        "weights": ["uniform", "distance"],
    },
    "Naive Bayes": {},
}


def default_params(algorithm: str) -> dict[str, Any]:
    return dict(DEFAULTS.get(algorithm, {}))


def parameter_grid(algorithm: str, thorough: bool = False) -> dict[str, list[Any]]:
    return dict((THOROUGH_GRIDS if thorough else QUICK_GRIDS).get(algorithm, {}))


@dataclass
class Trained:
    """A fitted model with what is needed to use and describe it."""

    algorithm: str
    problem: str
    target: str
    features: list[str]
    classes: list[Any]
    params: dict[str, Any]
    model: Any
    inputs: list[str] = field(default_factory=list)
    model_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    info: dict[str, Any] = field(default_factory=dict)
    # Places in ``classes`` of those that the training rows held; empty if all.
    seen: list[int] = field(default_factory=list)

    def score(self, df: DataFrame) -> DataFrame:
        """Add the prediction (class number or value), and ``_probability`` if known.

        Numbers and probabilities follow ``classes``, also for a model that saw
        only some of them: the others have probability 0.
        """
        check_features(df, self.features)
        out = self.model.transform(df)
        if "_vector_probability" in out.columns:
            out = out.withColumn("_probability", vector_to_array("_vector_probability"))
        if self.seen:
            places = F.array(*[F.lit(float(i)) for i in self.seen])
            out = out.withColumn(PREDICTION, F.get(places, F.col(PREDICTION).cast("int")))
            if "_probability" in out.columns:
                at = {c: i for i, c in enumerate(self.seen)}
                cells = [F.get("_probability", F.lit(at[i])) if i in at else F.lit(0.0) for i in range(len(self.classes))]
                out = out.withColumn("_probability", F.array(*cells))
        keep = [*df.columns, PREDICTION]
        if "_probability" in out.columns:
            keep.append("_probability")
        return out.select(*[col(c) for c in keep])


def class_values(df: DataFrame, target: str) -> list[Any]:
    """The sorted class labels."""
    found = df.filter(col(target).isNotNull()).select(col(target)).distinct()
    values = [r[0] for r in found.limit(metrics.MAX_CLASSES + 1).collect()]
    if len(values) > metrics.MAX_CLASSES:
        raise ValueError(f"'{target}' has more than {metrics.MAX_CLASSES} classes")
    if len(values) < 2:
        raise ValueError(f"'{target}' needs at least two classes")
    return sorted(values)


def label_column(target: str, problem: str, classes: Sequence[Any]) -> Column:
    """The target as a number: class number, or the value itself."""
    if problem == "regression":
        return col(target).cast("double")
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), col(target))
    return F.when(place > 0, place - 1).cast("double")


def class_of(number: Column, classes: Sequence[Any]) -> Column:
    """The class label behind a class number."""
    return F.get(F.array(*[F.lit(c) for c in classes]), number.cast("int"))


def _sql(value: float) -> str:
    return f"({float(value)!r}D)" if math.isfinite(value) else "CAST(NULL AS DOUBLE)"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _input_stage(
    features: Sequence[str],
    fill: dict[str, Any],
    scaling: dict[str, tuple[float, float]],
) -> tuple[list[str], MF.SQLTransformer]:
    names, cells = [], []
    for i, f in enumerate(features):
        cell = f"CAST({_quoted(f)} AS DOUBLE)"
        if fill.get(f) is not None:
            cell = f"coalesce({cell}, {_sql(fill[f])})"
        centre, width = scaling.get(f, (0.0, 1.0))
        if (centre, width) != (0.0, 1.0):
            cell = f"({cell} - {_sql(centre)}) / {_sql(width)}"
        names.append(f"_f{i}")
        cells.append(f"{cell} AS _f{i}")
    text = f"SELECT *, {', '.join(cells)} FROM __THIS__"
    return names, MF.SQLTransformer(statement=text)


def _fourier_stage(
    inputs: Sequence[str], gamma: float, size: int, seed: int
) -> tuple[gradients.Waves, list[str], MF.SQLTransformer]:
    """Random Fourier features of an RBF kernel as plain cosine columns, and as a function on blocks."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, math.sqrt(2 * gamma), (size, len(inputs)))
    shifts = rng.uniform(0.0, 2 * math.pi, size)
    names, cells = [], []
    for i in range(size):
        terms = " + ".join(f"{_sql(w)} * {c}" for w, c in zip(weights[i], inputs))
        names.append(f"_r{i}")
        cells.append(f"{_sql(math.sqrt(2 / size))} * cos({terms} + {_sql(shifts[i])}) AS _r{i}")
    waves = gradients.Waves(list(inputs), weights, shifts, math.sqrt(2 / size))
    return waves, names, MF.SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__")


def _depth(value: int | None) -> int:
    if value is not None and int(value) > MAX_DEPTH:
        raise ValueError(f"max_depth is at most {MAX_DEPTH}; None asks for the deepest tree")
    return MAX_DEPTH if value is None else int(value)


def _leaf(params: dict[str, Any]) -> int:
    """Spark bounds leaves, not splits: a split of n rows leaves at least 1."""
    return max(int(params.get("min_samples_leaf", 1)), int(params.get("min_samples_split", 2)) // 2)


def _estimator(
    algorithm: str,
    problem: str,
    params: dict[str, Any],
    n_classes: int,
    n_inputs: int,
    seed: int,
    vector: str = FEATURES,
):
    cols = {"featuresCol": vector, "labelCol": LABEL, "predictionCol": PREDICTION}
    proba = {"probabilityCol": "_vector_probability"}
    p = params
    if problem == "classification":
        if algorithm == "Logistic Regression":
            return C.LogisticRegression(
                **cols, **proba, maxIter=int(p["max_iter"]), regParam=p.get("reg", 0.0),
                standardization=False,
            )
        if algorithm == "Random Forest":
            return C.RandomForestClassifier(
                **cols, **proba, numTrees=p["n_estimators"], maxDepth=_depth(p["max_depth"]),
                minInstancesPerNode=_leaf(p), seed=seed,
            )
        if algorithm == "Decision Tree":
            return C.DecisionTreeClassifier(
                **cols, **proba, maxDepth=_depth(p["max_depth"]), minInstancesPerNode=_leaf(p), seed=seed
            )
        if algorithm == "Naive Bayes":
            return C.NaiveBayes(**cols, **proba, modelType="gaussian")
        if algorithm == "Gradient Boosting":
            return C.GBTClassifier(
                **cols, **proba, maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=p["max_depth"], seed=seed
            )
        if algorithm == "Neural Network":
            return C.MultilayerPerceptronClassifier(
                **cols, **proba, layers=[n_inputs, int(p["hidden"]), n_classes],
                maxIter=int(p["max_iter"]), seed=seed,
            )
    else:
        if algorithm == "Linear Regression":
            return R.LinearRegression(**cols)
        if algorithm == "Ridge Regression":
            return R.LinearRegression(**cols, regParam=p.get("reg", 0.0), elasticNetParam=0.0, standardization=False)
        if algorithm == "Lasso Regression":
            return R.LinearRegression(**cols, regParam=p.get("reg", 0.0), elasticNetParam=1.0, standardization=False)
        if algorithm == "Random Forest":
            return R.RandomForestRegressor(
                **cols, numTrees=p["n_estimators"], maxDepth=_depth(p["max_depth"]),
                minInstancesPerNode=_leaf(p), seed=seed,
            )
        if algorithm == "Decision Tree":
            return R.DecisionTreeRegressor(
                **cols, maxDepth=_depth(p["max_depth"]), minInstancesPerNode=_leaf(p), seed=seed
            )
        if algorithm == "Gradient Boosting":
            return R.GBTRegressor(
                **cols, maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=p["max_depth"], seed=seed
            )
    raise ValueError(f"'{algorithm}' is not available for {problem}")


def _expressions(
    algorithm: str, problem: str, params: dict[str, Any], n_classes: int, seed: int
) -> Callable[[DataFrame, list[str], gradients.Waves | None], list[MF.SQLTransformer]] | None:
    """For a model that becomes a column expression, its fit on (rows, inputs, what makes them)."""
    p = params
    if algorithm == "Support Vector Machine":
        return lambda rows, inputs, lift: margins.support_vectors(
            rows, inputs, LABEL, n_classes, PREDICTION, "_probability", p["C"], int(p["max_iter"]), lift
        )
    if algorithm == "Support Vector Regression":
        return lambda rows, inputs, lift: [
            gradients.tube(rows, inputs, LABEL, PREDICTION, p["C"], p.get("epsilon", 0.1), int(p["max_iter"]), lift)
        ]
    if algorithm == "Neural Network" and problem == "regression":
        return lambda rows, inputs, lift: [
            gradients.network(rows, inputs, LABEL, PREDICTION, int(p["hidden"]), int(p["max_iter"]), seed=seed)
        ]
    if algorithm == "Gradient Boosting" and n_classes > 2:
        return lambda rows, inputs, lift: boosting.softmax(
            rows, inputs, LABEL, n_classes, PREDICTION, "_probability",
            p["n_estimators"], p["learning_rate"], p["max_depth"], seed,
        )
    return None


def _component_stage(pca: Any, inputs: Sequence[str]) -> tuple[list[str], MF.SQLTransformer]:
    """The components of a fitted PCA as columns."""
    weights = pca.pc.toArray()
    names = [f"_c{i}" for i in range(weights.shape[1])]
    cells = [f"{gradients.weighted(weights[:, i], inputs, 0.0)} AS {c}" for i, c in enumerate(names)]
    return names, MF.SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__")


def fit(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    algorithm: str,
    problem: str | None = None,
    params: dict[str, Any] | None = None,
    scaling: str = "none",
    fill: dict[str, Any] | None = None,
    keys: Sequence[str] = (),
    extra_stages: Sequence[MF.PCA] = (),
    fourier_size: int = 64,
    seed: int = 42,
    classes: Sequence[Any] | None = None,
) -> Trained:
    """Fit one model. Rows with a missing target or feature are left out,
    unless ``fill`` replaces the missing features.

    ``classes`` is the sorted list of all classes, for models that must number
    them alike although one of them may not see every class; without it the
    classes are those of ``df``.

    ``extra_stages`` (see ``components_stage``) sit before the model.
    ``keys`` identify rows; nearest neighbours need them to break ties.
    """
    features = list(features)
    check_features(df, [*features, target])
    require(df, features, "numeric")
    problem = problem or prepare.problem_type(df, target)
    allowed = CLASSIFIERS if problem == "classification" else (*REGRESSORS, "Neural Network")
    if algorithm not in allowed:
        raise ValueError(f"'{algorithm}' is not available for {problem}")
    settings = {**default_params(algorithm), **(params or {})}
    fill = fill or {}
    needed = [target] + [f for f in features if fill.get(f) is None]
    names = list(dict.fromkeys([*keys, target, *features]))
    # Several passes follow; they all read this narrow table.
    with cached(df.select(*[col(c) for c in names]).na.drop(subset=needed)) as rows:
        return _fit_rows(
            rows, target, features, algorithm, problem, settings, scaling, fill, keys,
            extra_stages, fourier_size, seed, classes,
        )


def _penalty(rows: DataFrame, target: str, algorithm: str, settings: dict[str, Any]) -> float:
    """Spark's regParam for a usual C or alpha.

    Spark penalises the mean loss, C and ridge alpha weigh the summed loss;
    Spark also measures a ridge penalty in deviations of the target.
    """
    n, spread = rows.agg(
        F.count(F.lit(1)),
        F.stddev_pop(col(target).cast("double")) if "alpha" in settings else F.lit(1.0),
    ).first()
    if not n:
        raise ValueError("No complete rows to train on")
    if "C" in settings:
        return 1.0 / (settings["C"] * n)
    if algorithm.startswith("Ridge"):
        return settings["alpha"] / n * spread
    return float(settings["alpha"])


def _fit_rows(
    rows, target, features, algorithm, problem, settings, scaling, fill, keys, extra_stages,
    fourier_size, seed, classes,
) -> Trained:
    own = class_values(rows, target) if problem == "classification" else []
    every = list(classes) if own and classes is not None else own
    seen = [] if every == own else [every.index(c) for c in own]
    classes = own
    kernel = algorithm.startswith("Support Vector") and settings.get("kernel") == "rbf"
    filled = prepare.impute(rows, {f: fill[f] for f in features if fill.get(f) is not None})
    widths = prepare.fit_scaling(filled, features, scaling)
    if "C" in settings or "alpha" in settings:
        settings["reg"] = _penalty(rows, target, algorithm, settings)
    if algorithm == "K-Nearest Neighbors":
        if not keys:
            raise ValueError("K-Nearest Neighbors needs the key columns of a row")
        model = NeighborModel.fit(
            rows, features, label_column(target, problem, classes), keys, problem,
            max(len(classes), 1), int(settings["n_neighbors"]), settings["weights"], widths, fill,
        )
        return Trained(algorithm, problem, target, features, every, settings, model, features, seen=seen)
    inputs, stage = _input_stage(features, fill, widths)
    stages: list[Any] = [stage]
    lift = None
    if kernel:
        gamma = 1.0 / len(features)
        if settings.get("gamma", "scale") == "scale":
            marks = []
            for f in features:
                x = prepare.scaled(f, widths[f])
                marks += [F.avg(x), F.avg(x * x)]
            row = filled.agg(*marks).first()
            mean = sum(row[0::2]) / len(features)
            spread = sum(row[1::2]) / len(features) - mean * mean
            gamma = 1.0 / (len(features) * spread) if spread > 0 else gamma
        lift, inputs, more = _fourier_stage(inputs, gamma, fourier_size, seed)
        stages.append(more)
    data = rows.select(
        label_column(target, problem, classes).alias(LABEL),
        *[col(f) for f in dict.fromkeys(features)],
    )
    assembler = MF.VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="error")
    own_fit = _expressions(algorithm, problem, settings, len(classes), seed)
    if own_fit:
        columns = inputs
        for extra in extra_stages:
            front = Pipeline(stages=[*stages, assembler, extra]).fit(data)
            columns, more = _component_stage(front.stages[-1], columns)
            stages.append(more)
        lift = None if extra_stages else lift
        ready = PipelineModel(stages).transform(data).select(LABEL, *columns, *(lift.inputs if lift else []))
        model = PipelineModel([*stages, *own_fit(ready, columns, lift)])
    else:
        stages += [assembler, *extra_stages]
        n_inputs, vector = len(inputs), FEATURES
        if extra_stages:
            n_inputs, vector = extra_stages[-1].getK(), extra_stages[-1].getOutputCol()
        stages.append(
            _estimator(algorithm, problem, settings, len(classes), n_inputs, seed, vector)
        )
        model = Pipeline(stages=stages).fit(data)
    return Trained(
        algorithm, problem, target, features, every, settings, model,
        inputs if not kernel else features, seen=seen,
    )


def predict(trained: Trained, df: DataFrame) -> DataFrame:
    """Add ``Predicted_<target>``, and ``Probability_<class>`` where known."""
    out = trained.score(df)
    name = f"Predicted_{trained.target}"
    if trained.problem == "regression":
        return out.withColumnRenamed(PREDICTION, name)
    new = {name: class_of(F.col(PREDICTION), trained.classes)}
    if "_probability" in out.columns:
        for i, c in enumerate(trained.classes):
            new[f"Probability_{c}"] = F.get("_probability", F.lit(i))
    return out.withColumns(new).drop(PREDICTION, "_probability")


def evaluate(trained: Trained, df: DataFrame) -> dict[str, float]:
    """Scores on rows with a known target."""
    known = df.na.drop(subset=[trained.target, *trained.features])
    scored = predict(trained, known)
    guess = f"Predicted_{trained.target}"
    judge = (
        metrics.classification_scores
        if trained.problem == "classification"
        else metrics.regression_scores
    )
    return judge(scored, trained.target, guess).first().asDict()


def main_score(problem: str, scores: dict[str, float]) -> float | None:
    return scores["accuracy"] if problem == "classification" else scores["r2"]


def cross_validate(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    algorithm: str,
    keys: Sequence[str],
    k: int = 5,
    seed: int = 42,
    problem: str | None = None,
    **options: Any,
) -> list[float]:
    """Accuracy or R² per fold. For values, folds come from row hashes, so each
    fold is a plain filter; for classes they hold the same share of each."""
    if not 2 <= k <= 10:
        raise ValueError("2 to 10 folds")
    problem = problem or prepare.problem_type(df, target)
    cols = list(dict.fromkeys([*keys, target, *features]))
    known = df.select(*[col(c) for c in cols]).na.drop(subset=[target])
    classed = problem == "classification"
    data = sampling.folds(known, k, keys, seed, target if classed else None, "_fold")
    classes = class_values(known, target) if classed else None
    with cached(data) as data:
        def one(i: int) -> float:
            trained = fit(
                data.filter(F.col("_fold") != i), target, features, algorithm,
                problem=problem, keys=keys, seed=seed, classes=classes, **options,
            )
            scores = evaluate(trained, data.filter(F.col("_fold") == i))
            return main_score(problem, scores)

        return in_parallel(df.sparkSession, [partial(one, i) for i in range(k)])


def fold_table(spark: SparkSession, scores: Sequence[float]) -> DataFrame:
    """Per-fold scores with mean, population deviation, range and stability."""
    mean = float(np.mean(scores))
    std = float(np.std(scores))
    stability = std / mean * 100 if mean else None
    rows = [
        (i, s, mean, std, min(scores), max(scores), stability) for i, s in enumerate(scores)
    ]
    return spark.createDataFrame(
        rows,
        "fold int, score double, mean double, std double, min double, max double, stability_pct double",
    )


def train(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    algorithm: str,
    keys: Sequence[str],
    test_size: float = 0.2,
    seed: int = 42,
    folds: int = 0,
    **options: Any,
) -> tuple[Trained, dict[str, float], DataFrame]:
    """Split, fit, and score on the test part: (model, scores, test rows)."""
    if not 0.1 <= test_size <= 0.5:
        raise ValueError("test_size must be between 0.1 and 0.5")
    clean = df.na.drop(subset=[target])
    a, b = sampling.split(clean, keys, test_size, seed)
    trained = fit(a, target, features, algorithm, keys=keys, seed=seed, **options)
    scores = evaluate(trained, b)
    if folds:
        cv = cross_validate(
            a, target, features, algorithm, keys, folds, seed, trained.problem, **options
        )
        trained.info["cv"] = cv
        scores |= {"cv_mean": float(np.mean(cv)), "cv_std": float(np.std(cv))}
    trained.info["scores"] = scores
    return trained, scores, b


def _last(trained: Trained) -> Any:
    return trained.model.stages[-1] if isinstance(trained.model, PipelineModel) else trained.model


def _table(spark: SparkSession, names: Sequence[str], values: Sequence[float], label: str) -> DataFrame:
    rows = [(str(n), float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, f"feature string, {label} double").orderBy(
        F.abs(label).desc(), "feature"
    )


def importances(trained: Trained, spark: SparkSession, top: int | None = None) -> DataFrame:
    """Feature importances of a tree model, or coefficients of a linear one.

    Coefficients of a model with many classes are those of the first class.
    """
    last = _last(trained)
    if hasattr(last, "featureImportances"):
        got = _table(spark, trained.features, last.featureImportances.toArray(), "importance")
    elif hasattr(last, "coefficientMatrix") and len(trained.classes) > 2:
        got = _table(spark, trained.features, last.coefficientMatrix.toArray()[0], "coefficient")
    elif hasattr(last, "coefficients"):
        values = last.coefficients.toArray()
        names = trained.features if len(values) == len(trained.features) else [
            f"component {i}" for i in range(len(values))
        ]
        got = _table(spark, names, values, "coefficient")
    else:
        raise ValueError(f"'{trained.algorithm}' has no importances")
    return got.limit(top) if top else got


def compare(models: Sequence[Trained], test: DataFrame) -> DataFrame:
    """All models, ensembles and stacks on the same test rows, best first by accuracy or R²."""
    problems = {m.problem for m in models}
    if len(problems) != 1:
        raise ValueError("Only models of one problem type can be compared")
    best = "accuracy" if problems == {"classification"} else "r2"
    out = None
    for m in models:
        known = predict(m, test.na.drop(subset=[m.target, *m.features]))
        judge = (
            metrics.classification_scores if best == "accuracy" else metrics.regression_scores
        )
        row = judge(known, m.target, f"Predicted_{m.target}").select(
            F.lit(m.model_id).alias("model_id"), F.lit(m.algorithm).alias("algorithm"), "*"
        )
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc_nulls_last(best), "algorithm")


# Models made of models, by kind; their module enters them here.
COMPOSITES: dict[str, Any] = {}


def _kind(trained: Any) -> str:
    for kind, made in COMPOSITES.items():
        if isinstance(trained, made):
            return kind
    return "neighbors" if isinstance(trained.model, NeighborModel) else "spark"


def summary(trained: Trained) -> dict[str, Any]:
    """What a saved model is described by."""
    last = None if _kind(trained) in COMPOSITES else _last(trained)
    out = {
        "model_id": trained.model_id,
        "algorithm": trained.algorithm,
        "problem": trained.problem,
        "target": trained.target,
        "features": trained.features,
        "classes": [str(c) for c in trained.classes],
        "params": {k: v for k, v in trained.params.items()},
        "info": trained.info,
    }
    if hasattr(last, "featureImportances"):
        out["importances"] = [float(v) for v in last.featureImportances.toArray()]
    if hasattr(last, "getNumTrees"):
        out["trees"] = int(last.getNumTrees)
    return out


class Registry:
    """Saved models under one folder: Spark ML files beside a metadata row each."""

    SCHEMA = (
        "model_id string, algorithm string, problem string, target string, "
        "features array<string>, saved_at double, size_bytes long, metadata string"
    )

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, model_id: str) -> str:
        if not model_id.isalnum():
            raise ValueError(f"Invalid model id '{model_id}'")
        return f"{self.path}/models/{model_id}"

    def save(self, trained: Trained) -> str:
        """Save a model, an ensemble or a stack; the parts of the latter are saved as models too."""
        folder, kind = self._folder(trained.model_id), _kind(trained)
        if kind in COMPOSITES:
            parts = [self.save(p) for p in trained.parts]
            tables = trained.tables() if hasattr(trained, "tables") else {}
            for name, held in tables.items():
                held.write.mode("overwrite").parquet(f"{folder}/{name}")
        elif kind == "neighbors":
            trained.model.save(folder)
        else:
            trained.model.write().overwrite().save(folder)
        extra = summary(trained) | {
            "class_values": json.dumps(trained.classes, default=str),
            "kind": kind,
        }
        if kind in COMPOSITES:
            extra |= {"parts": parts, "tables": list(tables)}
        else:
            extra |= {"inputs": trained.inputs, "seen": trained.seen}
        row = [
            (
                trained.model_id, trained.algorithm, trained.problem, trained.target,
                trained.features, time.time(), 0 if kind in COMPOSITES else self._size(folder),
                json.dumps(extra, default=str),
            )
        ]
        self.spark.createDataFrame(row, self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/metadata/{trained.model_id}"
        )
        return trained.model_id

    def listing(self) -> DataFrame:
        """Saved models, newest first."""
        try:
            rows = self.spark.read.schema(self.SCHEMA).option("recursiveFileLookup", True).parquet(
                f"{self.path}/metadata"
            )
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], self.SCHEMA)
        return rows.orderBy(F.desc("saved_at"), "model_id")

    def load(self, model_id: str) -> Trained:
        row = self.listing().filter(F.col("model_id") == model_id).first()
        if row is None:
            raise ValueError(f"Model '{model_id}' not found")
        extra = json.loads(row["metadata"])
        if extra["kind"] in COMPOSITES:
            parts = [self.load(p) for p in extra["parts"]]
            tables = {t: self.spark.read.parquet(f"{self._folder(model_id)}/{t}") for t in extra["tables"]}
            more = {"tables": tables} if tables or extra["kind"] == "prepared" else {}
            return COMPOSITES[extra["kind"]].of_parts(parts, extra["params"], extra["info"], model_id, **more)
        folder = self._folder(model_id)
        model = (
            NeighborModel.load(self.spark, folder)
            if extra["kind"] == "neighbors"
            else PipelineModel.load(folder)
        )
        return Trained(
            row["algorithm"], row["problem"], row["target"], list(row["features"]),
            json.loads(extra["class_values"]), extra["params"], model, extra["inputs"],
            model_id, extra["info"], extra.get("seen", []),
        )

    def _files(self, folder: str):
        """The folder and its file system, as the cluster sees them."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())

    def _size(self, folder: str) -> int:
        path, files = self._files(folder)
        return int(files.getContentSummary(path).getLength())

    def delete(self, model_id: str) -> None:
        for folder in (self._folder(model_id), f"{self.path}/metadata/{model_id}"):
            path, files = self._files(folder)
            files.delete(path, True)


def select_features(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    method: str,
    n: int = 5,
    problem: str | None = None,
    seed: int = 42,
) -> list[str]:
    """Names of the chosen features: ``kbest`` (F-test), ``model`` (importance
    at least the mean), or ``rfe`` (drop the weakest until ``n`` are left)."""
    problem = problem or prepare.problem_type(df, target)
    features = list(features)
    n = min(n, len(features))
    if method == "kbest":
        rows = df.na.drop(subset=[target, *features])
        classes = class_values(rows, target) if problem == "classification" else []
        data = rows.select(
            label_column(target, problem, classes).alias(LABEL),
            *[col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)],
        )
        assembled = MF.VectorAssembler(
            inputCols=[f"_f{i}" for i in range(len(features))], outputCol=FEATURES
        ).transform(data)
        chooser = MF.UnivariateFeatureSelector(
            featuresCol=FEATURES, labelCol=LABEL, outputCol="_chosen", selectionMode="numTopFeatures"
        )
        chooser.setFeatureType("continuous")
        chooser.setLabelType("categorical" if problem == "classification" else "continuous")
        chooser.setSelectionThreshold(n)
        return [features[i] for i in sorted(chooser.fit(assembled).selectedFeatures)]
    forest = {"n_estimators": 20, "max_depth": 5}

    def weights(names: list[str]) -> list[float]:
        m = fit(df, target, names, "Random Forest", problem, forest, seed=seed)
        return list(_last(m).featureImportances.toArray())

    if method == "model":
        w = weights(features)
        mean = sum(w) / len(w)
        return [f for f, v in zip(features, w) if v >= mean]
    if method == "rfe":
        left = list(features)
        while len(left) > n:
            w = weights(left)
            left.pop(int(np.argmin(w)))
        return left
    raise ValueError(f"Unknown feature selection '{method}'")


def components_stage(k: int) -> MF.PCA:
    """A PCA stage for ``fit(extra_stages=…)``; use it with standard scaling."""
    return MF.PCA(k=k, inputCol=FEATURES, outputCol="_components")

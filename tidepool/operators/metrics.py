"""Judging predictions. Class metrics come from one grouped count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.columns import col, require
from tidepool.operators.ordering import running_totals, with_position

MAX_CLASSES = 1_000


def _counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    require(df, [actual, predicted])
    return df.groupBy(col(actual).alias("actual"), col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows per (actual, predicted) over all labels of either column, zeros too."""
    counts = _counts(df, actual, predicted)
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()
    labels = labels.filter(F.col("label").isNotNull())
    found = [r[0] for r in labels.limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"More than {MAX_CLASSES} classes")
    every = F.array(*[F.lit(v) for v in sorted(found)])
    zeros = labels.select(
        F.col("label").alias("actual"), F.explode(every).alias("predicted")
    ).withColumn("n", F.lit(0).cast("long"))
    return (
        counts.unionByName(zeros)
        .groupBy("actual", "predicted")
        .agg(F.sum("n").alias("count"))
    )


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where nothing is there to divide by."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def _per_class(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("actual").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(
            F.col("actual").alias("label"),
            F.col("n").alias("s"),
            zero.alias("p"),
            hit.alias("h"),
        ),
        F.struct(
            F.col("predicted").alias("label"),
            zero.alias("s"),
            F.col("n").alias("p"),
            zero.alias("h"),
        ),
    )
    sums = (
        _counts(df, actual, predicted)
        .select(F.inline(sides))
        .groupBy("label")
        .agg(F.sum("s").alias("support"), F.sum("p").alias("_p"), F.sum("h").alias("_h"))
    )
    return sums.select(
        "label",
        _ratio(F.col("_h"), F.col("_p")).alias("precision"),
        _ratio(F.col("_h"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("_h"), F.col("_p") + F.col("support")).alias("f1"),
        "support",
        F.col("_h").alias("hits"),
    )


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per class, then accuracy, macro and weighted means."""
    per = _per_class(df, actual, predicted)
    names = ("precision", "recall", "f1")
    classes = per.select(F.col("label").cast("string").alias("label"), *names, "support")
    weight = F.sum("support")
    totals = per.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[_ratio(F.sum(F.col(m) * F.col("support")), weight).alias(f"w_{m}") for m in names],
        _ratio(F.sum("hits"), weight).alias("acc"),
        weight.alias("n"),
    )
    lines = [
        F.struct(
            F.lit("accuracy").alias("label"),
            *[F.col("acc").alias(m) for m in names],
            F.col("n").alias("support"),
        )
    ]
    for tag, title in (("macro", "macro avg"), ("w", "weighted avg")):
        lines.append(
            F.struct(
                F.lit(title).alias("label"),
                *[F.col(f"{tag}_{m}").alias(m) for m in names],
                F.col("n").alias("support"),
            )
        )
    return classes.unionByName(totals.select(F.inline(F.array(*lines))))


def classification_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: accuracy and weighted precision, recall and F1."""
    per = _per_class(df, actual, predicted)
    weight = F.sum("support")
    return per.agg(
        _ratio(F.sum("hits"), weight).alias("accuracy"),
        *[
            _ratio(F.sum(F.col(m) * F.col("support")), weight).alias(m)
            for m in ("precision", "recall", "f1")
        ],
    )


def regression_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: R², RMSE, MAE and MSE. R² is missing for a constant target."""
    require(df, [actual, predicted], "numeric")
    y, p = col(actual).cast("double"), col(predicted).cast("double")
    both = df.filter(y.isNotNull() & p.isNotNull())
    err = y - p
    sums = both.agg(
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.var_pop(y).alias("_v")
    )
    r2 = F.when(F.col("_v") > 0, 1 - F.col("mse") / F.nullif(F.col("_v"), F.lit(0.0)))
    return sums.select(r2.alias("r2"), F.sqrt("mse").alias("rmse"), "mae", "mse")


def sigmoid(score: Column) -> Column:
    """A probability from a decision score."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def roc_curve(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """One row per distinct score, highest first: rates at that threshold.

    Rows are counted per score before they are ordered, and the running
    counts come from blocks of positions, not from one window over everything.
    """
    counted = (
        df.filter(col(score).isNotNull() & positive.isNotNull())
        .groupBy(col(score).alias("threshold"))
        .agg(F.count_if(positive).alias("_pos_n"), F.count_if(~positive).alias("_neg_n"))
    )
    placed = with_position(counted, [F.desc("threshold")])
    placed = running_totals(placed, {"_tp": F.col("_pos_n"), "_fp": F.col("_neg_n")})
    p, n = placed.agg(F.sum("_pos_n"), F.sum("_neg_n")).first()
    tp, fp = F.col("_tp") + F.col("_pos_n"), F.col("_fp") + F.col("_neg_n")
    area = F.col("_neg_n") * (F.col("_tp") + F.col("_pos_n") / F.lit(2.0))
    return placed.select(
        "threshold",
        tp.alias("tp"),
        fp.alias("fp"),
        (tp / F.nullif(F.lit(p), F.lit(0))).alias("tpr"),
        (fp / F.nullif(F.lit(n), F.lit(0))).alias("fpr"),
        (area / F.nullif(F.lit(float((p or 0) * (n or 0))), F.lit(0.0))).alias("area"),
    )


def auc(curve: DataFrame) -> DataFrame:
    """Area under a ROC curve by trapezoids."""
    return curve.agg(F.sum("area").alias("auc"))


def log_loss(df: DataFrame, positive: Column, probability: str) -> DataFrame:
    """Mean negative log likelihood, probabilities clipped at 1e-15."""
    p = F.least(F.greatest(col(probability), F.lit(1e-15)), F.lit(1 - 1e-15))
    return df.agg(F.avg(-F.ln(F.when(positive, p).otherwise(1 - p))).alias("log_loss"))


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Actual, predicted and residual per row."""
    require(df, [actual, predicted], "numeric")
    return df.select(
        col(actual).alias("actual"),
        col(predicted).alias("predicted"),
        (col(actual) - col(predicted)).alias("residual"),
    )


def prediction_bounds(pairs: DataFrame) -> DataFrame:
    """The common range of actual and predicted values."""
    return pairs.agg(
        F.least(F.min("actual"), F.min("predicted")).alias("low"),
        F.greatest(F.max("actual"), F.max("predicted")).alias("high"),
    )

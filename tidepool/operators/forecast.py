"""Additive forecasts: trend with changepoints plus Fourier seasons.

The design row is a Spark array expression. Tasks sum its normal equations per
series, so a series of any length reduces to a few numbers per task; each
series is then a small linear solve, and predicting is again an expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.columns import col, require
from tidepool.operators.lookup import attach
from tidepool.operators.quantiles import group_quantiles
from tidepool.session import checkpoint

DAY = 86_400.0
MIN_ROWS = 10
MAX_PERIODS = 365
# Fixed values: (period in days, Fourier order) of each season.
SEASONS = {"yearly": (365.25, 10), "weekly": (7.0, 3), "daily": (1.0, 4)}
CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
# Ridge weights on the scaled series: hinges are held back, seasons barely.
HINGE_PENALTY = 1.0
SEASON_PENALTY = 2.5e-5
TREND_PENALTY = 1e-8
# A task keeps this many series' sums before it passes them on.
OPEN_SERIES = 2_000


@dataclass(frozen=True)
class Layout:
    """Which columns of the design row mean what."""

    seasons: tuple[str, ...] = ("yearly", "weekly")
    changepoints: int = CHANGEPOINTS

    @property
    def trend(self) -> int:
        return 2 + self.changepoints

    @property
    def width(self) -> int:
        return self.trend + sum(2 * SEASONS[s][1] for s in self.seasons)

    def span(self, part: str) -> tuple[int, int]:
        """(start, length) of a component in the design row."""
        if part == "trend":
            return 0, self.trend
        start = self.trend
        for s in self.seasons:
            if s == part:
                return start, 2 * SEASONS[s][1]
            start += 2 * SEASONS[s][1]
        raise ValueError(f"Unknown component '{part}'")

    def penalties(self) -> np.ndarray:
        out = np.full(self.width, SEASON_PENALTY)
        out[:2] = TREND_PENALTY
        out[2 : self.trend] = HINGE_PENALTY
        return out


def seconds(when: Column) -> Column:
    """Seconds since 1970, free of any time zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, when.cast("timestamp_ntz")) / F.lit(1e6)


def terms(layout: Layout) -> list[tuple[str, float]]:
    """The design row as (kind, number): level, slope, hinges, sines, cosines."""
    out = [("level", 0.0), ("slope", 0.0)]
    for i in range(layout.changepoints):
        out.append(("hinge", CHANGEPOINT_RANGE * (i + 1) / (layout.changepoints + 1)))
    for name in layout.seasons:
        period, order = SEASONS[name]
        for n in range(1, order + 1):
            turn = 2 * math.pi * n / (period * DAY)
            out += [("sin", turn), ("cos", turn)]
    return out


# Each term for arrays inside tasks: ``s`` is the time in seconds, ``t`` the
# place within the fitted history.
_ON_ARRAYS = {
    "level": lambda s, t, x: np.ones(len(s)),
    "slope": lambda s, t, x: t,
    "hinge": lambda s, t, x: np.maximum(t - x, 0.0),
    "sin": lambda s, t, x: np.sin(s * x),
    "cos": lambda s, t, x: np.cos(s * x),
}


def segments(weights: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """The trend as one (level, slope) per stretch between changepoints."""
    at = np.array([x for kind, x in terms(layout) if kind == "hinge"])
    bends = weights[2 : layout.trend]
    slopes = weights[1] + np.concatenate([[0.0], np.cumsum(bends)])
    levels = weights[0] - np.concatenate([[0.0], np.cumsum(bends * at)])
    return levels, slopes


def _part(layout: Layout, name: str) -> Column:
    """One component in the series' own scale. The trend looks up its stretch,
    which keeps the expression, and so the compiled code, small."""
    if name == "trend":
        n = layout.changepoints
        step = (n + 1) / CHANGEPOINT_RANGE
        k = f"cast(least(greatest(floor(_t * {step!r}D), 0), {n}) as int)"
        return F.expr(f"scale * (get(levels, {k}) + get(slopes, {k}) * _t)")
    start, length = layout.span(name)
    cells = [
        f"get(weights, {start + i}) * {kind}(_s * {x!r}D)"
        for i, (kind, x) in enumerate(terms(layout)[start : start + length])
    ]
    return F.expr(f"scale * ({' + '.join(cells)})")


# Places where the partial sums of a series are added before the last addition.
PLACES = 64


def _sums(layout: Layout):
    width, row = layout.width, terms(layout)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame(
                {"_series": list(held), "_sums": [v.ravel() for v in held.values()]}
            )

        for batch in batches:
            if not len(batch):
                continue
            s, first, last, y = (
                batch[c].to_numpy(dtype=float) for c in ("_s", "first", "last", "_y")
            )
            t = (s - first) / (last - first)
            rows = np.column_stack([*[_ON_ARRAYS[k](s, t, x) for k, x in row], y])
            for key, places in batch.groupby("_series").indices.items():
                part = rows[places]
                got = part.T @ part
                held[key] = held[key] + got if key in held else got
            if len(held) > OPEN_SERIES:
                yield out()
                held.clear()
        if held:
            yield out()

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((width + 1, width + 1))
        for s in group["_sums"]:
            total += np.asarray(s).reshape(width + 1, width + 1)
        left = total[:width, :width] + np.diag(layout.penalties())
        weights = np.linalg.solve(left, total[:width, width])
        levels, slopes = segments(weights, layout)
        return pd.DataFrame(
            {
                "_series": [group["_series"].iloc[0]],
                "weights": [weights],
                "levels": [levels],
                "slopes": [slopes],
            }
        )

    return add, solve


@dataclass
class Forecaster:
    """Fitted series: one row per series with weights, scale and error bounds."""

    fitted: DataFrame
    layout: Layout

    def predict(self, rows: DataFrame, components: bool = False) -> DataFrame:
        """Add yhat, yhat_lower, yhat_upper to (series, ds, …), and the parts."""
        counts = rows.groupBy("series").agg(F.count(F.lit(1)).alias("_rows"))
        both = attach(rows, self.fitted.join(counts, "series"), ["series"], rows="_rows")
        both = both.withColumn("_s", seconds(F.col("ds"))).withColumn(
            "_t", (F.col("_s") - F.col("first")) / (F.col("last") - F.col("first"))
        )
        parts = {name: _part(self.layout, name) for name in ("trend", *self.layout.seasons)}
        both = both.withColumns(parts)
        yhat = sum((F.col(p) for p in parts), F.lit(0.0))
        both = both.withColumn("yhat", yhat).withColumns(
            {
                "yhat_lower": F.col("yhat") + F.col("low"),
                "yhat_upper": F.col("yhat") + F.col("high"),
            }
        )
        keep = [*rows.columns, *(parts if components else ()), "yhat", "yhat_lower", "yhat_upper"]
        return both.select(*keep)


def series_rows(df: DataFrame, when: str, value: str, series: str | None = None) -> DataFrame:
    """(series, ds, y) without missing values."""
    require(df, [when], "datetime")
    require(df, [value], "numeric")
    key = col(series).cast("string") if series else F.lit("all")
    return df.select(
        key.alias("series"),
        col(when).cast("timestamp_ntz").alias("ds"),
        col(value).cast("double").alias("y"),
    ).na.drop()


def fit(
    df: DataFrame,
    when: str,
    value: str,
    series: str | None = None,
    yearly: bool = True,
    weekly: bool = True,
    daily: bool = False,
    interval: float = 0.8,
) -> tuple[Forecaster, DataFrame]:
    """(forecaster, in-sample rows). Every series needs at least ten rows."""
    flags = {"yearly": yearly, "weekly": weekly, "daily": daily}
    layout = Layout(tuple(s for s, on in flags.items() if on))
    rows = series_rows(df, when, value, series)
    facts = checkpoint(
        rows.groupBy("series").agg(
            F.min(seconds(F.col("ds"))).alias("first"),
            # A series on a single date still needs a length.
            F.greatest(F.max(seconds(F.col("ds"))), F.min(seconds(F.col("ds"))) + 1.0).alias(
                "last"
            ),
            F.coalesce(F.nullif(F.max(F.abs("y")), F.lit(0.0)), F.lit(1.0)).alias("scale"),
            F.count(F.lit(1)).alias("_rows"),
        )
    )
    short = facts.filter(F.col("_rows") < MIN_ROWS).orderBy("series").first()
    if short is not None or not facts.limit(1).collect():
        name = "the table" if short is None else f"series '{short['series']}'"
        raise ValueError(f"At least {MIN_ROWS} rows are needed, {name} has fewer")
    both = attach(rows, facts, ["series"], rows="_rows")
    add, solve = _sums(layout)
    sums = both.select(
        F.col("series").alias("_series"),
        seconds(F.col("ds")).alias("_s"),
        "first",
        "last",
        (F.col("y") / F.col("scale")).alias("_y"),
    ).mapInPandas(add, "_series string, _sums array<double>")
    # One series may have a sum from every task: add them up in several places first.
    place = F.pmod(F.spark_partition_id(), F.lit(PLACES)).alias("_place")
    sums = sums.select("*", place).groupBy("_series", "_place").applyInPandas(
        lambda group: pd.DataFrame(
            {"_series": [group["_series"].iloc[0]], "_sums": [sum(np.asarray(s) for s in group["_sums"])]}
        ),
        "_series string, _sums array<double>",
    )
    weights = sums.groupBy("_series").applyInPandas(
        solve,
        "_series string, weights array<double>, levels array<double>, slopes array<double>",
    )
    fitted = checkpoint(
        facts.join(weights.withColumnRenamed("_series", "series"), "series").drop("_rows")
    )
    bare = fitted.withColumns({"low": F.lit(0.0), "high": F.lit(0.0)})
    inside = Forecaster(bare, layout).predict(rows).select("series", "ds", "y", "yhat")
    inside = checkpoint(inside)
    tail = (1 - interval) / 2
    errors = inside.withColumn("_e", F.col("y") - F.col("yhat"))
    bounds = group_quantiles(errors, ["series"], "_e", [tail, 1 - tail])
    bounds = bounds.select("series", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    return Forecaster(checkpoint(fitted.join(bounds, "series")), layout), inside


FREQUENCIES = ("D", "W", "M", "Q", "Y")


def future(rows: DataFrame, periods: int, freq: str = "D") -> DataFrame:
    """(series, ds) after each series' last date: days, weeks ending on Sunday,
    or ends of months, quarters and years, at the last date's time of day."""
    if not 1 <= periods <= MAX_PERIODS:
        raise ValueError(f"1 to {MAX_PERIODS} periods")
    if freq not in FREQUENCIES:
        raise ValueError(f"Unknown frequency '{freq}'")
    ends = rows.groupBy("series").agg(F.max("ds").alias("_end"))
    ends = ends.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    day, i = F.to_date("_end"), F.col("_i")
    if freq == "D":
        at = F.date_add(day, i)
    elif freq == "W":
        # Monday is 0: the next Sunday is 6 − weekday days off, or a week.
        off = F.when(F.weekday(day) == 6, F.lit(7)).otherwise(6 - F.weekday(day))
        at = F.date_add(day, off + (i - 1) * 7)
    else:
        unit, months = {"M": ("MONTH", 1), "Q": ("QUARTER", 3), "Y": ("YEAR", 12)}[freq]
        start = F.trunc(day, unit)
        is_end = F.last_day(F.add_months(start, months - 1)) == day
        skip = is_end.cast("int")
        at = F.last_day(F.add_months(start, (i - 1 + skip) * months + (months - 1)))
    time_of_day = F.col("_end") - F.date_trunc("day", "_end").cast("timestamp_ntz")
    return ends.select("series", (at.cast("timestamp_ntz") + time_of_day).alias("ds"))


def forecast(
    df: DataFrame,
    when: str,
    value: str,
    periods: int = 30,
    freq: str = "D",
    series: str | None = None,
    components: bool = False,
    **options,
) -> DataFrame:
    """History and future with yhat and its bounds; ``part`` tells which."""
    model, _ = fit(df, when, value, series, **options)
    rows = series_rows(df, when, value, series)
    past = rows.select("series", "ds", F.lit("history").alias("part"))
    ahead = future(rows, periods, freq).withColumn("part", F.lit("future"))
    return model.predict(past.unionByName(ahead), components)


def errors(inside: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """MAE, MAPE in percent (over y ≠ 0) and RMSE."""
    e = col(y) - col(yhat)
    return inside.agg(
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e / F.nullif(col(y), F.lit(0.0)))) * 100).alias("mape_pct"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
    )


def summary(predicted: DataFrame) -> DataFrame:
    """Per series: history and future size, mean future value, direction."""
    is_future = F.col("part") == "future"
    later = F.when(is_future, F.col("ds"))
    first = F.min_by("yhat", later)
    last = F.max_by("yhat", later)
    return predicted.groupBy("series").agg(
        F.count_if(~is_future).alias("history"),
        F.count_if(is_future).alias("forecasts"),
        F.avg(F.when(is_future, F.col("yhat"))).alias("mean_forecast"),
        F.when(last > first, F.lit("up")).otherwise(F.lit("down")).alias("trend"),
    )


def table(predicted: DataFrame, names: Sequence[str] = ("Date", "Forecast", "Lower", "Upper")):
    """The future rows under readable names."""
    a, b, c, d = names
    return predicted.filter(F.col("part") == "future").select(
        "series",
        F.col("ds").alias(a),
        F.col("yhat").alias(b),
        F.col("yhat_lower").alias(c),
        F.col("yhat_upper").alias(d),
    )

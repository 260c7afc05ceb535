"""Stage 1: demand classes, rolling-origin evaluation, class winners and final forecasts.

An item's history is one vector (its length is bounded by the calendar), so training windows are
slices and the models are array expressions; only the regression solves its normal equations in batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.params import DEFAULTS, Params

WEEKS_PER_YEAR = 365.25 / 7.0
LAGS = 4
_TERMS = 4 + LAGS
_DOUBLES = "array<double>"
_WEEKS_AT_ONCE = 300_000

# A model adds ``pred array<double>`` (length h) to frames that hold ``y array<double>``.
Model = Callable[[DataFrame, int], DataFrame]


def classify(demand: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Mean gap between demands and squared variation of sizes -> one of four classes or no-demand."""
    size = F.when(F.col("units") > 0, F.col("units"))
    stats = demand.groupBy("stock_code").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(size).alias("nonzero"),
        F.var_pop(size).alias("_var"),
        F.avg(size).alias("_mean"),
    )
    stats = stats.withColumn("adi", F.try_divide(F.col("n").cast("double"), F.col("nonzero"))).withColumn(
        "cv2",
        F.when(F.col("nonzero") > 1, F.col("_var") / (F.col("_mean") * F.col("_mean"))).when(
            F.col("nonzero") == 1, 0.0
        ),
    )
    frequent, steady = F.col("adi") < p.adi_cutoff, F.col("cv2") < p.cv2_cutoff
    label = (
        F.when(F.col("nonzero") == 0, "no-demand")
        .when(frequent & steady, "smooth")
        .when(frequent, "erratic")
        .when(steady, "intermittent")
        .otherwise("lumpy")
    )
    folds_exist = F.col("n") - p.horizon >= p.min_train
    return stats.select(
        "stock_code", "n", "nonzero", "adi", "cv2", label.alias("class"),
        ((F.col("nonzero") >= p.min_nonzero) & folds_exist).alias("eligible"),
    )


def folds(classes: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Origins stepping back from the end; a fold whose training part is too short is left out."""
    back = F.array(*[F.lit((p.n_folds - 1 - k) * p.fold_step) for k in range(p.n_folds)])
    made = classes.select("stock_code", "n", F.posexplode(back).alias("_k", "_back")).select(
        "stock_code", "_k", (F.col("n") - p.horizon - F.col("_back")).cast("int").alias("origin")
    )
    numbered = Window.partitionBy("stock_code").orderBy("_k")  # at most n_folds rows per item
    return made.filter(F.col("origin") >= p.min_train).select(
        "stock_code", F.row_number().over(numbered).alias("fold"), "origin", F.col("origin").alias("train_weeks")
    )


def fold_frames(series: DataFrame, folds_df: DataFrame, horizon: int) -> DataFrame:
    """One row per item and fold: training vector ``y`` and the following ``actual`` weeks."""
    joined = series.select("stock_code", F.col("y").alias("_y")).join(folds_df, "stock_code")
    return joined.select(
        "stock_code", "fold", "train_weeks",
        F.slice("_y", F.lit(1), F.col("origin")).alias("y"),
        F.slice("_y", F.col("origin") + 1, F.lit(horizon)).alias("actual"),
    )


# ---- models
def _floor0(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def _flat(value: Column, h: int) -> Column:
    return F.array_repeat(_floor0(value), h)


def _last(y: Column) -> Column:
    return F.element_at(y, -1)


def naive(train: DataFrame, h: int) -> DataFrame:
    return train.withColumn("pred", _flat(_last(F.col("y")), h))


def seasonal_naive(train: DataFrame, h: int, m: int = DEFAULTS.season_weeks) -> DataFrame:
    """Same week one season ago; shorter histories use their last value."""
    start = F.size("y") - m
    season = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda i: _floor0(F.get(F.col("y"), start + i % m)))
    return train.withColumn("pred", F.when(F.size("y") < m, _flat(_last(F.col("y")), h)).otherwise(season))


def croston_sba(train: DataFrame, h: int, alpha: float = DEFAULTS.croston_alpha) -> DataFrame:
    """Smoothed demand size over smoothed gap, updated at demand points only, with bias factor 1 - alpha/2."""
    start = F.struct(
        F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("p"), F.lit(0.0).alias("gap")
    )

    def smooth(old: Column, new: Column) -> Column:
        return F.coalesce(F.lit(alpha) * new + F.lit(1 - alpha) * old, new)

    def step(state: Column, units: Column) -> Column:
        gap = state["gap"] + 1
        return F.when(
            units > 0,
            F.struct(
                smooth(state["z"], units).alias("z"), smooth(state["p"], gap).alias("p"), F.lit(0.0).alias("gap")
            ),
        ).otherwise(F.struct(state["z"].alias("z"), state["p"].alias("p"), gap.alias("gap")))

    rate = F.aggregate(
        "y", start, step,
        lambda s: F.coalesce(F.lit(1 - alpha / 2) * s["z"] / F.greatest(s["p"], F.lit(1.0)), F.lit(0.0)),
    )
    return train.withColumn("pred", _flat(rate, h))


def _solved(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Coefficients of many normal equations. Columns are scaled to unit length first; collinear features get the smallest solution."""
    size = np.sqrt(np.diagonal(gram, axis1=1, axis2=2))
    size[size == 0] = 1.0
    inverse = np.linalg.pinv(gram / size[:, :, None] / size[:, None, :], rcond=1e-11, hermitian=True)
    return np.einsum("bij,bj->bi", inverse, right / size) / size


def _lag_paths(flat: np.ndarray, n: np.ndarray, h: int) -> np.ndarray:
    """Forecasts (series x h) of series of lengths ``n`` that lie one after the other; every week of every series is one row of one matrix."""
    turn, fitted, start = 2.0 * math.pi / WEEKS_PER_YEAR, n - LAGS, np.cumsum(n) - n
    known = lambda t, n: (np.ones(len(t)), t / n, np.sin(t * turn), np.cos(t * turn))
    begin = np.cumsum(fitted) - fitted
    week = np.arange(fitted.sum()) - np.repeat(begin, fitted) + LAGS
    at = np.repeat(start, fitted) + week
    features = [*known(week.astype(float), np.repeat(n, fitted)), *(flat[at - 1 - k] for k in range(LAGS))]
    gram, right = np.zeros((len(n), _TERMS, _TERMS)), np.zeros((len(n), _TERMS))
    for i, f in enumerate(features):
        right[:, i] = np.add.reduceat(f * flat[at], begin)
        for j in range(i, _TERMS):
            gram[:, i, j] = gram[:, j, i] = np.add.reduceat(f * features[j], begin)
    beta = _solved(gram, right)
    past, out = np.stack([flat[start + n - 1 - k] for k in range(LAGS)], 1), []
    for step in range(h):
        now = np.stack(known((n + step).astype(float), n), 1)
        value = (beta[:, :4] * now).sum(1) + (beta[:, 4:] * past).sum(1)
        past = np.concatenate([value[:, None], past[:, :-1]], 1)
        out.append(np.maximum(value, 0.0))
    return np.stack(out, 1)


def lag_linear(train: DataFrame, h: int) -> DataFrame:
    """Least squares on trend, one annual sine/cosine pair and the last four weeks; forecast step by step.

    The series of an Arrow batch are fitted together, some hundred thousand weeks at a time: sums of the normal equations run over
    all their weeks at once, and so do the solves and the steps ahead. Histories under 12 weeks keep their last value.
    """

    def paths(series: pd.Series) -> pd.Series:
        out = [None] * len(series)
        lengths = series.map(lambda v: 0 if v is None else len(v)).to_numpy()
        own = np.flatnonzero(lengths >= LAGS + 8)
        for some in np.split(own, np.flatnonzero(np.diff(np.cumsum(lengths[own]) // _WEEKS_AT_ONCE)) + 1):
            if len(some):
                found = _lag_paths(np.concatenate([series.iat[i] for i in some]).astype(float), lengths[some].astype(np.int64), h)
                for i, path in zip(some.tolist(), found, strict=True):
                    out[i] = path
        return pd.Series(out, dtype=object)

    paths.__annotations__ = {"series": pd.Series, "return": pd.Series}
    fitted = train.withColumn("_lag_path", F.pandas_udf(paths, _DOUBLES)("y"))
    return fitted.withColumn("pred", F.coalesce("_lag_path", _flat(_last(F.col("y")), h))).drop("_lag_path")


def vector_model(fit: Callable[[np.ndarray, int], np.ndarray]) -> Model:
    """Lift a function of one training vector to a model; vectors travel in Arrow batches."""

    def model(train: DataFrame, h: int) -> DataFrame:
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([np.asarray(fit(np.asarray(y, dtype=float), h), dtype=float) for y in batch])

        predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return train.withColumn("pred", F.pandas_udf(predict, _DOUBLES)(F.col("y")))

    return model


MODELS: dict[str, Model] = {
    "naive": naive,
    "seasonal_naive": seasonal_naive,
    "croston_sba": croston_sba,
    "lag_linear": lag_linear,
}
CLOSED_FORM = {name: MODELS[name] for name in ("naive", "seasonal_naive", "croston_sba")}


# ---- evaluation
def mean_of(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.try_divide(total, F.size(values).cast("double"))


def mae(actual: Column, pred: Column) -> Column:
    return mean_of(F.zip_with(actual, pred, lambda a, b: F.abs(a - b)))


def naive_scale(y: Column, m: int = 1) -> Column:
    """Mean absolute m-week step of the training vector (m falls back to 1); NULL where it is zero."""
    lag = F.when(F.size(y) <= m, 1).otherwise(m)
    now = F.slice(y, lag + 1, F.greatest(F.size(y) - lag, F.lit(0)))
    before = F.slice(y, F.lit(1), F.greatest(F.size(y) - lag, F.lit(0)))
    return F.nullif(mean_of(F.zip_with(now, before, lambda a, b: F.abs(a - b))), F.lit(0.0))


def mase(actual: Column, pred: Column, train: Column, m: int = 1) -> Column:
    """Error relative to the naive step; undefined is NULL, which every aggregate skips."""
    return F.try_divide(mae(actual, pred), naive_scale(train, m))


def cross_validate(frames: DataFrame, classes: DataFrame, models: dict[str, Model], horizon: int) -> DataFrame:
    """One row per item, fold and model, with the forecast errors as a vector."""
    out = None
    for name, model in models.items():
        part = model(frames, horizon).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    labelled = out.join(classes.filter("eligible").select("stock_code", "class"), "stock_code")
    return labelled.select(
        "stock_code", "class", "model", "fold", "train_weeks",
        mase(F.col("actual"), F.col("pred"), F.col("y")).alias("mase"),
        mae(F.col("actual"), F.col("pred")).alias("mae"),
        F.zip_with("actual", "pred", lambda a, b: a - b).alias("errors"),
    )


def class_winners(cv: DataFrame) -> DataFrame:
    """Mean scaled error per class and model over defined cells; the lowest mean wins, ties by name."""
    scored = cv.groupBy("class", "model").agg(
        F.avg("mase").alias("mean_mase"), F.count("mase").alias("cells")
    ).filter(F.col("mean_mase").isNotNull())
    best = Window.partitionBy("class").orderBy("mean_mase", "model")  # one row per model
    return scored.withColumn("winner", F.row_number().over(best) == 1)


def choices(classes: DataFrame, winners: DataFrame) -> DataFrame:
    """The model each eligible item uses: the winner of its class, else naive."""
    won = winners.filter("winner").select("class", "model")  # at most one row per class
    return (
        classes.filter("eligible")
        .select("stock_code", "class")
        .join(F.broadcast(won), "class", "left")
        .select("stock_code", "class", F.coalesce("model", F.lit("naive")).alias("model"))
    )


def sigma(cv: DataFrame, chosen: DataFrame) -> DataFrame:
    """Population deviation of all errors of the chosen model, folds pooled."""
    pooled = cv.join(chosen.select("stock_code", "model"), ["stock_code", "model"]).select(
        "stock_code", F.explode("errors").alias("e")
    )
    return pooled.groupBy("stock_code").agg(F.stddev_pop("e").alias("sigma"))


def final_forecast(
    series: DataFrame, chosen: DataFrame, cv: DataFrame, models: dict[str, Model], horizon: int
) -> DataFrame:
    """The next ``horizon`` Sundays of every eligible item, on its full history."""
    base = series.join(chosen, "stock_code").join(sigma(cv, chosen), "stock_code", "left")
    out = None
    for name, model in models.items():
        part = model(base.filter(F.col("model") == name), horizon)
        out = part if out is None else out.unionByName(part)
    steps = out.select(
        "stock_code", "last_week", "model", "class", F.coalesce("sigma", F.lit(0.0)).alias("sigma"),
        F.posexplode("pred").alias("_i", "units"),
    )
    return steps.select(
        "stock_code", F.date_add("last_week", 7 * (F.col("_i") + 1)).alias("week"),
        "units", "sigma", "model", "class",
    )

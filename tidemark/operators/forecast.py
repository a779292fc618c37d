"""Forecasts from look-back windows: one step, many steps, and the future."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import future_times
from ..functions.numeric import non_negative
from ..plans.joins import null_safe_join
from ..plans.positions import Layout
from ..plans.session import materialize
from . import boosting
from .filters import last_rows
from .linear import cross_products, solve
from .split import look_back_windows, mark_split, min_max_bounds, scale, scale_column, unscale

# Forecast horizons in steps.
HORIZONS = {"24h": 24, "48h": 48, "7day": 168}


def scaled_windows(
    df: DataFrame,
    value: str,
    *,
    look_back: int = 48,
    horizon: int | None = None,
    test_ratio: float = 0.2,
    fit_on: str = "all",
    keys: Sequence[str] = (),
    ts: str = "ts",
    layout: Layout | None = None,
) -> DataFrame:
    """Windows of the min-max scaled series with ``is_train``, ``lo`` and ``hi``.

    ``fit_on="all"`` scales by the whole series, test rows included; ``"train"`` by its first part.
    """
    base = df.select(*keys, ts, value)
    if fit_on == "train":
        base = mark_split(base, test_ratio=test_ratio, keys=keys, ts=ts, layout=layout)
    scaled = scale_column(base, value, keys=keys, fit_on=fit_on)
    windows = look_back_windows(scaled, "scaled", look_back=look_back, horizon=horizon, keys=keys, ts=ts, layout=layout)
    marked = mark_split(windows, test_ratio=test_ratio, keys=keys, ts=ts, layout=layout)
    bounds = scaled.groupBy(*keys).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    if keys:
        return null_safe_join(marked, bounds, keys)
    both = bounds.select(F.struct("lo", "hi").alias("b")).scalar()
    return marked.withColumn("__b", both).select(*marked.columns, F.col("__b.lo").alias("lo"), F.col("__b.hi").alias("hi"))


@dataclass
class OneStepModel:
    model: Model

    def predict(self, windows: DataFrame) -> DataFrame:
        return self.model.transform(windows.withColumn("features", array_to_vector("x"))).drop("features")


def train_one_step(windows: DataFrame, *, kind: str = "linear", **params) -> OneStepModel:
    """Next value from a look-back window, on the training rows.

    ``kind="boosted"`` stops early on the last tenth of the training rows, chosen by hash.
    """
    train = windows.where("is_train").withColumn("features", array_to_vector("x"))
    common = {"featuresCol": "features", "labelCol": "y", "predictionCol": "y_hat"}
    if kind == "linear":
        return OneStepModel(LinearRegression(**common, **params).fit(train))
    held = train.withColumn("__hold", F.pmod(F.xxhash64("x"), F.lit(10)) == 0)
    settings = {"maxIter": 30, "seed": 42, "validationTol": 0.001, **params}
    return OneStepModel(GBTRegressor(**common, validationIndicatorCol="__hold", **settings).fit(held))


def look_back_regression(df: DataFrame, value: str, *, kind: str = "linear", ts: str = "ts", keys=(), **options) -> DataFrame:
    """Train on the first part of the series and predict the rest: ``actual``, ``predicted``."""
    params = options.pop("params", {})
    windows = materialize(scaled_windows(df, value, keys=keys, ts=ts, **options), "windows")
    model = train_one_step(windows, kind=kind, **params)
    test = model.predict(windows.where("NOT is_train"))
    return test.select(
        *keys,
        ts,
        unscale(F.col("y"), F.col("lo"), F.col("hi")).alias("actual"),
        unscale(F.col("y_hat"), F.col("lo"), F.col("hi")).alias("predicted"),
    )


@dataclass
class DirectModel:
    """One linear equation per step, all solved from the same cross products."""

    weights: np.ndarray  # (1 + look_back, horizon), intercept first

    @property
    def horizon(self) -> int:
        return self.weights.shape[1]

    def predict(self, windows: DataFrame) -> DataFrame:
        weights = self.weights

        @F.pandas_udf("array<double>")
        def steps(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            a = np.column_stack([np.ones(len(x)), np.stack(x.to_numpy())])
            return pd.Series(list(a @ weights))

        return windows.withColumn("y_hat", steps("x"))


@dataclass
class PooledModel:
    """One boosted model for all steps; the step is a feature."""

    model: Model
    horizon: int

    def predict(self, windows: DataFrame) -> DataFrame:
        ids = [c for c in windows.columns if c not in ("x", "y", "step")]
        long = windows.select(*windows.columns, F.explode(F.sequence(F.lit(1), F.lit(self.horizon))).alias("step"))
        scored = self.model.transform(long.withColumn("features", _with_step()))
        # `horizon` rows per window, a bounded group.
        packed = scored.groupBy(*ids).agg(
            *[F.first(c).alias(c) for c in ("x", "y") if c in windows.columns],
            F.transform(F.array_sort(F.collect_list(F.struct("step", "y_hat"))), lambda s: s["y_hat"]).alias("y_hat"),
        )
        return packed


@dataclass
class PerStepModel:
    """An independent model per step."""

    models: list[Model]

    @property
    def horizon(self) -> int:
        return len(self.models)

    def predict(self, windows: DataFrame) -> DataFrame:
        out = windows.withColumn("features", array_to_vector("x"))
        for k, m in enumerate(self.models):
            out = m.setPredictionCol(f"__s{k}").transform(out)
        steps = [f"__s{k}" for k in range(self.horizon)]
        return out.withColumn("y_hat", F.array(*steps)).drop("features", *steps)


def _with_step() -> Column:
    return array_to_vector(F.concat("x", F.array(F.col("step").cast("double"))))


def train_multi_step(windows: DataFrame, *, look_back: int = 48, horizon: int = 24, strategy: str = "direct", **params):
    """Next ``horizon`` values from a look-back window, on the training rows.

    ``direct`` solves one linear equation per step from one pass over the data; ``pooled`` fits one
    boosted model with the step as a feature; ``per_step`` fits a boosted model for every step; ``trees``
    fits one boosted model whose leaves hold a value for every step.
    """
    train = windows.where("is_train")
    if strategy == "direct":
        xx, xy, _ = cross_products(train, "x", "y", look_back, horizon)
        return DirectModel(solve(xx, xy))
    if strategy == "trees":
        ids = [c for c in train.columns if c not in ("x", "y", "is_train", "lo", "hi")]
        return boosting.train(train.select(*ids, "x", "y"), ids=ids, **{**boosting.MULTI_STEP, **params})
    # Training parameters of the pooled and the per-step model.
    settings = {"labelCol": "label", "predictionCol": "y_hat", "maxIter": 300, "maxDepth": 6, "stepSize": 0.05,
                "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42, **params}
    if strategy == "pooled":
        long = train.select("x", F.posexplode("y").alias("pos", "label")).withColumn("step", F.col("pos") + 1)
        return PooledModel(GBTRegressor(**settings).fit(long.withColumn("features", _with_step())), horizon)
    if strategy == "per_step":
        rows = train.withColumn("features", array_to_vector("x"))
        return PerStepModel(
            [GBTRegressor(**settings).fit(rows.withColumn("label", F.element_at("y", k + 1))) for k in range(horizon)]
        )
    raise ValueError(f"unknown strategy {strategy!r}")


def unscale_arrays(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.transform(c, lambda v: unscale(v, F.col("lo"), F.col("hi"))) for c in columns})


def multi_step_forecast(
    df: DataFrame, value: str, *, look_back: int = 48, horizon: int = 24, strategy: str = "direct", keys=(), ts: str = "ts",
    layout: Layout | None = None, params: dict | None = None, fit_on: str = "all", test_ratio: float = 0.2,
) -> tuple[object, DataFrame]:
    """Fit on the first part of the series, predict the rest: model, and arrays ``y`` and ``y_hat``."""
    made = scaled_windows(
        df, value, look_back=look_back, horizon=horizon, keys=keys, ts=ts, layout=layout, fit_on=fit_on, test_ratio=test_ratio
    )
    windows = materialize(made, "windows")  # fitted and scored from one table
    model = train_multi_step(windows, look_back=look_back, horizon=horizon, strategy=strategy, **(params or {}))
    model.bounds = materialize(windows.groupBy(*keys).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi")), "bounds")
    scored = model.predict(windows.where("NOT is_train"))
    return model, unscale_arrays(scored, "y", "y_hat").select(*keys, ts, "y", "y_hat")


def future_forecast(
    df: DataFrame, value: str, model, *, look_back: int = 48, keys: Sequence[str] = (), ts: str = "ts", step: str = "1 hour"
) -> DataFrame:
    """Forecast the steps after the last reading of each series, never below zero.

    Values are scaled by the bounds that the model was fitted with, if it carries them. The last ``look_back``
    rows per series are a bounded group. Series shorter than that get none.
    """
    base = df.select(*keys, ts, value).where(F.col(value).isNotNull())
    tail = last_rows(base, look_back, keys=keys, ts=ts)
    bounds = getattr(model, "bounds", None)
    if bounds is None:
        bounds = min_max_bounds(base, value, keys=keys)
    if keys:
        tail = null_safe_join(tail, bounds, keys)
    else:
        tail = tail.withColumn("__b", bounds.select(F.struct("lo", "hi").alias("b")).scalar())
        tail = tail.select(*base.columns, F.col("__b.lo").alias("lo"), F.col("__b.hi").alias("hi"))
    tail = tail.withColumn("scaled", scale(F.col(value), F.col("lo"), F.col("hi")))
    packed = tail.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(ts, "scaled"))), lambda s: s["scaled"]).alias("x"),
        F.first("lo").alias("lo"),
        F.first("hi").alias("hi"),
    )
    ready = packed.where(F.size("x") == look_back)
    ahead = unscale_arrays(model.predict(ready), "y_hat").select(*keys, F.posexplode("y_hat").alias("pos", "raw"))
    ahead = ahead.select(*keys, (F.col("pos") + 1).alias("step"), non_negative(F.col("raw")).alias("forecast"))
    spine = future_times(base, model.horizon, keys=keys, ts=ts, step=step)
    return null_safe_join(ahead, spine, [*keys, "step"], "inner").select(*keys, "step", ts, "forecast")

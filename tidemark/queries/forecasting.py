"""Decomposition, models, forecasts, explanations."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..operators import arima, decompose, explain, forecast, isolation_forest, metrics, models, rolling
from ..operators.anomaly import combined_anomalies
from ..operators.features import add_components, feature_columns
from ..operators.profile import forecast_summary
from ..operators.split import split_chronological
from ..plans.session import materialize, scratch_path
from ..sources.sinks import load_model, save_model
from .base import DAILY, HOURLY_SQL, TOTAL, WEEKLY, features, hourly, longs, minutely, rounded, user_hourly

# Small ensembles keep the registered queries short; the library defaults are the full-size ones.
SMALL_FOREST = {"numTrees": 20, "maxDepth": 6}
SMALL_BOOST = {"maxIter": 10, "maxDepth": 4, "stepSize": 0.1}


def classical(spark, d):
    out = decompose.classical(hourly(spark, d), "power", layout=WEEKLY)
    return rounded(out, "observed", "trend", "seasonal", "residual")


CLASSICAL_CTE = HOURLY_SQL + """, t AS (
  SELECT ts, power AS observed, row_number() OVER (ORDER BY ts) - 1 AS rn,
    CASE WHEN count(power) OVER a = 24 AND count(power) OVER b = 24 THEN (avg(power) OVER a + avg(power) OVER b) / 2 END AS trend
  FROM hourly WINDOW a AS (ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING),
                     b AS (ORDER BY ts ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING)),
p AS (SELECT rn % 24 AS phase, avg(observed - trend) AS raw FROM t GROUP BY 1),
components AS (SELECT ts, observed, trend, raw - (SELECT avg(raw) FROM p) AS seasonal,
  observed - trend - (raw - (SELECT avg(raw) FROM p)) AS residual FROM t JOIN p ON t.rn % 24 = p.phase)"""
CLASSICAL_SQL = CLASSICAL_CTE + """
SELECT ts, round(observed, 6) AS observed, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(residual, 6) AS residual
FROM components"""


def feature_components(spark, d):
    feats = features(spark, d).select("ts", "power", "lag_48")
    joined = add_components(feats, decompose.classical(hourly(spark, d), "power", layout=WEEKLY))
    return rounded(joined, "power", "lag_48", "trend", "seasonal", "residual")


FEATURE_COMPONENTS_SQL = CLASSICAL_CTE + """, l AS (SELECT ts, power, lag(power, 48) OVER (ORDER BY ts) AS lag_48 FROM hourly)
SELECT ts, round(power, 6) AS power, round(lag_48, 6) AS lag_48, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal,
       round(residual, 6) AS residual
FROM l JOIN components USING (ts) WHERE lag_48 IS NOT NULL AND trend IS NOT NULL"""


def stl(spark, d):
    return rounded(decompose.stl(hourly(spark, d), "power", layout=WEEKLY), "observed", "trend", "seasonal", "residual")


def stl_panel(spark, d):
    daily = user_hourly(spark, d).groupBy("user_id", F.window("ts", "1 day")["start"].alias("ts")).agg(F.sum("power").alias("power"))
    out = decompose.stl(daily, "power", period=7, keys=["user_id"], robust=False, inner=2)
    return rounded(out, "observed", "trend", "seasonal", "residual")


def iforest(spark, d):
    out = isolation_forest.detect_isolation_forest(hourly(spark, d), ["power", *TOTAL])
    return rounded(out.select("ts", "power", "score", "iforest"), "power", "score")


def all_detectors(spark, d):
    h = hourly(spark, d)
    flags = isolation_forest.detect_isolation_forest(h, ["power", *TOTAL])
    return rounded(combined_anomalies(h, "power", iforest=flags, layout=WEEKLY), "value")


def _split(spark, d):
    feats = materialize(features(spark, d), "features")
    names = feature_columns(feats, "power")
    train, test = split_chronological(feats, layout=WEEKLY)
    return materialize(train, "train"), materialize(test, "test"), names


def random_forest(spark, d):
    train, test, names = _split(spark, d)
    model = models.train_random_forest(train, names, "power", **SMALL_FOREST)
    return rounded(models.score(model, test, "power"), "actual", "predicted")


def boosted_trees(spark, d):
    train, test, names = _split(spark, d)
    model = models.train_boosted_trees(train, names, "power", **SMALL_BOOST)
    return rounded(models.score(model, test, "power"), "actual", "predicted")


def histogram_boosting(spark, d):
    """500 trees of depth 7 on the feature table."""
    train, test, names = _split(spark, d)
    model = models.train_histogram_boosting(train, names, "power")
    return rounded(models.score(model, test, "power"), "actual", "predicted")


def saved_model(spark, d):
    train, test, names = _split(spark, d)
    path = save_model(models.train_linear(train, names, "power", regParam=0.1), scratch_path(spark, "model"))
    model: PipelineModel = load_model(spark, path)
    return rounded(models.score(model, test, "power"), "actual", "predicted")


def model_table(spark, d):
    """Linear, forest and boosted models and the one-step look-back regression, best first."""
    train, test, names = _split(spark, d)
    linear = models.train_linear(train, names, "power", regParam=0.1)
    forest = models.train_random_forest(train, names, "power", **SMALL_FOREST)
    boosted = models.train_boosted_trees(train, names, "power", **SMALL_BOOST)
    tables = {n: models.score(m, test, "power") for n, m in (("Linear", linear), ("Random Forest", forest), ("Boosted Trees", boosted))}
    tables["Look-back"] = forecast.look_back_regression(hourly(spark, d), "power", layout=WEEKLY)
    return metrics.compare_models(metrics.union_models(tables))


def look_back_linear(spark, d):
    out = forecast.look_back_regression(hourly(spark, d), "power", layout=WEEKLY)
    return rounded(out, "actual", "predicted")


def look_back_boosted(spark, d):
    out = forecast.look_back_regression(hourly(spark, d), "power", kind="boosted", params={"maxIter": 5, "maxDepth": 3}, layout=WEEKLY)
    return rounded(out, "actual", "predicted")


def multi_step_direct(spark, d):
    _, scored = forecast.multi_step_forecast(hourly(spark, d), "power", horizon=24, layout=WEEKLY)
    return rounded(metrics.horizon_means(scored, ids=["ts"]), "actual_mean", "predicted_mean")


def multi_step_pooled(spark, d):
    _, scored = forecast.multi_step_forecast(
        hourly(spark, d), "power", horizon=24, strategy="pooled", params={"maxIter": 5, "maxDepth": 4}, layout=WEEKLY
    )
    return rounded(metrics.horizon_means(scored, ids=["ts"]), "actual_mean", "predicted_mean")


def multi_step_trees(spark, d):
    """The next day from the last two by 300 trees of depth 6 with a value for every step in each leaf."""
    _, scored = forecast.multi_step_forecast(hourly(spark, d), "power", horizon=24, strategy="trees", layout=WEEKLY)
    return rounded(metrics.horizon_means(scored, ids=["ts"]), "actual_mean", "predicted_mean")


def future(spark, d):
    """Future forecasts at the three horizons, stacked."""
    h = hourly(spark, d)
    tables = {}
    for label, n in forecast.HORIZONS.items():
        model, _ = forecast.multi_step_forecast(h, "power", horizon=n, layout=WEEKLY)
        tables[label] = forecast.future_forecast(h, "power", model)
    return longs(rounded(metrics.union_models(tables, "horizon"), "forecast"), "step")


def future_panel(spark, d):
    """One pooled linear model over all users, a forecast for every user with enough history."""
    u = user_hourly(spark, d).select("user_id", "ts", "power")
    model, _ = forecast.multi_step_forecast(u, "power", look_back=12, horizon=6, keys=["user_id"])
    ahead = forecast.future_forecast(u, "power", model, look_back=12, keys=["user_id"])
    return longs(rounded(ahead, "forecast"), "step")


def future_summary(spark, d):
    h = hourly(spark, d)
    model, _ = forecast.multi_step_forecast(h, "power", horizon=24, layout=WEEKLY)
    return rounded(forecast_summary(forecast.future_forecast(h, "power", model)), "mean", "peak", "total")


def adf(spark, d):
    h = hourly(spark, d)
    lag = arima.default_max_lag(h.where("power IS NOT NULL").count())
    return rounded(arima.adf_test(h, "power", max_lag=lag, layout=WEEKLY), "statistic", "p_value")


def sarima(spark, d):
    out = arima.sarima_forecast(minutely(spark, d), "power", layout=DAILY)
    return rounded(out, "actual", "predicted")


def residual_recursion(spark, d):
    """Moving-average residuals of the hourly steps, in chunks of 512 rows."""
    rows = rolling.difference(hourly(spark, d).select("ts", "power"), "power", seasonal=0, layout=WEEKLY)
    return rounded(arima.moving_average_residuals(rows, F.col("diff"), F.lit(-0.6), layout=WEEKLY).select("ts", "e"), "e")


RESIDUAL_RECURSION_SQL = HOURLY_SQL.replace("WITH", "WITH RECURSIVE", 1) + """,
steps AS (SELECT ts, row_number() OVER (ORDER BY ts) AS rn, power - lag(power) OVER (ORDER BY ts) AS diff FROM hourly),
run AS (SELECT rn, ts, coalesce(diff, 0.0) AS e FROM steps WHERE rn = 1
  UNION ALL SELECT s.rn, s.ts, CASE WHEN s.diff IS NULL THEN r.e ELSE s.diff + 0.6 * r.e END FROM run r JOIN steps s ON s.rn = r.rn + 1)
SELECT ts, round(e, 6) AS e FROM run"""


def sarima_series_fit(spark, d):
    """Coefficients from the whole minutely series."""
    fit = arima.fit_sarima_series(minutely(spark, d), "power", layout=DAILY)
    names = ("lag_1", "lag_24", "lag_25", "moving_average")
    out = fit.select(*[F.col("coef")[i].alias(n) for i, n in enumerate(names)], "sigma2", "rows")
    return rounded(out, *names, "sigma2")


def walk_forward(spark, d):
    return rounded(arima.walk_forward(hourly(spark, d), "power", layout=WEEKLY), "actual", "predicted")


# The least-squares system of each step has three unknowns: running sums, then Cramer's rule.
WALK_FORWARD_SQL = HOURLY_SQL + """, p AS (
  SELECT ts, power AS y, row_number() OVER o - 1 AS rn, count(*) OVER () AS n,
         (power - lag(power, 1) OVER o) - (lag(power, 24) OVER o - lag(power, 25) OVER o) AS w,
         lag(power, 1) OVER o + lag(power, 24) OVER o - lag(power, 25) OVER o AS carry
  FROM hourly WINDOW o AS (ORDER BY ts)),
l AS (SELECT *, lag(w, 1) OVER o AS a, lag(w, 24) OVER o AS b, lag(w, 25) OVER o AS c FROM p WINDOW o AS (ORDER BY ts)),
s AS (
  SELECT *, sum(a * a) FILTER (c IS NOT NULL) OVER h AS aa, sum(a * b) FILTER (c IS NOT NULL) OVER h AS ab,
         sum(a * c) FILTER (c IS NOT NULL) OVER h AS ac, sum(b * b) FILTER (c IS NOT NULL) OVER h AS bb,
         sum(b * c) FILTER (c IS NOT NULL) OVER h AS bc, sum(c * c) FILTER (c IS NOT NULL) OVER h AS cc,
         sum(a * w) FILTER (c IS NOT NULL) OVER h AS aw, sum(b * w) FILTER (c IS NOT NULL) OVER h AS bw,
         sum(c * w) FILTER (c IS NOT NULL) OVER h AS cw
  FROM l WINDOW h AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
k AS (
  SELECT *, (aw * (bb * cc - bc * bc) - ab * (bw * cc - bc * cw) + ac * (bw * bc - bb * cw)) / det AS ka,
         (aa * (bw * cc - bc * cw) - aw * (ab * cc - bc * ac) + ac * (ab * cw - bw * ac)) / det AS kb,
         (aa * (bb * cw - bw * bc) - ab * (ab * cw - bw * ac) + aw * (ab * bc - bb * ac)) / det AS kc
  FROM d)
SELECT ts, round(y, 6) AS actual, round(greatest(ka * a + kb * b + kc * c + carry, 0), 6) AS predicted
FROM k WHERE rn >= floor(n * 0.8) AND c IS NOT NULL"""


def tree_shapley(spark, d):
    """Importance by tree attributions of a forest of 200 trees of depth 15, over the whole test table."""
    train, test, names = _split(spark, d)
    model = models.train_random_forest(train, names, "power")
    table, _ = explain.explain_model(model, test, names)
    return rounded(table, "mean_shap")


def tree_shapley_check(spark, d):
    """Base plus attributions next to the prediction they explain."""
    train, test, names = _split(spark, d)
    model = models.train_histogram_boosting(train, names, "power", rounds=100)
    told = explain.explain_trees(model, test, names)
    total = told.select("ts", (F.col("base") + F.aggregate("phi", F.lit(0.0), lambda a, v: a + v)).alias("explained"))
    return rounded(total.join(models.score(model, test, "power"), "ts").select("ts", "explained", "predicted"), "explained", "predicted")


def any_shapley(spark, d):
    train, test, names = _split(spark, d)
    model = models.train_linear(train, names, "power")
    long = explain.explain_any(model.transform, test, train, names)
    return rounded(explain.importance(long), "mean_shap")


QUERIES = {
    "classical_decomposition": (classical, CLASSICAL_SQL),
    "feature_components": (feature_components, FEATURE_COMPONENTS_SQL),
    "stl_decomposition": (stl, None),
    "stl_panel": (stl_panel, None),
    "isolation_forest": (iforest, None),
    "all_detectors": (all_detectors, None),
    "random_forest": (random_forest, None),
    "boosted_trees": (boosted_trees, None),
    "histogram_boosting": (histogram_boosting, None),
    "saved_model": (saved_model, None),
    "model_table": (model_table, None),
    "look_back_linear": (look_back_linear, None),
    "look_back_boosted": (look_back_boosted, None),
    "multi_step_direct": (multi_step_direct, None),
    "multi_step_pooled": (multi_step_pooled, None),
    "multi_step_trees": (multi_step_trees, None),
    "future_forecast": (future, None),
    "future_panel": (future_panel, None),
    "future_summary": (future_summary, None),
    "adf_test": (adf, None),
    "sarima_forecast": (sarima, None),
    "residual_recursion": (residual_recursion, RESIDUAL_RECURSION_SQL),
    "sarima_series_fit": (sarima_series_fit, None),
    "walk_forward": (walk_forward, WALK_FORWARD_SQL),
    "tree_shapley": (tree_shapley, None),
    "tree_shapley_check": (tree_shapley_check, None),
    "any_shapley": (any_shapley, None),
}

"""Aggregates, rankings and report tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters, metrics, profile
from ..operators.resample import monthly_mean
from ..plans.quantiles import exact_quantiles
from .base import HOURLY_SQL, MEASURES, USER_HOURLY_SQL, WEEKLY, hourly, longs, readings, rounded, table, user_hourly

DAYS_SQL = "['Mon','Tue','Wed','Thu','Fri','Sat','Sun']"


def monthly(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"))
    return rounded(monthly_mean(o, "price", spine=True), "mean", digits=4)


MONTHLY_SQL = """
WITH m AS (SELECT last_day(o_orderdate) AS month_end, avg(o_totalprice) AS mean FROM orders GROUP BY 1),
spine AS (SELECT last_day(unnest(generate_series(date_trunc('month', (SELECT min(o_orderdate) FROM orders)),
                                                 (SELECT max(o_orderdate) FROM orders), INTERVAL 1 MONTH))) AS month_end)
SELECT spine.month_end, round(mean, 4) AS mean FROM spine LEFT JOIN m USING (month_end)"""


def hour_profile(spark, d):
    return longs(rounded(profile.hour_profile(hourly(spark, d), "power"), "mean"), "hour")


HOUR_SQL = HOURLY_SQL + " SELECT hour(ts) AS hour, round(avg(power), 6) AS mean FROM hourly GROUP BY 1"


def weekday_profile(spark, d):
    return longs(rounded(profile.weekday_profile(hourly(spark, d), "power"), "mean"), "dayofweek")


WEEKDAY_SQL = HOURLY_SQL + f"""
SELECT isodow(ts) - 1 AS dayofweek, round(avg(power), 6) AS mean, {DAYS_SQL}[isodow(ts)] AS day FROM hourly GROUP BY ALL"""


def hour_weekday(spark, d):
    return longs(rounded(profile.hour_weekday_pivot(hourly(spark, d), "power"), *[f"h{h}" for h in range(24)]), "dayofweek")


PIVOT_SQL = HOURLY_SQL + " SELECT isodow(ts) - 1 AS dayofweek, " + ", ".join(
    f"round(avg(power) FILTER (hour(ts) = {h}), 6) AS h{h}" for h in range(24)
) + f", {DAYS_SQL}[isodow(ts)] AS day FROM hourly GROUP BY ALL"


def describe(spark, d):
    return profile.describe(readings(spark, d), MEASURES)


DESCRIBE_SQL = "WITH " + HOURLY_SQL.split("WITH ", 1)[1] + " " + " UNION ALL ".join(
    f"""SELECT '{m}' AS "column", count({m}) AS count, round(avg({m}), 3) AS mean, round(stddev_samp({m}), 3) AS std, round(min({m}), 3) AS min,
    round(quantile_cont({m}, 0.25), 3) AS q25, round(quantile_cont({m}, 0.5), 3) AS q50, round(quantile_cont({m}, 0.75), 3) AS q75,
    round(max({m}), 3) AS max FROM readings""" for m in MEASURES
)


def panel_quantiles(spark, d):
    e = table(spark, d, "lineitem")
    return rounded(exact_quantiles(e, "l_extendedprice", (0.1, 0.5, 0.99), ["l_returnflag", "l_linestatus"]), "quantile", digits=4)


QUANTILES_SQL = " UNION ALL ".join(
    f"SELECT l_returnflag, l_linestatus, CAST({p} AS DOUBLE) AS prob, round(quantile_cont(l_extendedprice, {p}), 4) AS quantile FROM lineitem GROUP BY 1, 2"
    for p in (0.1, 0.5, 0.99)
)


def correlations(spark, d):
    return rounded(profile.correlations(hourly(spark, d), MEASURES), "r")


CORR_SQL = HOURLY_SQL + " " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM hourly" for a in MEASURES for b in MEASURES
)


def histogram_target(spark, d):
    return longs(rounded(profile.histogram(readings(spark, d), "power", 80), "left", "right"), "bin", "count")


HISTOGRAM_SQL = """
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
c AS (SELECT least(CAST(floor((value - lo) / (hi - lo) * 80) AS BIGINT), 79) AS bin, count(*) AS count FROM events, b GROUP BY 1)
SELECT g.bin, round(lo + g.bin * ((hi - lo) / 80), 6) AS "left", round(lo + (g.bin + 1) * ((hi - lo) / 80), 6) AS "right",
       coalesce(count, 0) AS count
FROM (SELECT unnest(range(80)) AS bin) g CROSS JOIN b LEFT JOIN c USING (bin)"""


def histogram_panel(spark, d):
    h = profile.histogram(readings(spark, d), "power", 10, keys=["user_id"])
    return longs(h.select("user_id", "bin", "count"), "bin", "count")


HISTOGRAM_PANEL_SQL = """
WITH b AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
c AS (SELECT user_id, least(CAST(floor((value - lo) / (hi - lo) * 10) AS BIGINT), 9) AS bin, count(*) AS count
      FROM events JOIN b USING (user_id) GROUP BY 1, 2)
SELECT b.user_id, g.bin, coalesce(count, 0) AS count
FROM b CROSS JOIN (SELECT unnest(range(10)) AS bin) g LEFT JOIN c ON c.user_id = b.user_id AND c.bin = g.bin"""


def box_by_weekday(spark, d):
    b = profile.box_by_weekday(readings(spark, d), "power")
    return longs(rounded(b, "q1", "median", "q3", "whisker_low", "whisker_high"), "dayofweek", "outliers")


BOX_SQL = f"""
WITH v AS (SELECT isodow(ts) - 1 AS dayofweek, value AS v FROM events),
q AS (SELECT dayofweek, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY 1)
SELECT dayofweek, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
       round(max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
       count(*) FILTER (NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers,
       {DAYS_SQL}[dayofweek + 1] AS day
FROM v JOIN q USING (dayofweek) GROUP BY dayofweek, q1, median, q3"""


def kpi_cards(spark, d):
    view = filters.date_range(hourly(spark, d), "2024-01-05", "2024-01-20")
    return rounded(profile.kpi_cards(view, "power"), "mean", "peak", "low", "std", "total")


KPI_SQL = HOURLY_SQL + """
SELECT round(avg(power), 6) AS mean, round(max(power), 6) AS peak, round(min(power), 6) AS low, round(stddev_samp(power), 6) AS std,
       round(sum(power), 6) AS total, count(*) AS records
FROM hourly WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"""


def alert_threshold(spark, d):
    return rounded(profile.alert_threshold(user_hourly(spark, d), "power", keys=["user_id"]), "threshold")


THRESHOLD_SQL = USER_HOURLY_SQL + """
SELECT user_id, round(avg(power) + 2.5 * stddev_samp(power), 6) AS threshold FROM user_hourly GROUP BY 1"""


def _naive_models(spark, d):
    """Three naive forecasts of the hourly series as a stacked prediction table."""
    h = hourly(spark, d).select("ts", F.col("power").alias("actual"))
    from ..operators.rolling import lags

    past = lags(h, "actual", (1, 24, 48), layout=WEEKLY)
    tables = {
        name: past.select("ts", "actual", F.col(f"lag_{k}").alias("predicted")).na.drop()
        for name, k in (("Last Hour", 1), ("Last Day", 24), ("Two Days", 48))
    }
    return metrics.union_models(tables)


NAIVE_SQL = HOURLY_SQL + """, past AS (
  SELECT ts, power AS actual, lag(power, 1) OVER w AS l1, lag(power, 24) OVER w AS l24, lag(power, 48) OVER w AS l48
  FROM hourly WINDOW w AS (ORDER BY ts)),
preds AS (SELECT ts, actual, l1 AS predicted, 'Last Hour' AS "Model" FROM past WHERE l1 IS NOT NULL
  UNION ALL SELECT ts, actual, l24, 'Last Day' FROM past WHERE l24 IS NOT NULL
  UNION ALL SELECT ts, actual, l48, 'Two Days' FROM past WHERE l48 IS NOT NULL),
scored AS (SELECT "Model", avg(abs(actual - predicted)) AS "MAE", sqrt(avg((actual - predicted) ** 2)) AS "RMSE",
  avg(abs((actual - predicted) / nullif(actual, 0))) * 100 AS "MAPE",
  1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)) AS "R2" FROM preds GROUP BY 1)"""


def model_union(spark, d):
    return rounded(_naive_models(spark, d), "actual", "predicted")


UNION_SQL = NAIVE_SQL + ' SELECT ts, round(actual, 6) AS actual, round(predicted, 6) AS predicted, "Model" FROM preds'


def residuals(spark, d):
    one = _naive_models(spark, d).where("Model = 'Last Day'").select("ts", "actual", "predicted")
    return rounded(metrics.residual_table(one), "actual", "predicted", "residual", "abs_error")


RESIDUAL_SQL = NAIVE_SQL + """
SELECT ts, round(actual, 6) AS actual, round(predicted, 6) AS predicted, round(actual - predicted, 6) AS residual,
       round(abs(actual - predicted), 6) AS abs_error FROM preds WHERE "Model" = 'Last Day'"""


def residual_histogram(spark, d):
    one = metrics.residual_table(_naive_models(spark, d).where("Model = 'Last Day'"))
    return longs(profile.histogram(one, "residual", 60).select("bin", "count"), "bin", "count")


RESIDUAL_HIST_SQL = NAIVE_SQL + """, r AS (SELECT actual - predicted AS v FROM preds WHERE "Model" = 'Last Day'),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM r),
c AS (SELECT least(CAST(floor((v - lo) / (hi - lo) * 60) AS BIGINT), 59) AS bin, count(*) AS count FROM r, b GROUP BY 1)
SELECT g.bin, coalesce(count, 0) AS count FROM (SELECT unnest(range(60)) AS bin) g LEFT JOIN c USING (bin)"""


def regression_metrics(spark, d):
    return metrics.evaluate(_naive_models(spark, d).where("Model = 'Last Hour'"))


METRICS_SQL = NAIVE_SQL + """
SELECT round_even("MAE", 4) AS "MAE", round_even("RMSE", 4) AS "RMSE", round_even("MAPE", 2) AS "MAPE", round_even("R2", 4) AS "R2"
FROM scored WHERE "Model" = 'Last Hour'"""


def model_comparison(spark, d):
    return metrics.compare_models(_naive_models(spark, d))


COMPARISON_CTE = NAIVE_SQL + """, comparison AS (
SELECT "Model", round_even("MAE", 4) AS "MAE", round_even("RMSE", 4) AS "RMSE", round_even("MAPE", 2) AS "MAPE", round_even("R2", 4) AS "R2"
FROM scored)"""


def best_flags(spark, d):
    return metrics.best_flags(metrics.compare_models(_naive_models(spark, d)))


BEST_SQL = COMPARISON_CTE + """, long AS (UNPIVOT comparison ON "MAE", "RMSE", "MAPE", "R2" INTO NAME metric VALUE value)
SELECT "Model", metric, value, value = CASE WHEN metric = 'R2' THEN max(value) OVER (PARTITION BY metric)
                                            ELSE min(value) OVER (PARTITION BY metric) END AS is_best FROM long"""


def normalised(spark, d):
    return rounded(metrics.normalised(metrics.compare_models(_naive_models(spark, d))), "MAE", "RMSE", "MAPE", "R2")


NORMAL_SQL = COMPARISON_CTE + """
SELECT "Model", """ + ", ".join(
    f'round(1 - ("{m}" - min("{m}") OVER ()) / (max("{m}") OVER () - min("{m}") OVER () + 1e-9), 6) AS "{m}"' for m in ("MAE", "RMSE", "MAPE")
) + """, round(("R2" - min("R2") OVER ()) / (max("R2") OVER () - min("R2") OVER () + 1e-9), 6) AS "R2" FROM comparison"""


def last_rows(spark, d):
    return rounded(filters.last_rows(hourly(spark, d).select("ts", "power"), 168), "power")


LAST_SQL = HOURLY_SQL + " SELECT ts, round(power, 6) AS power FROM hourly ORDER BY ts DESC LIMIT 168"


def last_rows_panel(spark, d):
    e = readings(spark, d).select("user_id", "event_id", "ts", "power")
    return filters.last_rows(e, 5, keys=["user_id"], tie=["event_id"])


LAST_PANEL_SQL = """
SELECT user_id, event_id, ts, value AS power FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5"""


def top_rows(spark, d):
    return filters.top_rows(readings(spark, d).select("event_id", "ts", "power"), 20, "power")


TOP_SQL = "SELECT event_id, ts, value AS power FROM events ORDER BY value DESC, ts LIMIT 20"


def seeded_sample(spark, d):
    return filters.seeded_sample(readings(spark, d).select("event_id", "power"), 300, ids=["event_id"])


SAMPLE_SQL = """
SELECT event_id, value AS power FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'), event_id LIMIT 300"""


def history_and_forecast(spark, d):
    """The last week of history and a same-hour-last-week forecast on one axis."""
    h = hourly(spark, d).select("ts", "power")
    past = filters.last_rows(h, 168).withColumn("kind", F.lit("history"))
    ahead = filters.last_rows(h, 168).withColumn("ts", F.col("ts") + F.expr("INTERVAL 7 DAYS")).withColumn("kind", F.lit("forecast"))
    return rounded(past.unionByName(ahead), "power")


OVERLAY_SQL = HOURLY_SQL + """, tail AS (SELECT ts, power FROM hourly ORDER BY ts DESC LIMIT 168)
SELECT ts, round(power, 6) AS power, 'history' AS kind FROM tail
UNION ALL SELECT ts + INTERVAL 7 DAY, round(power, 6), 'forecast' FROM tail"""


def horizon_summary(spark, d):
    """Mean, peak and total of same-hour forecasts at three horizons."""
    h = hourly(spark, d).select("ts", "power")
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("ts").desc())
    tail = filters.last_rows(h, 168).withColumn("back", F.row_number().over(w))
    tables = {label: tail.where(F.col("back") > 168 - n).select(F.col("power").alias("forecast")) for label, n in (("24h", 24), ("48h", 48), ("7day", 168))}
    return rounded(profile.forecast_summary(metrics.union_models(tables, "horizon"), by=["horizon"]), "mean", "peak", "total")


HORIZON_SQL = HOURLY_SQL + """, tail AS (SELECT power, row_number() OVER (ORDER BY ts DESC) AS back FROM hourly ORDER BY ts DESC LIMIT 168)
""" + " UNION ALL ".join(
    f"SELECT '{label}' AS horizon, round(avg(power), 6) AS mean, round(max(power), 6) AS peak, round(sum(power), 6) AS total FROM tail WHERE back > {168 - n}"
    for label, n in (("24h", 24), ("48h", 48), ("7day", 168))
)


def horizon_means(spark, d):
    from ..operators.split import look_back_windows

    w = look_back_windows(hourly(spark, d), "power", look_back=24, horizon=24, layout=WEEKLY)
    return rounded(metrics.horizon_means(w, ids=["ts"], actual="y", predicted="x"), "actual_mean", "predicted_mean")


HORIZON_MEANS_SQL = HOURLY_SQL + """, m AS (
  SELECT ts, avg(power) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS actual_mean,
         avg(power) OVER (ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS predicted_mean,
         row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM hourly)
SELECT ts, round(actual_mean, 6) AS actual_mean, round(predicted_mean, 6) AS predicted_mean FROM m WHERE rn > 24 AND rn + 23 <= n"""


def order_kpis(spark, d):
    """Daily shipped quantity resampled from line items: mean price and summed quantity."""
    from ..operators.resample import resample

    li = table(spark, d, "lineitem").select(F.col("l_shipdate").alias("ts"), "l_quantity", "l_extendedprice")
    return rounded(resample(li, "d", mean=["l_extendedprice"], total=["l_quantity"]), "l_extendedprice", "l_quantity", digits=4, shift=1.3e-6)


ORDER_KPI_SQL = """
SELECT date_trunc('day', l_shipdate) AS ts, round(avg(l_extendedprice) + 1.3e-6, 4) AS l_extendedprice, round(sum(l_quantity) + 1.3e-6, 4) AS l_quantity
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1"""


QUERIES = {
    "monthly_mean": (monthly, MONTHLY_SQL),
    "hour_profile": (hour_profile, HOUR_SQL),
    "weekday_profile": (weekday_profile, WEEKDAY_SQL),
    "hour_weekday_pivot": (hour_weekday, PIVOT_SQL),
    "describe": (describe, DESCRIBE_SQL),
    "grouped_quantiles": (panel_quantiles, QUANTILES_SQL),
    "correlations": (correlations, CORR_SQL),
    "histogram": (histogram_target, HISTOGRAM_SQL),
    "histogram_panel": (histogram_panel, HISTOGRAM_PANEL_SQL),
    "box_by_weekday": (box_by_weekday, BOX_SQL),
    "kpi_cards": (kpi_cards, KPI_SQL),
    "alert_threshold": (alert_threshold, THRESHOLD_SQL),
    "model_union": (model_union, UNION_SQL),
    "residuals": (residuals, RESIDUAL_SQL),
    "residual_histogram": (residual_histogram, RESIDUAL_HIST_SQL),
    "regression_metrics": (regression_metrics, METRICS_SQL),
    "model_comparison": (model_comparison, COMPARISON_CTE + " SELECT * FROM comparison"),
    "best_flags": (best_flags, BEST_SQL),
    "normalised_comparison": (normalised, NORMAL_SQL),
    "last_rows": (last_rows, LAST_SQL),
    "last_rows_panel": (last_rows_panel, LAST_PANEL_SQL),
    "top_rows": (top_rows, TOP_SQL),
    "seeded_sample": (seeded_sample, SAMPLE_SQL),
    "history_and_forecast": (history_and_forecast, OVERLAY_SQL),
    "horizon_summary": (horizon_summary, HORIZON_SQL),
    "horizon_means": (horizon_means, HORIZON_MEANS_SQL),
    "daily_shipments": (order_kpis, ORDER_KPI_SQL),
}

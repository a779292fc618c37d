"""Ordered window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, rolling
from ..operators.features import LAGS, WINDOWS
from ..operators.split import look_back_windows, mark_split, scale_column, split_report, unscale
from ..plans.positions import DAY, Layout, running_sums
from ..plans.sliding import STATS, sliding
from .base import DAILY, OFF_TIES, HOURLY_SQL, MINUTELY_SQL, USER_HOURLY_SQL, WEEKLY, features, hourly, longs, minutely, rounded, user_hourly


def positions(spark, d):
    return longs(rolling.positions(minutely(spark, d).select("ts"), layout=DAILY), "rn", "n")


POSITIONS_SQL = MINUTELY_SQL + " SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS rn, count(*) OVER () AS n FROM minutely"


def lags(spark, d):
    out = rolling.lags(minutely(spark, d).select("ts", "power"), "power", LAGS, layout=DAILY)
    return rounded(out, "power", *[f"lag_{k}" for k in LAGS])


LAGS_SQL = MINUTELY_SQL + " SELECT ts, round(power, 6) AS power, " + ", ".join(
    f"round(lag(power, {k}) OVER (ORDER BY ts), 6) AS lag_{k}" for k in LAGS
) + " FROM minutely"


def _full(stat: str, value: str, frame: str, rows: int, order: str = "ORDER BY ts") -> str:
    fn = {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min"}[stat]
    over = f"OVER ({order} ROWS BETWEEN {frame})"
    return f"CASE WHEN count({value}) {over} = {rows} THEN {fn}({value}) {over} END"


def trailing(spark, d):
    out = rolling.trailing(minutely(spark, d).select("ts", "power"), "power", WINDOWS, layout=DAILY)
    return rounded(out, "power", *[f"rolling_{s}_{w}" for w in WINDOWS for s in rolling.STATS], shift=OFF_TIES)


TRAILING_SQL = MINUTELY_SQL + f" SELECT ts, round(power + {OFF_TIES}, 6) AS power, " + ", ".join(
    f"round({_full(s, 'power', f'{w} PRECEDING AND 1 PRECEDING', w)} + {OFF_TIES}, 6) AS rolling_{s}_{w}" for w in WINDOWS for s in rolling.STATS
) + " FROM minutely"


def trailing_week(spark, d):
    view = filters.date_range(hourly(spark, d).select("ts", "power"), "2024-01-05", "2024-01-28")
    out = rolling.trailing(view, "power", [168], stats=["mean"], include_current=True, layout=WEEKLY)
    return rounded(out, "power", "rolling_mean_168")


TRAILING_WEEK_SQL = HOURLY_SQL + f"""
SELECT ts, round(power, 6) AS power, round({_full('mean', 'power', '167 PRECEDING AND CURRENT ROW', 168)}, 6) AS rolling_mean_168
FROM hourly WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-28'"""


def live_tail(spark, d):
    tail = filters.last_rows(hourly(spark, d).select("ts", "power"), 200)
    out = rolling.trailing(tail, "power", [24], stats=["mean"], include_current=True, layout=WEEKLY)
    return rounded(out, "power", "rolling_mean_24")


LIVE_TAIL_SQL = HOURLY_SQL + f""", tail AS (SELECT ts, power FROM hourly ORDER BY ts DESC LIMIT 200)
SELECT ts, round(power, 6) AS power, round({_full('mean', 'power', '23 PRECEDING AND CURRENT ROW', 24)}, 6) AS rolling_mean_24 FROM tail"""


def centred_full(spark, d):
    out = rolling.centred(minutely(spark, d).select("ts", "power"), "power", layout=DAILY)
    return rounded(out, "power", "roll_mean", "roll_std", shift=OFF_TIES)


_CENTRED = "12 PRECEDING AND 11 FOLLOWING"
CENTRED_FULL_SQL = MINUTELY_SQL + f"""
SELECT ts, round(power + {OFF_TIES}, 6) AS power, round({_full('mean', 'power', _CENTRED, 24)} + {OFF_TIES}, 6) AS roll_mean,
       round({_full('std', 'power', _CENTRED, 24)} + {OFF_TIES}, 6) AS roll_std FROM minutely"""


def centred_partial(spark, d):
    out = rolling.centred(user_hourly(spark, d).select("user_id", "ts", "power"), "power", partial_edges=True, keys=["user_id"])
    return rounded(out, "power", "roll_mean", "roll_std", shift=OFF_TIES)


CENTRED_PARTIAL_SQL = USER_HOURLY_SQL + f"""
SELECT user_id, ts, round(power + {OFF_TIES}, 6) AS power,
       round(avg(power) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN {_CENTRED}) + {OFF_TIES}, 6) AS roll_mean,
       round(coalesce(stddev_samp(power) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN {_CENTRED}), 1) + {OFF_TIES}, 6) AS roll_std
FROM user_hourly"""


def seasonal_difference(spark, d):
    out = rolling.difference(hourly(spark, d).select("ts", "power"), "power", layout=WEEKLY)
    return rounded(out, "power", "diff")


DIFF_SQL = HOURLY_SQL + """
SELECT ts, round(power, 6) AS power, round((power - lag(power, 1) OVER w) - (lag(power, 24) OVER w - lag(power, 25) OVER w), 6) AS diff
FROM hourly WINDOW w AS (ORDER BY ts)"""


def undifference(spark, d):
    h = hourly(spark, d).select("ts", "power")
    first = rolling.difference(h, "power", seasonal=0, layout=WEEKLY)
    anchored = first.withColumn("start", h.agg(F.min_by("power", "ts").alias("s")).scalar())
    return rounded(rolling.undifference(anchored, "diff", "start", layout=WEEKLY).select("ts", "level"), "level")


UNDIFF_SQL = HOURLY_SQL + " SELECT ts, round(power, 6) AS level FROM hourly"


def running_total(spark, d):
    out = running_sums(minutely(spark, d).select("ts", "power"), {"total": F.col("power")}, layout=DAILY)
    return rounded(out, "power", "total", digits=4)


RUNNING_SQL = MINUTELY_SQL + """
SELECT ts, round(power, 4) AS power, round(sum(power) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS total FROM minutely"""


def feature_build(spark, d):
    f = features(spark, d)
    ints = ("hour", "dayofweek", "month", "quarter", "dayofyear", "weekofyear", "is_weekend")
    return rounded(longs(f, *ints), *[c for c in f.columns if c not in ("ts", *ints)], shift=OFF_TIES)


_HISTORY = ", ".join(
    [f"lag(power, {k}) OVER w AS lag_{k}" for k in LAGS]
    + [f"{_full(s, 'power', f'{w} PRECEDING AND 1 PRECEDING', w)} AS rolling_{s}_{w}" for w in WINDOWS for s in rolling.STATS]
)
_NUMBERS = ["power", "level", "sub_click", "sub_view", "sub_purchase", *[f"lag_{k}" for k in LAGS]] + [
    f"rolling_{s}_{w}" for w in WINDOWS for s in rolling.STATS
]
FEATURES_CTE = HOURLY_SQL + f""", history AS (SELECT *, {_HISTORY} FROM hourly WINDOW w AS (ORDER BY ts)),
feats AS (SELECT *, hour(ts) AS hour, isodow(ts) - 1 AS dayofweek, month(ts) AS month, quarter(ts) AS quarter,
       dayofyear(ts) AS dayofyear, weekofyear(ts) AS weekofyear, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend,
       sin(2 * pi() * hour(ts) / 24.0) AS hour_sin, cos(2 * pi() * hour(ts) / 24.0) AS hour_cos,
       sin(2 * pi() * month(ts) / 12.0) AS month_sin, cos(2 * pi() * month(ts) / 12.0) AS month_cos
  FROM history WHERE lag_48 IS NOT NULL)"""
FEATURES_SQL = FEATURES_CTE + """
SELECT ts, hour, dayofweek, month, quarter, dayofyear, weekofyear, is_weekend, """ + ", ".join(
    f"round({c} + {OFF_TIES}, 6) AS {c}" for c in [*_NUMBERS, "hour_sin", "hour_cos", "month_sin", "month_cos"]
) + " FROM feats"


def chronological_split(spark, d):
    return rounded(mark_split(hourly(spark, d).select("ts", "power"), layout=WEEKLY), "power")


SPLIT_CTE = HOURLY_SQL + """, marked AS (
  SELECT ts, power, row_number() OVER (ORDER BY ts) - 1 < floor(count(*) OVER () * 0.8) AS is_train FROM hourly)"""
SPLIT_SQL = SPLIT_CTE + " SELECT ts, round(power, 6) AS power, is_train FROM marked"


def split_periods(spark, d):
    return split_report(mark_split(hourly(spark, d).select("ts"), layout=WEEKLY))


SPLIT_REPORT_SQL = SPLIT_CTE + """
SELECT is_train, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM marked GROUP BY 1"""


def panel_split(spark, d):
    out = mark_split(user_hourly(spark, d).select("user_id", "ts", "power"), keys=["user_id"])
    return rounded(out, "power")


PANEL_SPLIT_SQL = USER_HOURLY_SQL + """
SELECT user_id, ts, round(power, 6) AS power,
       row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 < floor(count(*) OVER (PARTITION BY user_id) * 0.8) AS is_train
FROM user_hourly"""


def look_back(spark, d):
    w = look_back_windows(hourly(spark, d), "power", layout=WEEKLY)
    flat = w.select("ts", "y", F.posexplode("x").alias("step", "x"))
    return rounded(longs(flat, "step"), "x", "y")


LOOK_BACK_SQL = HOURLY_SQL + """, placed AS (SELECT ts, power, row_number() OVER (ORDER BY ts) - 1 AS rn FROM hourly)
SELECT a.ts, round(a.power, 6) AS y, b.rn - a.rn + 48 AS step, round(b.power, 6) AS x
FROM placed a JOIN placed b ON b.rn BETWEEN a.rn - 48 AND a.rn - 1 WHERE a.rn >= 48"""


def multi_step(spark, d):
    w = look_back_windows(hourly(spark, d), "power", horizon=24, layout=WEEKLY)
    flat = w.select("ts", F.element_at("x", 1).alias("x_first"), F.element_at("x", -1).alias("x_last"), F.posexplode("y").alias("step", "y"))
    return rounded(longs(flat, "step"), "x_first", "x_last", "y")


MULTI_STEP_SQL = HOURLY_SQL + """, placed AS (
  SELECT ts, power, row_number() OVER w - 1 AS rn, lag(power, 48) OVER w AS x_first, lag(power, 1) OVER w AS x_last, count(*) OVER () AS n
  FROM hourly WINDOW w AS (ORDER BY ts))
SELECT a.ts, round(a.x_first, 6) AS x_first, round(a.x_last, 6) AS x_last, b.rn - a.rn AS step, round(b.power, 6) AS y
FROM placed a JOIN placed b ON b.rn BETWEEN a.rn AND a.rn + 23 WHERE a.rn >= 48 AND a.rn + 24 <= a.n"""


def min_max_scale(spark, d):
    s = scale_column(hourly(spark, d).select("ts", "power"), "power")
    back = s.withColumn("restored", unscale(F.col("scaled"), F.col("lo"), F.col("hi")))
    return rounded(back, "power", "lo", "hi", "scaled", "restored")


SCALE_SQL = HOURLY_SQL + """, b AS (SELECT min(power) AS lo, max(power) AS hi FROM hourly)
SELECT ts, round(power, 6) AS power, round(lo, 6) AS lo, round(hi, 6) AS hi,
       round((power - lo) / (hi - lo), 6) AS scaled, round(power, 6) AS restored FROM hourly, b"""


def train_scale(spark, d):
    marked = mark_split(hourly(spark, d).select("ts", "power"), layout=WEEKLY)
    return rounded(scale_column(marked, "power", fit_on="train").select("ts", "scaled"), "scaled")


TRAIN_SCALE_SQL = SPLIT_CTE + """, b AS (SELECT min(power) AS lo, max(power) AS hi FROM marked WHERE is_train)
SELECT ts, round((power - lo) / (hi - lo), 6) AS scaled FROM marked, b"""


def panel_scale(spark, d):
    s = scale_column(user_hourly(spark, d).select("user_id", "ts", "power"), "power", keys=["user_id"])
    return rounded(s.select("user_id", "ts", "scaled"), "scaled")


PANEL_SCALE_SQL = USER_HOURLY_SQL + """, b AS (SELECT user_id, min(power) AS lo, max(power) AS hi FROM user_hourly GROUP BY 1)
SELECT user_id, ts, round((power - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS scaled FROM user_hourly JOIN b USING (user_id)"""


def sliding_day(spark, d):
    """The last 1,440 rows of a minutely series, in blocks of 512."""
    layout = Layout("sliced", DAY, chunk_rows=512)
    out = sliding(minutely(spark, d).select("ts", "power"), "power", 1_440, layout=layout)
    return rounded(out, "power", *[f"sliding_{s}_1440" for s in STATS], shift=OFF_TIES)


SLIDING_DAY_SQL = MINUTELY_SQL + f" SELECT ts, round(power + {OFF_TIES}, 6) AS power, " + ", ".join(
    f"round({_full(s, 'power', '1440 PRECEDING AND 1 PRECEDING', 1440)} + {OFF_TIES}, 6) AS sliding_{s}_1440" for s in STATS
) + " FROM minutely"


def sliding_panel(spark, d):
    """The last week of hours of each user, with the current one, as soon as two values are there."""
    layout = Layout("sliced", 7 * DAY, chunk_rows=50)
    rows = user_hourly(spark, d).select("user_id", "ts", "power")
    out = sliding(rows, "power", 168, include_current=True, min_values=2, keys=["user_id"], layout=layout)
    return rounded(out, "power", *[f"sliding_{s}_168" for s in STATS], shift=OFF_TIES)


SLIDING_PANEL_SQL = USER_HOURLY_SQL + f" SELECT user_id, ts, round(power + {OFF_TIES}, 6) AS power, " + ", ".join(
    f"round(CASE WHEN count(power) OVER w >= 2 THEN {fn}(power) OVER w END + {OFF_TIES}, 6) AS sliding_{s}_168"
    for s, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min"))
) + " FROM user_hourly WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)"


QUERIES = {
    "sliding_day": (sliding_day, SLIDING_DAY_SQL),
    "sliding_panel": (sliding_panel, SLIDING_PANEL_SQL),
    "positions": (positions, POSITIONS_SQL),
    "lags": (lags, LAGS_SQL),
    "trailing_stats": (trailing, TRAILING_SQL),
    "trailing_week": (trailing_week, TRAILING_WEEK_SQL),
    "live_tail": (live_tail, LIVE_TAIL_SQL),
    "centred_full": (centred_full, CENTRED_FULL_SQL),
    "centred_partial_panel": (centred_partial, CENTRED_PARTIAL_SQL),
    "seasonal_difference": (seasonal_difference, DIFF_SQL),
    "undifference": (undifference, UNDIFF_SQL),
    "running_total": (running_total, RUNNING_SQL),
    "feature_build": (feature_build, FEATURES_SQL),
    "chronological_split": (chronological_split, SPLIT_SQL),
    "split_periods": (split_periods, SPLIT_REPORT_SQL),
    "panel_split": (panel_split, PANEL_SPLIT_SQL),
    "look_back_windows": (look_back, LOOK_BACK_SQL),
    "multi_step_windows": (multi_step, MULTI_STEP_SQL),
    "min_max_scale": (min_max_scale, SCALE_SQL),
    "train_only_scale": (train_scale, TRAIN_SCALE_SQL),
    "panel_scale": (panel_scale, PANEL_SCALE_SQL),
}

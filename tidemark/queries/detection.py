"""Detectors, severity and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, anomaly, filters
from .base import (
    DAILY, HOURLY_SQL, MINUTELY_SQL, OFF_TIES, USER_HOURLY_SQL, WEEKLY, hourly, longs, minutely, rounded, user_hourly,
)
from .windows import _CENTRED, _full


def zscore(spark, d):
    return rounded(anomaly.detect_zscore(minutely(spark, d).select("ts", "power"), "power"), "power")


ZSCORE_SQL = MINUTELY_SQL + """, s AS (SELECT avg(power) AS mu, stddev_pop(power) AS sd FROM minutely)
SELECT ts, round(power, 6) AS power, abs(power - mu) / sd > 3 AS zscore FROM minutely, s"""


def zscore_panel(spark, d):
    out = anomaly.detect_zscore(user_hourly(spark, d).select("user_id", "ts", "power"), "power", keys=["user_id"])
    return rounded(out, "power")


ZSCORE_PANEL_SQL = USER_HOURLY_SQL + """, s AS (SELECT user_id, avg(power) AS mu, stddev_pop(power) AS sd FROM user_hourly GROUP BY 1)
SELECT user_id, ts, round(power, 6) AS power, coalesce(abs(power - mu) / nullif(sd, 0) > 3, false) AS zscore FROM user_hourly JOIN s USING (user_id)"""


def rolling_threshold(spark, d):
    return rounded(anomaly.detect_rolling(minutely(spark, d).select("ts", "power"), "power", layout=DAILY), "power")


_MEAN24, _STD24 = _full("mean", "power", _CENTRED, 24), _full("std", "power", _CENTRED, 24)
ROLLING_SQL = MINUTELY_SQL + f""", b AS (SELECT ts, power, {_MEAN24} AS m, {_STD24} AS s FROM minutely)
SELECT ts, round(power, 6) AS power, coalesce(power > m + 3 * s OR power < m - 3 * s, false) AS rolling FROM b"""


def severity_hourly(spark, d):
    out = alerts.assign_severity(hourly(spark, d), "power", layout=WEEKLY)
    return rounded(out, "value", "roll_mean", "roll_std")


def _severity_cte(source: str, base: str, key: str = "") -> str:
    part = f"PARTITION BY {key} " if key else ""
    k = f"{key}, " if key else ""
    return f"""{source}, rolled AS (
  SELECT {k}ts, power AS value, avg(power) OVER w AS roll_mean, coalesce(stddev_samp(power) OVER w, 1) AS roll_std
  FROM {base} WINDOW w AS ({part}ORDER BY ts ROWS BETWEEN {_CENTRED})),
zed AS (SELECT *, abs((value - roll_mean) / nullif(roll_std, 0)) AS z FROM rolled),
graded AS (SELECT *, round_even(z, 3) AS z_score,
  CASE WHEN z >= 2 AND z < 2.5 THEN 'LOW' WHEN z >= 2.5 AND z < 3 THEN 'MEDIUM' WHEN z >= 3 AND z < 4 THEN 'HIGH'
       WHEN z >= 4 AND z < 9999 THEN 'CRITICAL' ELSE 'NORMAL' END AS severity FROM zed),
severities AS (SELECT {k}ts, value, roll_mean, roll_std, z_score, severity, severity <> 'NORMAL' AS is_anomaly FROM graded)"""


HOURLY_SEVERITY = _severity_cte(HOURLY_SQL, "hourly")
SEVERITY_SQL = HOURLY_SEVERITY + """
SELECT ts, round(value, 6) AS value, round(roll_mean, 6) AS roll_mean, round(roll_std, 6) AS roll_std, z_score, severity, is_anomaly FROM severities"""


def severity_panel(spark, d):
    out = alerts.assign_severity(user_hourly(spark, d), "power", keys=["user_id"])
    return rounded(out.drop("roll_mean", "roll_std"), "value")


PANEL_SEVERITY = _severity_cte(USER_HOURLY_SQL, "user_hourly", "user_id")
SEVERITY_PANEL_SQL = PANEL_SEVERITY + " SELECT user_id, ts, round(value, 6) AS value, z_score, severity, is_anomaly FROM severities"

MINUTE_SEVERITY = _severity_cte(MINUTELY_SQL, "minutely")


def _minute_severity(spark, d):
    return alerts.assign_severity(minutely(spark, d), "power", layout=DAILY)


def severity_minutely(spark, d):
    return rounded(_minute_severity(spark, d), "value", "roll_mean", "roll_std", shift=OFF_TIES)


SEVERITY_MINUTE_SQL = MINUTE_SEVERITY + f"""
SELECT ts, round(value + {OFF_TIES}, 6) AS value, round(roll_mean + {OFF_TIES}, 6) AS roll_mean,
       round(roll_std + {OFF_TIES}, 6) AS roll_std, z_score, severity, is_anomaly FROM severities"""


def alert_log(spark, d):
    log = alerts.alert_log(_minute_severity(spark, d))
    return rounded(log.select("ts", "value", "z_score", "severity", F.col("detected_at").isNotNull().alias("stamped")), "value")


ALERT_LOG_SQL = MINUTE_SEVERITY + " SELECT ts, round(value, 6) AS value, z_score, severity, true AS stamped FROM severities WHERE is_anomaly"


def top_alerts(spark, d):
    return rounded(alerts.top_alerts(_minute_severity(spark, d)), "value", "roll_mean", shift=OFF_TIES)


TOP_ALERTS_SQL = MINUTE_SEVERITY + f"""
SELECT ts, round(value + {OFF_TIES}, 6) AS value, round(roll_mean + {OFF_TIES}, 6) AS roll_mean, z_score, severity
FROM severities WHERE is_anomaly ORDER BY z_score DESC, ts LIMIT 50"""


def alert_table(spark, d):
    log = filters.flagged(_minute_severity(spark, d), "is_anomaly")
    out = alerts.alert_table(log, levels=("CRITICAL", "HIGH", "MEDIUM"), sort_by="severity")
    return longs(rounded(out, "value"), "severity_rank")


ALERT_TABLE_SQL = MINUTE_SEVERITY + """
SELECT ts, round(value, 6) AS value, z_score, severity, CAST(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END AS BIGINT) AS severity_rank
FROM severities WHERE is_anomaly AND severity IN ('CRITICAL', 'HIGH', 'MEDIUM') ORDER BY severity DESC, ts LIMIT 200"""


def severity_counts(spark, d):
    return alerts.severity_counts(_minute_severity(spark, d))


COUNTS_SQL = MINUTE_SEVERITY + """
SELECT l.severity, count(s.ts) AS count FROM (SELECT unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS severity) l
LEFT JOIN severities s USING (severity) GROUP BY 1"""


def alerts_by_hour(spark, d):
    return longs(alerts.alerts_by_hour(filters.flagged(_minute_severity(spark, d), "is_anomaly")), "hour")


BY_HOUR_SQL = MINUTE_SEVERITY + " SELECT hour(ts) AS hour, count(*) AS count FROM severities WHERE is_anomaly GROUP BY 1"


def report_header(spark, d):
    return rounded(alerts.report_header(_minute_severity(spark, d)), "rate_pct")


HEADER_SQL = MINUTE_SEVERITY + """
SELECT count(*) AS total, count(*) FILTER (is_anomaly) AS alerts, round(count(*) FILTER (is_anomaly) * 100.0 / count(*), 6) AS rate_pct FROM severities"""


def severity_filter(spark, d):
    return rounded(filters.flagged_with_level(_minute_severity(spark, d), "is_anomaly", "HIGH").select("ts", "value", "z_score"), "value")


FILTER_SQL = MINUTE_SEVERITY + " SELECT ts, round(value, 6) AS value, z_score FROM severities WHERE is_anomaly AND severity = 'HIGH'"


def membership_filter(spark, d):
    return rounded(filters.with_members(_minute_severity(spark, d), "severity", ["LOW", "CRITICAL"]).select("ts", "value", "severity"), "value")


MEMBER_SQL = MINUTE_SEVERITY + " SELECT ts, round(value, 6) AS value, severity FROM severities WHERE severity IN ('LOW', 'CRITICAL')"


def severity_timeline(spark, d):
    return rounded(alerts.severity_timeline(_minute_severity(spark, d)), "value")


TIMELINE_SQL = MINUTE_SEVERITY + " SELECT severity, ts, round(value, 6) AS value FROM severities WHERE is_anomaly"


def _combined(spark, d):
    return anomaly.combined_anomalies(minutely(spark, d), "power", layout=DAILY)


COMBINED_CTE = MINUTE_SEVERITY + f""", b AS (SELECT ts, power, {_MEAN24} AS m, {_STD24} AS s FROM minutely),
st AS (SELECT avg(power) AS mu, stddev_pop(power) AS sd FROM minutely),
combined AS (SELECT ts, value, abs(value - mu) / sd > 3 AS zscore,
  coalesce(power > m + 3 * s OR power < m - 3 * s, false) AS rolling, severity, z_score
  FROM severities JOIN b USING (ts), st)"""


def combined_anomalies(spark, d):
    return rounded(_combined(spark, d), "value")


COMBINED_SQL = COMBINED_CTE + " SELECT ts, round(value, 6) AS value, zscore, rolling, severity, z_score FROM combined"


def anomaly_summary(spark, d):
    return rounded(anomaly.anomaly_summary(_combined(spark, d), "zscore"), "rate_pct", "mean_deviation", digits=5)


SUMMARY_SQL = COMBINED_CTE + """
SELECT count(*) AS points, count(*) FILTER (zscore) AS anomalies, round(count(*) FILTER (zscore) * 100.0 / count(*), 5) AS rate_pct,
       round(avg(z_score) FILTER (zscore), 5) AS mean_deviation FROM combined"""


def anomalies_by_hour(spark, d):
    return longs(anomaly.anomalies_by_hour(_combined(spark, d), "zscore"), "hour")


def anomalies_by_weekday(spark, d):
    return longs(anomaly.anomalies_by_weekday(_combined(spark, d), "zscore"), "dayofweek")


WEEKDAY_SQL = COMBINED_CTE + """
SELECT isodow(ts) - 1 AS dayofweek, count(*) AS count, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(ts)] AS day
FROM combined WHERE zscore GROUP BY ALL"""


def detector_comparison(spark, d):
    return anomaly.detector_comparison(_combined(spark, d))


DETECTORS_SQL = COMBINED_CTE + " " + " UNION ALL ".join(
    f"SELECT '{m}' AS method, count(*) FILTER ({m}) AS anomalies, round(count(*) FILTER ({m}) * 100.0 / count(*), 3) AS rate_pct FROM combined"
    for m in ("zscore", "rolling")
)


def align_flags(spark, d):
    m = minutely(spark, d).select("ts", "power")
    some = m.where("power > 50").select("ts", (F.col("power") > 150).alias("high"))
    return rounded(anomaly.align_flags(m, some, "high"), "power")


ALIGN_SQL = MINUTELY_SQL + " SELECT ts, round(power, 6) AS power, power > 150 AS high FROM minutely"


QUERIES = {
    "zscore_detector": (zscore, ZSCORE_SQL),
    "zscore_panel": (zscore_panel, ZSCORE_PANEL_SQL),
    "rolling_detector": (rolling_threshold, ROLLING_SQL),
    "severity_hourly": (severity_hourly, SEVERITY_SQL),
    "severity_minutely": (severity_minutely, SEVERITY_MINUTE_SQL),
    "severity_panel": (severity_panel, SEVERITY_PANEL_SQL),
    "alert_log": (alert_log, ALERT_LOG_SQL),
    "top_alerts": (top_alerts, TOP_ALERTS_SQL),
    "alert_table": (alert_table, ALERT_TABLE_SQL),
    "severity_counts": (severity_counts, COUNTS_SQL),
    "alerts_by_hour": (alerts_by_hour, BY_HOUR_SQL),
    "report_header": (report_header, HEADER_SQL),
    "severity_filter": (severity_filter, FILTER_SQL),
    "membership_filter": (membership_filter, MEMBER_SQL),
    "severity_timeline": (severity_timeline, TIMELINE_SQL),
    "combined_anomalies": (combined_anomalies, COMBINED_SQL),
    "anomaly_summary": (anomaly_summary, SUMMARY_SQL),
    "anomalies_by_hour": (anomalies_by_hour, COMBINED_CTE + " SELECT hour(ts) AS hour, count(*) AS count FROM combined WHERE zscore GROUP BY 1"),
    "anomalies_by_weekday": (anomalies_by_weekday, WEEKDAY_SQL),
    "detector_comparison": (detector_comparison, DETECTORS_SQL),
    "align_flags": (align_flags, ALIGN_SQL),
}

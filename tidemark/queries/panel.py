"""Report operators over many series: one row set per user, next to the same in SQL."""

from __future__ import annotations

from ..operators import alerts, anomaly, profile
from .base import OFF_TIES, READINGS_SQL, USER_HOURLY_SQL, longs, readings, rounded, user_hourly
from .detection import PANEL_SEVERITY

KEY = ["user_id"]


def _severities(spark, d):
    return alerts.assign_severity(user_hourly(spark, d), "power", keys=KEY)


def hours(spark, d):
    return longs(rounded(profile.hour_profile(user_hourly(spark, d), "power", keys=KEY), "mean", shift=OFF_TIES), "hour")


HOURS_SQL = USER_HOURLY_SQL + f"""
SELECT user_id, hour(ts) AS hour, round(avg(power) + {OFF_TIES}, 6) AS mean FROM user_hourly GROUP BY 1, 2"""


def cards(spark, d):
    out = profile.kpi_cards(user_hourly(spark, d), "power", keys=KEY)
    return rounded(out, "mean", "peak", "low", "std", "total", shift=OFF_TIES)


CARDS_SQL = USER_HOURLY_SQL + f"""
SELECT user_id, round(avg(power) + {OFF_TIES}, 6) AS mean, round(max(power) + {OFF_TIES}, 6) AS peak,
       round(min(power) + {OFF_TIES}, 6) AS low, round(stddev_samp(power) + {OFF_TIES}, 6) AS std,
       round(sum(power) + {OFF_TIES}, 6) AS total, count(*) AS records
FROM user_hourly GROUP BY 1"""


def describe(spark, d):
    out = profile.describe(readings(spark, d), ["power", "level"], keys=KEY, digits=6)
    return out.select("user_id", "column", "count", "min", "max", *[f"q{p}" for p in (25, 50, 75)])


DESCRIBE_SQL = "WITH " + READINGS_SQL + """, l AS (SELECT user_id, 'power' AS "column", power AS v FROM readings
  UNION ALL SELECT user_id, 'level', level FROM readings)
SELECT user_id, "column", count(v) AS count, round(min(v), 6) AS min, round(max(v), 6) AS max,
       round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75
FROM l GROUP BY 1, 2"""


def counts(spark, d):
    return alerts.severity_counts(_severities(spark, d), keys=KEY)


COUNTS_SQL = PANEL_SEVERITY + """
SELECT user_id, s.severity, count(*) FILTER (v.severity = s.severity) AS count
FROM severities v, (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) s(severity) GROUP BY 1, 2"""


def header(spark, d):
    return rounded(alerts.report_header(_severities(spark, d), keys=KEY), "rate_pct", digits=4)


HEADER_SQL = PANEL_SEVERITY + """
SELECT user_id, count(*) AS total, count(*) FILTER (is_anomaly) AS alerts,
       round(count(*) FILTER (is_anomaly) * 100.0 / count(*), 4) AS rate_pct FROM severities GROUP BY 1"""


def top(spark, d):
    return rounded(alerts.top_alerts(_severities(spark, d), 100, keys=KEY), "value", "roll_mean", shift=OFF_TIES)


TOP_SQL = PANEL_SEVERITY + f"""
SELECT user_id, ts, round(value + {OFF_TIES}, 6) AS value, round(roll_mean + {OFF_TIES}, 6) AS roll_mean, z_score, severity
FROM severities WHERE is_anomaly ORDER BY z_score DESC, ts, user_id LIMIT 100"""


def by_weekday(spark, d):
    out = anomaly.anomalies_by_weekday(_severities(spark, d), "is_anomaly", keys=KEY)
    return longs(out.select("user_id", "dayofweek", "count"), "dayofweek")


BY_WEEKDAY_SQL = PANEL_SEVERITY + """
SELECT user_id, isodow(ts) - 1 AS dayofweek, count(*) AS count FROM severities WHERE is_anomaly GROUP BY 1, 2"""


def summary(spark, d):
    return rounded(anomaly.anomaly_summary(_severities(spark, d), "is_anomaly", keys=KEY), "rate_pct", "mean_deviation", shift=OFF_TIES)


SUMMARY_SQL = PANEL_SEVERITY + f"""
SELECT user_id, count(*) AS points, count(*) FILTER (is_anomaly) AS anomalies,
       round(avg(is_anomaly::INT) * 100 + {OFF_TIES}, 6) AS rate_pct,
       round(avg(z_score) FILTER (is_anomaly) + {OFF_TIES}, 6) AS mean_deviation FROM severities GROUP BY 1"""

QUERIES = {
    "panel_hour_profile": (hours, HOURS_SQL),
    "panel_kpi_cards": (cards, CARDS_SQL),
    "panel_describe": (describe, DESCRIBE_SQL),
    "panel_severity_counts": (counts, COUNTS_SQL),
    "panel_report_header": (header, HEADER_SQL),
    "panel_top_alerts": (top, TOP_SQL),
    "panel_alerts_by_weekday": (by_weekday, BY_WEEKDAY_SQL),
    "panel_anomaly_summary": (summary, SUMMARY_SQL),
}

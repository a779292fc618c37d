"""Severity, alert log and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.severity import NORMAL, SEVERITY_BANDS, severity, severity_rank
from ..plans.positions import Layout
from .rolling import centred


def severity_columns(df: DataFrame, value: str = "value") -> DataFrame:
    """Deviation from ``roll_mean`` in ``roll_std`` units, its band, and the anomaly flag.

    Bands use the unrounded deviation; the column shows three digits.
    """
    z = F.abs(F.try_divide(F.col(value) - F.col("roll_mean"), F.col("roll_std")))
    banded = df.withColumn("__z", z).withColumn("severity", severity(F.col("__z")))
    return banded.withColumns({"z_score": F.bround("__z", 3), "is_anomaly": F.col("severity") != NORMAL}).drop("__z")


def assign_severity(
    df: DataFrame,
    value: str,
    *,
    window: int = 24,
    keys: Sequence[str] = (),
    ts: str = "ts",
    layout: Layout | None = None,
) -> DataFrame:
    base = df.select(*keys, ts, F.col(value).alias("value"))
    rolled = centred(base, "value", window, partial_edges=True, keys=keys, ts=ts, layout=layout)
    return severity_columns(rolled).select(
        *keys, ts, "value", "roll_mean", "roll_std", "z_score", "severity", "is_anomaly"
    )


def alert_log(severities: DataFrame) -> DataFrame:
    """Anomalous rows with the moment of detection."""
    return severities.where("is_anomaly").withColumn("detected_at", F.current_timestamp())


def severity_counts(alerts: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Alerts per severity; all four levels, zero when absent."""
    one = alerts.groupBy(*keys).agg(*[F.count_if(F.col("severity") == level).alias(level) for level in SEVERITY_BANDS])
    return one.unpivot(list(keys), list(SEVERITY_BANDS), "severity", "count")


def alerts_by_hour(alerts: DataFrame, *, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    return alerts.groupBy(*keys, F.hour(ts).alias("hour")).agg(F.count("*").alias("count")).orderBy(*keys, "hour")


def report_header(severities: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    return severities.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if("is_anomaly").alias("alerts"),
        (F.try_divide(F.count_if("is_anomaly"), F.count("*")) * 100).alias("rate_pct"),
    )


def top_alerts(severities: DataFrame, n: int = 50, *, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """The report's alert rows over all series: largest deviation first, earlier time first on ties."""
    ordered = severities.where("is_anomaly").orderBy(F.col("z_score").desc(), ts, *keys)
    return ordered.select(*keys, ts, "value", "roll_mean", "z_score", "severity").limit(n)


def alert_table(
    alerts: DataFrame,
    *,
    levels: Sequence[str] = ("CRITICAL", "HIGH", "MEDIUM", "LOW"),
    sort_by: str = "z_score",
    n: int = 200,
    keys: Sequence[str] = (),
    ts: str = "ts",
) -> DataFrame:
    """Filtered alert list, largest ``sort_by`` first.

    ``severity`` sorts by its letters; use ``severity_rank`` to sort by urgency.
    """
    chosen = alerts.where(F.col("severity").isin(*levels)).withColumn("severity_rank", severity_rank(F.col("severity")))
    return chosen.orderBy(F.col(sort_by).desc(), ts, *keys).limit(n).select(*keys, ts, "value", "z_score", "severity", "severity_rank")


def severity_timeline(alerts: DataFrame, *, ts: str = "ts") -> DataFrame:
    """Points of the alert timeline, one series per severity."""
    return alerts.where("is_anomaly").select("severity", ts, "value")

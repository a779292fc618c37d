"""Streaming jobs, run over everything that has arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.positions import Layout
from ..plans.session import materialize, scratch_path
from ..streaming.jobs import live_tail, live_view, monitor, resample_stream
from ..operators.rolling import trailing
from ..streaming.sources import run_available, stream_files
from ..streaming.state import adaptive_monitor, latest_tail, live_series, use_state_store
from .base import OFF_TIES, longs, rounded, table


def _events(spark, d):
    schema = table(spark, d, "events").schema
    return stream_files(spark, d, schema, glob="events.parquet")


def _ntz(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def threshold_monitor(spark, d):
    """Each user's readings against the user's own mean plus 2.5 deviations; the mean is the forecast."""
    limits = table(spark, d, "events").groupBy("user_id").agg(
        F.avg("value").alias("predicted"), (F.avg("value") + 2.5 * F.stddev_samp("value")).alias("threshold")
    )
    # written once: every trigger joins the small table, not the whole history
    live = monitor(_events(spark, d), materialize(limits, "thresholds"), value="value", keys=["user_id"])
    out = scratch_path(spark, "monitor")
    run_available(live.select("event_id", "ts", "value", "abs_error", "status"), out, scratch_path(spark, "monitor-state"))
    return _ntz(rounded(spark.read.parquet(out), "abs_error", shift=OFF_TIES))


MONITOR_SQL = f"""
WITH l AS (SELECT user_id, avg(value) AS predicted, avg(value) + 2.5 * stddev_samp(value) AS threshold FROM events GROUP BY 1)
SELECT event_id, ts, value, round(abs(value - predicted) + {OFF_TIES}, 6) AS abs_error,
       CASE WHEN value > threshold THEN 'HIGH ALERT' ELSE 'Normal' END AS status FROM events JOIN l USING (user_id)"""


def stream_resample(spark, d):
    hourly = resample_stream(_events(spark, d), "h", mean=["value"], keys=["event_type"])
    out = scratch_path(spark, "hours")
    run_available(hourly, out, scratch_path(spark, "hours-state"))
    return _ntz(rounded(spark.read.parquet(out), "value"))


STREAM_RESAMPLE_SQL = """
SELECT event_type, date_trunc('hour', ts) AS ts, round(avg(value), 6) AS value FROM events GROUP BY 1, 2
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""


def _tail(spark, d):
    path = scratch_path(spark, "tail")
    stream = _events(spark, d).select("event_id", "ts", F.col("value").alias("actual"))
    query = (
        stream.writeStream.foreachBatch(live_tail(path, tie=["event_id"]))
        .option("checkpointLocation", scratch_path(spark, "tail-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    return _ntz(spark.read.parquet(f"{path}/v{last}"))


def stream_tail(spark, d):
    rolled, _ = live_view(_tail(spark, d))
    return rounded(rolled, "rolling_mean_24")


TAIL_SQL = """
WITH t AS (SELECT event_id, ts, value AS actual FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)
SELECT event_id, ts, actual, round(CASE WHEN count(*) OVER w = 24 THEN avg(actual) OVER w END, 6) AS rolling_mean_24
FROM t WINDOW w AS (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""


def stream_histogram(spark, d):
    _, hist = live_view(_tail(spark, d))
    return longs(hist.select("bin", "count"), "bin", "count")


HIST_SQL = """
WITH t AS (SELECT value AS v FROM events ORDER BY ts DESC, event_id DESC LIMIT 200),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM t),
c AS (SELECT least(CAST(floor((v - lo) / (hi - lo) * 30) AS BIGINT), 29) AS bin, count(*) AS count FROM t, b GROUP BY 1)
SELECT g.bin, coalesce(count, 0) AS count FROM (SELECT unnest(range(30)) AS bin) g LEFT JOIN c USING (bin)"""

def stream_tail_series(spark, d):
    """The last 200 readings of every event type out of stream state, and their rolling means."""
    use_state_store(spark)
    out = scratch_path(spark, "views")
    stream = _events(spark, d).select("event_type", "event_id", "ts", F.col("value").alias("actual"))
    run_available(live_series(stream, keys=["event_type"], tie=["event_id"], salts=4), out, scratch_path(spark, "views-state"))
    tail = _ntz(latest_tail(spark.read.parquet(out), keys=["event_type"], tie=["event_id"]))
    rolled = trailing(tail, "actual", [24], stats=["mean"], include_current=True, keys=["event_type"], layout=Layout("keyed"))
    return rounded(rolled.select("event_type", "event_id", "ts", "actual", "rolling_mean_24"), "rolling_mean_24", shift=OFF_TIES)


TAIL_SERIES_SQL = f"""
WITH t AS (
  SELECT event_type, event_id, ts, value AS actual FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 200)
SELECT *, round(CASE WHEN count(*) OVER w = 24 THEN avg(actual) OVER w END + {OFF_TIES}, 6) AS rolling_mean_24
FROM t WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""


def stream_adaptive(spark, d):
    """Each user's readings against mean plus 2.5 deviations of the readings before."""
    use_state_store(spark)
    out = scratch_path(spark, "status")
    stream = _events(spark, d).select("user_id", "event_id", "ts", "value")
    run_available(adaptive_monitor(stream, keys=["user_id"], value="value", tie=["event_id"]), out, scratch_path(spark, "status-state"))
    told = _ntz(spark.read.parquet(out))
    return rounded(told, "predicted", "threshold", "abs_error", shift=OFF_TIES)


ADAPTIVE_SQL = f"""
WITH m AS (
  SELECT user_id, event_id, ts, value, avg(value) OVER w AS predicted,
    CASE WHEN count(value) OVER w > 1 THEN avg(value) OVER w + 2.5 * stddev_samp(value) OVER w END AS threshold
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id, ts, value, round(predicted + {OFF_TIES}, 6) AS predicted, round(threshold + {OFF_TIES}, 6) AS threshold,
  round(abs(value - predicted) + {OFF_TIES}, 6) AS abs_error, CASE WHEN value > threshold THEN 'HIGH ALERT' ELSE 'Normal' END AS status
FROM m"""

QUERIES = {
    "stream_monitor": (threshold_monitor, MONITOR_SQL),
    "stream_resample": (stream_resample, STREAM_RESAMPLE_SQL),
    "stream_tail": (stream_tail, TAIL_SQL),
    "stream_tail_series": (stream_tail_series, TAIL_SERIES_SQL),
    "stream_adaptive": (stream_adaptive, ADAPTIVE_SQL),
    "stream_histogram": (stream_histogram, HIST_SQL),
}

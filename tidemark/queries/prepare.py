"""Sources, sinks, cleaning, resampling, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import add_calendar, future_times, on_spine
from ..functions.numeric import non_negative
from ..functions.text import model_slug
from ..operators import filters, resample as rs
from ..plans.session import scratch_path
from ..sources.catalog import open_catalogue
from ..sources.readings import coerce_measures, parse_date_time, read_readings, read_table
from ..sources.sinks import export_view, write_result
from .base import (
    HOURLY_SQL, MEAN, MEASURES, MINUTELY_SQL, READINGS_SQL, TOTAL, USER_HOURLY_SQL,
    hourly, longs, minutely, readings, rounded, table, user_hourly,
)


def _raw_text(spark, d):
    """Events as raw text fields: every seventh value missing, every 101st date unreadable."""
    e = readings(spark, d)
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_id") % 101 == 0, F.lit("99/99/2024")).otherwise(F.date_format("ts", "d/M/yyyy")).alias("Date"),
        F.date_format("ts", "HH:mm:ss").alias("Time"),
        F.when(F.col("event_id") % 7 != 0, F.col("power").cast("string")).alias("power"),
        F.when(F.col("event_id") % 11 == 0, F.lit("n/a")).otherwise(F.col("level").cast("string")).alias("level"),
    )


def reading_scan(spark, d):
    path = scratch_path(spark, "readings")
    _raw_text(spark, d).write.option("header", True).option("sep", ";").option("nullValue", "?").csv(path)
    got = read_readings(spark, path, measures=("power", "level"), keys=("event_id",))
    return longs(got, "event_id")


READING_SCAN_SQL = """
SELECT event_id, CASE WHEN event_id % 101 <> 0 THEN date_trunc('second', ts) END AS ts,
       CASE WHEN event_id % 7 <> 0 THEN value END AS power,
       CASE WHEN event_id % 11 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS level
FROM events"""


def date_time_parse(spark, d):
    return longs(parse_date_time(_raw_text(spark, d)).select("event_id", "ts"), "event_id")


DATE_TIME_SQL = """SELECT event_id, CASE WHEN event_id % 101 <> 0 THEN date_trunc('second', ts) END AS ts FROM events"""


def numeric_coercion(spark, d):
    return longs(coerce_measures(_raw_text(spark, d), ["power", "level"]).select("event_id", "power", "level"), "event_id")


NUMERIC_SQL = """
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS power,
       CASE WHEN event_id % 11 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS level
FROM events"""


def table_scan(spark, d):
    path = scratch_path(spark, "hourly")
    write_result(hourly(spark, d).withColumnRenamed("ts", "Datetime"), path, fmt="csv")
    schema = "Datetime timestamp_ntz, power double, level double, sub_click double, sub_view double, sub_purchase double"
    return rounded(read_table(spark, path, schema=schema), *MEASURES)


HOURLY_ROWS_SQL = HOURLY_SQL + """
SELECT ts, round(power, 6) AS power, round(level, 6) AS level, round(sub_click, 6) AS sub_click,
       round(sub_view, 6) AS sub_view, round(sub_purchase, 6) AS sub_purchase FROM hourly"""


def catalogue_counts(spark, d):
    root = scratch_path(spark, "tables")
    write_result(hourly(spark, d), f"{root}/processed_hourly")
    write_result(readings(spark, d), f"{root}/featured_data")
    cat = open_catalogue(spark, root, required=("processed_hourly", "featured_data"), optional=("stl_components",))
    counts = [df.agg(F.count("*").alias("rows")).withColumn("name", F.lit(n)) for n, df in cat.tables.items()]
    return counts[0].unionByName(counts[1])


CATALOGUE_SQL = HOURLY_SQL + """
SELECT count(*) AS rows, 'processed_hourly' AS name FROM hourly
UNION ALL SELECT count(*), 'featured_data' FROM readings"""


def partitioned_sink(spark, d):
    path = scratch_path(spark, "daily")
    write_result(hourly(spark, d).withColumn("day", F.to_date("ts")), path, partition_by=["day"])
    back = spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("rows"), F.sum("power").alias("power"))
    return rounded(back, "power")


SINK_SQL = HOURLY_SQL + """
SELECT CAST(ts AS DATE) AS day, count(*) AS rows, round(sum(power), 6) AS power FROM hourly GROUP BY 1"""


def view_export(spark, d):
    path = scratch_path(spark, "export")
    export_view(hourly(spark, d), path, start="2024-01-10", end="2024-01-12", columns=("ts", "power"))
    return rounded(read_table(spark, path, schema="ts timestamp_ntz, power double"), "power")


DATE_RANGE_SQL = HOURLY_SQL + """
SELECT ts, round(power, 6) AS power FROM hourly
WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'"""


def resample_hourly(spark, d):
    return rounded(hourly(spark, d), *MEASURES)


def resample_minutely(spark, d):
    return rounded(minutely(spark, d), *MEASURES)


def resample_panel(spark, d):
    return rounded(user_hourly(spark, d), *MEASURES)


def resample_quarter_hour(spark, d):
    return rounded(rs.resample(readings(spark, d), "15min", mean=MEAN, total=TOTAL), *MEASURES)


_ROUND_ALL = ", ".join(f"round({m}, 6) AS {m}" for m in MEASURES)


def _with_gaps(spark, d):
    """Scattered nulls, one whole day of nulls, and nulls at both ends."""
    hole = (F.col("event_id") % 7 == 0) | (F.dayofmonth("ts") == 10) | (F.dayofmonth("ts") == 30) | (F.col("event_id") < 5)
    e = readings(spark, d)
    return e.select("event_id", "ts", *[F.when(~hole, F.col(c)).alias(c) for c in ("power", "level")])


def fill_gaps(spark, d):
    return rs.fill_forward_back(_with_gaps(spark, d), ["power", "level"], tie=["event_id"])


_GAPS_SQL = """gaps AS (
  SELECT event_id, ts, CASE WHEN ok THEN value END AS power,
         CASE WHEN ok THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS level
  FROM (SELECT *, NOT (event_id % 7 = 0 OR day(ts) = 10 OR day(ts) = 30 OR event_id < 5) AS ok FROM events))"""
_FILLED = """coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value({c} IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS {c}"""
FILL_SQL = f"WITH {_GAPS_SQL} SELECT event_id, ts, {_FILLED.format(c='power')}, {_FILLED.format(c='level')} FROM gaps"


def preprocess_gaps(spark, d):
    out = rs.preprocess(_with_gaps(spark, d), "h", mean=("power",), total=("level",), tie=["event_id"])
    return rounded(out, "power", "level")


PREPROCESS_SQL = f"""WITH {_GAPS_SQL}, filled AS (
  SELECT event_id, ts, {_FILLED.format(c='power')}, {_FILLED.format(c='level')} FROM gaps)
SELECT date_trunc('hour', ts) AS ts, round(avg(power), 6) AS power, round(sum(level), 6) AS level FROM filled GROUP BY 1"""


def fill_panel(spark, d):
    gaps = _with_gaps(spark, d).join(readings(spark, d).select("event_id", "user_id"), "event_id")
    return rs.fill_forward_back(gaps.select("user_id", "event_id", "ts", "power"), ["power"], ["user_id"], tie=["event_id"])


FILL_PANEL_SQL = f"""WITH {_GAPS_SQL}, g AS (SELECT e.user_id, gaps.* FROM gaps JOIN events e USING (event_id))
SELECT user_id, event_id, ts,
  coalesce(last_value(power IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(power IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS power
FROM g"""


def null_census(spark, d):
    return rounded(filters.null_census(readings(spark, d), MEASURES), "null_pct")


NULL_CENSUS_SQL = f"WITH {READINGS_SQL} " + " UNION ALL ".join(
    f"SELECT '{m}' AS \"column\", count(*) - count({m}) AS nulls, round((count(*) - count({m})) * 100.0 / count(*), 6) AS null_pct FROM readings"
    for m in MEASURES
)


def null_totals(spark, d):
    return rounded(filters.null_totals(readings(spark, d), MEASURES), "mean_null_pct")


NULL_TOTALS_SQL = f"WITH census AS ({NULL_CENSUS_SQL}) " + """
SELECT CAST(sum(nulls) AS BIGINT) AS total_nulls, round(avg(nulls * 100.0 / (SELECT count(*) FROM events)), 6) AS mean_null_pct FROM census"""


def drop_incomplete(spark, d):
    return filters.drop_incomplete(readings(spark, d).select("event_id", "power", "sub_click"))


DROP_SQL = f"WITH {READINGS_SQL} SELECT event_id, power, sub_click FROM readings WHERE sub_click IS NOT NULL AND power IS NOT NULL"


def feature_target_split(spark, d):
    x, y = filters.split_target(hourly(spark, d), "power")
    return rounded(x.join(y, "ts").withColumn("n_features", F.lit(len(x.columns) - 1).cast("long")), *MEASURES)


FEATURE_TARGET_SQL = HOURLY_SQL + f" SELECT ts, {_ROUND_ALL}, CAST(4 AS BIGINT) AS n_features FROM hourly"


def date_range(spark, d):
    return rounded(filters.date_range(hourly(spark, d), "2024-01-10", "2024-01-12").select("ts", "power"), "power")


def default_range(spark, d):
    return filters.default_range(hourly(spark, d))


DEFAULT_RANGE_SQL = HOURLY_SQL + """
SELECT CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day, count(*) AS records FROM hourly"""


def channel_breakdown(spark, d):
    names = {"sub_click": "Kitchen", "sub_view": "Laundry", "sub_purchase": "HVAC/Water Heater"}
    return rounded(filters.channel_breakdown(hourly(spark, d).select("ts", *TOTAL), names), "reading")


CHANNEL_SQL = HOURLY_SQL + """
SELECT ts, 'Kitchen' AS channel, round(sub_click, 6) AS reading FROM hourly
UNION ALL SELECT ts, 'Laundry', round(sub_view, 6) FROM hourly
UNION ALL SELECT ts, 'HVAC/Water Heater', round(sub_purchase, 6) FROM hourly"""


def clip_negative(spark, d):
    e = readings(spark, d)
    return rounded(e.select("event_id", non_negative(F.col("power") - F.lit(20.0)).alias("clipped")), "clipped")


CLIP_SQL = "SELECT event_id, round(greatest(value - 20.0, 0.0), 6) AS clipped FROM events"


def calendar_features(spark, d):
    cal = add_calendar(readings(spark, d).select("event_id", "ts"))
    ints = ("hour", "dayofweek", "month", "quarter", "dayofyear", "weekofyear", "is_weekend")
    return rounded(longs(cal, *ints), "hour_sin", "hour_cos", "month_sin", "month_cos")


CALENDAR_SQL = """
SELECT event_id, ts, hour(ts) AS hour, isodow(ts) - 1 AS dayofweek, month(ts) AS month, quarter(ts) AS quarter,
       dayofyear(ts) AS dayofyear, weekofyear(ts) AS weekofyear, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend,
       round(sin(2 * pi() * hour(ts) / 24.0), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24.0), 6) AS hour_cos,
       round(sin(2 * pi() * month(ts) / 12.0), 6) AS month_sin, round(cos(2 * pi() * month(ts) / 12.0), 6) AS month_cos
FROM events"""


def future_spine(spark, d):
    return longs(future_times(hourly(spark, d), 48), "step")


FUTURE_SQL = HOURLY_SQL + """, steps AS (SELECT unnest(range(1, 49)) AS step)
SELECT step, (SELECT max(ts) FROM hourly) + step * INTERVAL 1 HOUR AS ts FROM steps"""


def hourly_on_spine(spark, d):
    return rounded(on_spine(hourly(spark, d).select("ts", "power")), "power")


SPINE_SQL = HOURLY_SQL + """, spine AS (
  SELECT unnest(generate_series((SELECT min(ts) FROM hourly), (SELECT max(ts) FROM hourly), INTERVAL 1 HOUR)) AS ts)
SELECT spine.ts, round(power, 6) AS power FROM spine LEFT JOIN hourly USING (ts)"""


def model_slugs(spark, d):
    e = table(spark, d, "part")
    return e.select("p_partkey", model_slug(F.col("p_name")).alias("slug"))


SLUG_SQL = "SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS slug FROM part"


def rounding(spark, d):
    e = readings(spark, d)
    return e.select("event_id", F.bround(F.sqrt("power"), 4).alias("root"), F.bround(F.abs(F.col("level") - 50), 2).alias("off"))


ROUNDING_SQL = f"""WITH {READINGS_SQL}
SELECT event_id, round_even(sqrt(power), 4) AS root, round_even(abs(level - 50), 2) AS off FROM readings"""


QUERIES = {
    "reading_scan": (reading_scan, READING_SCAN_SQL),
    "date_time_parse": (date_time_parse, DATE_TIME_SQL),
    "numeric_coercion": (numeric_coercion, NUMERIC_SQL),
    "table_scan": (table_scan, HOURLY_ROWS_SQL),
    "catalogue_counts": (catalogue_counts, CATALOGUE_SQL),
    "partitioned_sink": (partitioned_sink, SINK_SQL),
    "view_export": (view_export, DATE_RANGE_SQL),
    "resample_hourly": (resample_hourly, HOURLY_ROWS_SQL),
    "resample_minutely": (resample_minutely, MINUTELY_SQL + f" SELECT ts, {_ROUND_ALL} FROM minutely"),
    "resample_panel": (resample_panel, USER_HOURLY_SQL + f" SELECT user_id, ts, {_ROUND_ALL} FROM user_hourly"),
    "resample_quarter_hour": (
        resample_quarter_hour,
        f"WITH {READINGS_SQL} SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, round(avg(power), 6) AS power, round(avg(level), 6) AS level, "
        + ", ".join(f"round(coalesce(sum({c}), 0), 6) AS {c}" for c in TOTAL) + " FROM readings GROUP BY 1",
    ),
    "fill_gaps": (fill_gaps, FILL_SQL),
    "fill_panel": (fill_panel, FILL_PANEL_SQL),
    "preprocess": (preprocess_gaps, PREPROCESS_SQL),
    "null_census": (null_census, NULL_CENSUS_SQL),
    "null_totals": (null_totals, NULL_TOTALS_SQL),
    "drop_incomplete": (drop_incomplete, DROP_SQL),
    "feature_target_split": (feature_target_split, FEATURE_TARGET_SQL),
    "date_range": (date_range, DATE_RANGE_SQL),
    "default_range": (default_range, DEFAULT_RANGE_SQL),
    "channel_breakdown": (channel_breakdown, CHANNEL_SQL),
    "clip_negative": (clip_negative, CLIP_SQL),
    "calendar_features": (calendar_features, CALENDAR_SQL),
    "future_times": (future_spine, FUTURE_SQL),
    "time_spine": (hourly_on_spine, SPINE_SQL),
    "model_slugs": (model_slugs, SLUG_SQL),
    "rounding": (rounding, ROUNDING_SQL),
}

"""Driver tables seen as meter readings, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import build_features
from ..operators.resample import resample
from ..plans.positions import DAY, Layout

MEAN = ("power", "level")
TOTAL = ("sub_click", "sub_view", "sub_purchase")
MEASURES = (*MEAN, *TOTAL)

# An hourly series has at most 168 rows a week, at any data size: a proven bound for slices. Chunks are small, so that
# the checked queries cross their edges.
WEEKLY = Layout("sliced", 7 * DAY, chunk_rows=512)
# A minute series has at most 1,440 rows a day.
DAILY = Layout("sliced", DAY, chunk_rows=2_048)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings: two averaged measures and three summed channels."""
    e = table(spark, sf_dir, "events")
    channels = {f"sub_{t}": F.when(F.col("event_type") == t, F.col("value")) for t in ("click", "view", "purchase")}
    return e.select(
        "event_id",
        "ts",
        "user_id",
        F.col("value").alias("power"),
        F.get_json_object("props", "$.k").try_cast("double").alias("level"),
        *[c.alias(n) for n, c in channels.items()],
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(readings(spark, sf_dir), "h", mean=MEAN, total=TOTAL)


def minutely(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(readings(spark, sf_dir), "min", mean=MEAN, total=TOTAL)


def user_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(readings(spark, sf_dir), "h", keys=["user_id"], mean=MEAN, total=TOTAL)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_features(hourly(spark, sf_dir), "power", layout=WEEKLY)


# Means of two-decimal values over 16, 32 or 48 rows can lie exactly between two rounded values.
# Where that happens both sides step off the boundary by this much before they round.
OFF_TIES = 2.3e-8


def rounded(df: DataFrame, *columns: str, digits: int = 6, shift: float = 0.0) -> DataFrame:
    """Round for comparison: summation order differs between engines in the last bits."""
    return df.withColumns({c: F.round(F.col(c) + shift if shift else c, digits) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


READINGS_SQL = """readings AS (
  SELECT event_id, ts, user_id, value AS power,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS level,
         CASE WHEN event_type = 'click' THEN value END AS sub_click,
         CASE WHEN event_type = 'view' THEN value END AS sub_view,
         CASE WHEN event_type = 'purchase' THEN value END AS sub_purchase
  FROM events)"""


def resample_sql(name: str, unit: str, key: str = "") -> str:
    k = f"{key}, " if key else ""
    group = "1, 2" if key else "1"
    return f"""{name} AS (
  SELECT {k}date_trunc('{unit}', ts) AS ts, avg(power) AS power, avg(level) AS level,
         coalesce(sum(sub_click), 0) AS sub_click, coalesce(sum(sub_view), 0) AS sub_view,
         coalesce(sum(sub_purchase), 0) AS sub_purchase
  FROM readings GROUP BY {group} HAVING avg(power) IS NOT NULL AND avg(level) IS NOT NULL)"""


HOURLY_SQL = "WITH " + READINGS_SQL + ", " + resample_sql("hourly", "hour")
MINUTELY_SQL = "WITH " + READINGS_SQL + ", " + resample_sql("minutely", "minute")
USER_HOURLY_SQL = "WITH " + READINGS_SQL + ", " + resample_sql("user_hourly", "hour", "user_id")

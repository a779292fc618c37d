"""Scans: delimited meter readings and tables with a time column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The layout of the raw reading files.
SEPARATOR = ";"
MISSING = "?"
DATE_COLUMN = "Date"
TIME_COLUMN = "Time"
DATE_PATTERN = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$"
TIME_PATTERN = r"^\s*(\d{1,2}):(\d{1,2}):(\d{1,2})\s*$"
MEASURES = (
    "Global_active_power",
    "Global_reactive_power",
    "Voltage",
    "Global_intensity",
    "Sub_metering_1",
    "Sub_metering_2",
    "Sub_metering_3",
)


def read_readings(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    measures: Sequence[str] = MEASURES,
    keys: Sequence[str] = (),
    ts: str = "ts",
) -> DataFrame:
    """Read reading files (a file, folder or glob) into ``keys``, ``ts`` and double measures.

    Everything is scanned as text first, so one malformed field costs only itself. The schema is
    given by the caller: nothing is inferred and unused columns are not parsed.
    """
    fields = [*keys, DATE_COLUMN, TIME_COLUMN, *measures]
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    raw = spark.read.schema(schema).csv(path, sep=SEPARATOR, header=True, nullValue=MISSING, enforceSchema=False)
    return coerce_measures(parse_date_time(raw, ts=ts), measures).select(*keys, ts, *measures)


def parse_date_time(df: DataFrame, *, date: str = DATE_COLUMN, time: str = TIME_COLUMN, ts: str = "ts") -> DataFrame:
    """Combine a date and a time column into ``ts``; unreadable moments become null.

    The moment is built from its parts, so no time zone and no daylight saving touches it.
    """
    day, month, year = (F.regexp_extract(date, DATE_PATTERN, k).try_cast("int") for k in (1, 2, 3))
    hour, minute, second = (F.regexp_extract(time, TIME_PATTERN, k).try_cast("int") for k in (1, 2, 3))
    moment = F.try_make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(16,6)"))
    return df.withColumn(ts, moment).drop(date, time)


def coerce_measures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast columns to double; text that is no number, and NaN, become null."""
    return df.withColumns({c: no_nan(F.col(c).try_cast("double")) for c in columns})


def no_nan(c: Column) -> Column:
    """NaN to null: Spark orders NaN above every number, which would trip thresholds."""
    return F.when(~F.isnan(c), c)


def find_time_column(columns: Sequence[str]) -> str:
    """First column that looks like a time (name contains date or time, or is an unnamed index)."""
    for c in columns:
        low = c.lower()
        if "date" in low or "time" in low or c.strip() in ("Unnamed: 0", "_c0"):
            return c
    return columns[0]


def with_time_column(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rename the discovered time column to ``ts`` and parse it."""
    found = ts if ts in df.columns else find_time_column(df.columns)
    parsed = F.col(found)
    if isinstance(df.schema[found].dataType, T.StringType):
        parsed = parsed.try_cast("timestamp_ntz")
    return df.withColumn(found, parsed).withColumnRenamed(found, ts)


def read_table(spark: SparkSession, path: str, *, schema: T.StructType | None = None, ts: str = "ts") -> DataFrame:
    """Read a Parquet or CSV result table and find its time column.

    CSV types are inferred from the data when no schema is given; pass one for large files.
    """
    if path.rstrip("/").endswith(".parquet"):
        return with_time_column(spark.read.parquet(path), ts)
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return with_time_column(df, ts)

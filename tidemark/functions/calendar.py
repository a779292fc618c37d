"""Calendar columns, labels and time stepping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import null_safe_join

# Label tables, in weekday and channel order.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
SUB_METERS = {"Sub_metering_1": "Kitchen", "Sub_metering_2": "Laundry", "Sub_metering_3": "HVAC/Water Heater"}


def weekday(ts: Column | str) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(ts)


def weekday_label(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), day.cast("int") + 1)


def cyclic(part: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a calendar part on its circle."""
    angle = F.lit(2 * math.pi) * part / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def calendar_columns(ts: str = "ts") -> dict[str, Column]:
    """The eleven calendar features of a time stamp."""
    t = F.col(ts)
    hour_sin, hour_cos = cyclic(F.hour(t), 24)
    month_sin, month_cos = cyclic(F.month(t), 12)
    return {
        "hour": F.hour(t),
        "dayofweek": F.weekday(t),
        "month": F.month(t),
        "quarter": F.quarter(t),
        "dayofyear": F.dayofyear(t),
        "weekofyear": F.weekofyear(t),
        "is_weekend": (F.weekday(t) >= 5).cast("int"),
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        "month_sin": month_sin,
        "month_cos": month_cos,
    }


def add_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(calendar_columns(ts))


def future_times(df: DataFrame, periods: int, *, keys=(), ts: str = "ts", step: str = "1 hour") -> DataFrame:
    """The next ``periods`` time stamps after the last reading of each series, numbered from 1."""
    last = df.groupBy(*keys).agg(F.max(ts).alias("__last"))
    ahead = last.where(F.col("__last").isNotNull()).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    return ahead.select(*keys, "step", (F.col("__last") + F.col("step") * F.expr(f"INTERVAL {step}")).alias(ts))


def time_spine(df: DataFrame, *, keys=(), ts: str = "ts", step: str = "1 hour") -> DataFrame:
    """Every regular time stamp between the first and last reading of each series."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("__a"), F.max(ts).alias("__b"))
    return ends.select(*keys, F.explode(F.sequence("__a", "__b", F.expr(f"INTERVAL {step}"))).alias(ts))


def on_spine(df: DataFrame, *, keys=(), ts: str = "ts", step: str = "1 hour") -> DataFrame:
    """Left-join a regular series to its spine, so missing steps appear as null rows."""
    return null_safe_join(time_spine(df, keys=keys, ts=ts, step=step), df, [*keys, ts])

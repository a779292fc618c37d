"""Cleaning and resampling."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import null_safe_join
from ..plans.positions import Layout, fill_forward_back
from ..sources.readings import DATE_COLUMN, MEASURES, TIME_COLUMN, coerce_measures, parse_date_time

# Measures averaged and measures summed when readings are resampled.
AVERAGED = MEASURES[:4]
SUMMED = MEASURES[4:]

_UNITS = {"s": "second", "min": "minute", "h": "hour", "d": "day"}


def interval_of(freq: str) -> str:
    """Frequency alias (``h``, ``15min``, ``D``) as a Spark interval."""
    found = re.fullmatch(r"(\d*)\s*(s|min|h|d)", freq.strip().lower())
    if not found:
        raise ValueError(f"unknown frequency {freq!r}")
    return f"{found[1] or 1} {_UNITS[found[2]]}"


def resample(
    df: DataFrame,
    freq: str = "h",
    *,
    keys: Sequence[str] = (),
    ts: str = "ts",
    mean: Sequence[str] = AVERAGED,
    total: Sequence[str] = SUMMED,
) -> DataFrame:
    """Aggregate readings to regular bins; bins without a value for every averaged measure are dropped.

    A summed measure without readings is zero, an averaged one is null. Empty bins would be dropped
    anyway, so no calendar is built. Each task pre-aggregates, so a hot key costs one row per bin.
    """
    bin_ = F.window(ts, interval_of(freq))["start"]
    aggs = [F.avg(c).alias(c) for c in mean] + [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in total]
    binned = df.where(F.col(ts).isNotNull()).groupBy(*keys, bin_.alias(ts)).agg(*aggs)
    return binned.na.drop("any", subset=list(mean)) if mean else binned


def preprocess(
    raw: DataFrame,
    freq: str = "h",
    *,
    keys: Sequence[str] = (),
    ts: str = "ts",
    mean: Sequence[str] = AVERAGED,
    total: Sequence[str] = SUMMED,
    tie: Sequence[str] = (),
    layout: Layout | None = None,
) -> DataFrame:
    """Parse, coerce, fill forward then back, resample."""
    if {DATE_COLUMN, TIME_COLUMN} <= set(raw.columns):
        raw = parse_date_time(raw, ts=ts)
    measures = [*mean, *total]
    clean = coerce_measures(raw, measures).select(*keys, ts, *tie, *measures)
    filled = fill_forward_back(clean, measures, keys, ts, tie=tie, layout=layout)
    return resample(filled, freq, keys=keys, ts=ts, mean=mean, total=total)


def monthly_mean(df: DataFrame, value: str, *, keys: Sequence[str] = (), ts: str = "ts", spine: bool = False) -> DataFrame:
    """Mean per month under the month's last day; ``spine`` adds months without rows as null."""
    monthly = df.groupBy(*keys, F.last_day(ts).alias("month_end")).agg(F.avg(value).alias("mean"))
    if not spine:
        return monthly
    ends = monthly.groupBy(*keys).agg(F.min("month_end").alias("a"), F.max("month_end").alias("b"))
    steps = F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("INTERVAL 1 MONTH"))
    months = ends.withColumn("m", F.explode(steps)).select(*keys, F.last_day("m").alias("month_end"))
    return null_safe_join(months, monthly, [*keys, "month_end"])

"""Statistical detectors and the combined anomaly table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import weekday, weekday_label
from ..plans.joins import null_safe_join, with_group_stats
from ..plans.positions import Frames, Layout, apply_windows
from .alerts import severity_columns
from .rolling import centred_bounds, full_frame

METHODS = ("zscore", "rolling", "iforest")


def detect_zscore(df: DataFrame, value: str, *, threshold: float = 3.0, keys: Sequence[str] = (), flag: str = "zscore") -> DataFrame:
    """Flag values more than ``threshold`` population deviations from the mean of their series."""
    stats = with_group_stats(df, keys, {"__mu": F.avg(value), "__sd": F.stddev_pop(value)})
    far = F.abs(F.try_divide(F.col(value) - F.col("__mu"), F.col("__sd"))) > threshold
    return stats.withColumn(flag, F.coalesce(far, F.lit(False))).drop("__mu", "__sd")


def rolling_flag(f: Frames, value: str, window: int, n_std: float) -> Column:
    spec = f.rows(*centred_bounds(window))
    mean = full_frame(value, spec, "mean", window)
    band = n_std * full_frame(value, spec, "std", window)
    outside = (F.col(value) > mean + band) | (F.col(value) < mean - band)
    return F.coalesce(outside, F.lit(False))


def detect_rolling(
    df: DataFrame,
    value: str,
    *,
    window: int = 24,
    n_std: float = 3.0,
    keys: Sequence[str] = (),
    ts: str = "ts",
    layout: Layout | None = None,
    flag: str = "rolling",
) -> DataFrame:
    """Flag values outside the centred rolling mean ± ``n_std`` deviations; edges are not flagged."""
    lo, hi = centred_bounds(window)
    return apply_windows(
        df, lambda f: {flag: rolling_flag(f, value, window, n_std)}, before=-lo, after=hi, keys=keys, ts=ts, layout=layout
    )


def align_flags(df: DataFrame, flags: DataFrame, flag: str, *, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Bring flags of a subset of rows back to all rows, false elsewhere."""
    on = [*keys, ts]
    joined = null_safe_join(df, flags.select(*on, flag), on)
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))


def combined_anomalies(
    df: DataFrame,
    value: str,
    *,
    iforest: DataFrame | None = None,
    window: int = 24,
    threshold: float = 3.0,
    n_std: float = 3.0,
    keys: Sequence[str] = (),
    ts: str = "ts",
    layout: Layout | None = None,
) -> DataFrame:
    """All detectors and the severity of every row.

    The rolling flag and the severity share one ordered pass. ``iforest`` is a table with an
    ``iforest`` flag per ``keys`` and ``ts``.
    """
    lo, hi = centred_bounds(window)
    base = df.select(*keys, ts, F.col(value).alias("value"))

    def build(f: Frames) -> dict[str, Column]:
        spec = f.rows(lo, hi)
        return {
            "rolling": rolling_flag(f, "value", window, n_std),
            "roll_mean": F.avg("value").over(spec),
            "roll_std": F.coalesce(F.stddev_samp("value").over(spec), F.lit(1.0)),
        }

    marked = apply_windows(base, build, before=-lo, after=hi, keys=keys, ts=ts, layout=layout)
    marked = severity_columns(detect_zscore(marked, "value", threshold=threshold, keys=keys))
    out = [*keys, ts, "value", "zscore", "rolling", "severity", "z_score"]
    if iforest is not None:
        marked = align_flags(marked, iforest, "iforest", keys=keys, ts=ts)
        out.insert(out.index("severity"), "iforest")
    return marked.select(*out)


def anomaly_summary(df: DataFrame, flag: str, *, keys: Sequence[str] = (), deviation: str = "z_score") -> DataFrame:
    """Points, anomalies, rate in percent, and mean deviation of the anomalies."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("points"),
        F.count_if(flag).alias("anomalies"),
        (F.avg(F.col(flag).cast("int")) * 100).alias("rate_pct"),
        F.avg(F.when(F.col(flag), F.col(deviation))).alias("mean_deviation"),
    )


def anomalies_by_hour(df: DataFrame, flag: str, *, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    return df.where(flag).groupBy(*keys, F.hour(ts).alias("hour")).agg(F.count("*").alias("count")).orderBy(*keys, "hour")


def anomalies_by_weekday(df: DataFrame, flag: str, *, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    days = df.where(flag).groupBy(*keys, weekday(ts).alias("dayofweek")).agg(F.count("*").alias("count"))
    return days.withColumn("day", weekday_label(F.col("dayofweek"))).orderBy(*keys, "dayofweek")


def detector_comparison(df: DataFrame, methods: Sequence[str] = METHODS, *, keys: Sequence[str] = ()) -> DataFrame:
    """Count and rate of every detector the table has, from one pass."""
    present = [m for m in methods if m in df.columns]
    one = df.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.count_if(m).alias(m) for m in present])
    long = one.unpivot([*keys, "__n"], present, "method", "anomalies")
    return long.select(*keys, "method", "anomalies", F.round(F.try_divide(F.col("anomalies") * 100.0, "__n"), 3).alias("rate_pct"))

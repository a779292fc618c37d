"""Exploratory aggregates: profiles, description, correlation, distribution."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import weekday, weekday_label
from ..plans.joins import null_safe_join, with_group_stats
from ..plans.quantiles import exact_quantiles


def hour_profile(df: DataFrame, value: str, *, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys, F.hour(ts).alias("hour")).agg(F.avg(value).alias("mean"))


def weekday_profile(df: DataFrame, value: str, *, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    days = df.groupBy(*keys, weekday(ts).alias("dayofweek")).agg(F.avg(value).alias("mean"))
    return days.withColumn("day", weekday_label(F.col("dayofweek")))


def hour_weekday_pivot(df: DataFrame, value: str, *, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Weekday rows, hour columns ``h0`` to ``h23``, mean values."""
    cells = df.groupBy(*keys, weekday(ts).alias("dayofweek"))
    means = [F.avg(F.when(F.hour(ts) == h, F.col(value))).alias(f"h{h}") for h in range(24)]
    return cells.agg(*means).withColumn("day", weekday_label(F.col("dayofweek")))


def describe(
    df: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = (), digits: int = 3, approximate: bool = False
) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, rounded: one row per column (and series).

    Quartiles are exact unless ``approximate``; exact ones take a few more scans, never a sort.
    """
    probs = (0.25, 0.5, 0.75)
    by = [*keys, "column"]
    long = df.select(*keys, *columns).unpivot(list(keys), list(columns), "column", "v")
    stats = long.groupBy(*by).agg(
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        *([F.percentile_approx("v", list(probs), 100_000).alias("__q")] if approximate else []),
    )
    if approximate:
        out = stats.withColumns({f"q{int(p * 100)}": F.col("__q")[i] for i, p in enumerate(probs)})
    else:
        q = exact_quantiles(long, "v", probs, by)
        wide = q.groupBy(*by).agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"q{int(p * 100)}") for p in probs])
        out = null_safe_join(stats, wide, by)
    numbers = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    return out.select(*by, "count", *[F.round(c, digits).alias(c) for c in numbers])


def correlations(df: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every pair in long form: ``a``, ``b``, ``r``, from one aggregate.

    Each pair uses the rows where both are present.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def corr(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return F.corr(F.when(both, F.col(a)), F.when(both, F.col(b)))

    one = df.groupBy(*keys).agg(*[corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    index = {frozenset(p): i for i, p in enumerate(pairs)}
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{index[frozenset((a, b))]}").alias("r"))
        for a, b in product(columns, columns)
    ]
    return one.select(*keys, F.explode(F.array(*cells)).alias("cell")).select(*keys, "cell.*")


def histogram(df: DataFrame, value: str, bins: int, *, keys: Sequence[str] = ()) -> DataFrame:
    """Exactly ``bins`` equal-width bins per series, empty ones included; the last bin is closed."""
    v = F.col(value).cast("double")
    present = df.where(v.isNotNull()).select(*keys, v.alias("__v"))
    ranged = with_group_stats(present, keys, {"__lo": F.min("__v"), "__hi": F.max("__v")})
    share = F.try_divide(F.col("__v") - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    # A constant series is spread over one unit around its value, so it falls in the middle bin.
    at = F.coalesce(F.floor(share * bins), F.lit(bins // 2))
    counted = (
        ranged.withColumn("bin", F.least(at, F.lit(bins - 1)).cast("int"))
        .groupBy(*keys, "bin")
        .agg(F.count("*").alias("count"))
    )
    ends = present.groupBy(*keys).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    ends = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    ends = ends.where(F.col("lo").isNotNull())
    pad = F.when(F.col("lo") == F.col("hi"), F.lit(0.5)).otherwise(F.lit(0.0))
    ends = ends.withColumns({"lo": F.col("lo") - pad, "hi": F.col("hi") + pad})
    width = (F.col("hi") - F.col("lo")) / bins
    full = null_safe_join(ends, counted, [*keys, "bin"])
    return full.select(
        *keys,
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("left"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("right"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def box_by_weekday(
    df: DataFrame, value: str, *, keys: Sequence[str] = (), ts: str = "ts", reach: float = 1.5
) -> DataFrame:
    """Quartiles per weekday, whiskers at the last values within ``reach`` quartile ranges, outliers."""
    by = [*keys, "dayofweek"]
    days = df.where(F.col(value).isNotNull()).select(*keys, weekday(ts).alias("dayofweek"), F.col(value).alias("v"))
    q = exact_quantiles(days, "v", (0.25, 0.5, 0.75), by)
    wide = q.groupBy(*by).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    joined = null_safe_join(days, wide, by)
    span = (F.col("q3") - F.col("q1")) * reach
    inside = F.col("v").between(F.col("q1") - span, F.col("q3") + span)
    boxes = joined.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
    return boxes.withColumn("day", weekday_label(F.col("dayofweek")))


def kpi_cards(df: DataFrame, value: str, *, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.max(value).alias("peak"),
        F.min(value).alias("low"),
        F.stddev_samp(value).alias("std"),
        F.sum(value).alias("total"),
        F.count("*").alias("records"),
    )


def forecast_summary(df: DataFrame, value: str = "forecast", *, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.max(value).alias("peak"), F.sum(value).alias("total"))


def alert_threshold(df: DataFrame, value: str, *, keys: Sequence[str] = (), n_std: float = 2.5) -> DataFrame:
    """Mean plus ``n_std`` sample deviations."""
    return df.groupBy(*keys).agg((F.avg(value) + n_std * F.stddev_samp(value)).alias("threshold"))

"""Chronological split, look-back windows and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import with_group_stats
from ..plans.positions import Frames, Layout, add_positions, apply_windows


def mark_split(
    df: DataFrame, *, test_ratio: float = 0.2, keys: Sequence[str] = (), ts: str = "ts", layout: Layout | None = None
) -> DataFrame:
    """Add ``is_train``: true for the first ``int(n * (1 - test_ratio))`` rows of each series."""
    placed = add_positions(df, keys, ts, layout=layout, position="__rn", total="__n")
    cut = F.floor(F.col("__n") * F.lit(1 - test_ratio))
    return placed.withColumn("is_train", F.col("__rn") < cut).drop("__rn", "__n")


def split_chronological(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    marked = mark_split(df, **options)
    return marked.where("is_train").drop("is_train"), marked.where("NOT is_train").drop("is_train")


def split_report(marked: DataFrame, *, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Rows and period on either side of a split."""
    return marked.groupBy(*keys, "is_train").agg(
        F.count("*").alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )


def look_back_windows(
    df: DataFrame,
    value: str,
    *,
    look_back: int = 48,
    horizon: int | None = None,
    keys: Sequence[str] = (),
    ts: str = "ts",
    layout: Layout | None = None,
) -> DataFrame:
    """``x``: the ``look_back`` values before each row; ``y``: its value, or the next ``horizon`` ones.

    Rows without a full window are left out.
    """

    def build(f: Frames) -> dict[str, Column]:
        cols = {"x": F.collect_list(value).over(f.rows(-look_back, -1))}
        cols["y"] = F.col(value) if horizon is None else F.collect_list(value).over(f.rows(0, horizon - 1))
        return cols

    ahead = 0 if horizon is None else horizon - 1
    built = apply_windows(
        df.select(*keys, ts, value).where(F.col(value).isNotNull()),
        build,
        before=look_back,
        after=ahead,
        keys=keys,
        ts=ts,
        layout=layout,
    )
    full = F.size("x") == look_back
    if horizon is not None:
        full &= F.size("y") == horizon
    return built.where(full).select(*keys, ts, "x", "y")


def min_max_bounds(df: DataFrame, value: str, *, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def scale(c: Column, lo: Column, hi: Column) -> Column:
    """Map [lo, hi] to [0, 1]; a constant series maps to 0."""
    span = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
    return (c - lo) / span


def unscale(c: Column, lo: Column, hi: Column) -> Column:
    span = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
    return c * span + lo


def scale_column(
    df: DataFrame,
    value: str,
    *,
    keys: Sequence[str] = (),
    fit_on: str = "all",
    name: str = "scaled",
) -> DataFrame:
    """Min-max scale per series and keep the bounds ``lo`` and ``hi`` for the inverse.

    ``fit_on="train"`` takes the bounds from rows with ``is_train`` only.
    """
    seen = F.when(F.col("is_train"), F.col(value)) if fit_on == "train" else F.col(value)
    bounded = with_group_stats(df, keys, {"lo": F.min(seen), "hi": F.max(seen)})
    return bounded.withColumn(name, scale(F.col(value), F.col("lo"), F.col("hi")))

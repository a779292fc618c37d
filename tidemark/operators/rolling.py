"""Window operators over rows in time order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..plans.positions import Frames, Layout, add_positions, apply_windows, running_sums

STATS = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}


def full_frame(value: str, spec: WindowSpec, stat: str, rows: int) -> Column:
    """A statistic that is null until the frame holds ``rows`` values."""
    return F.when(F.count(value).over(spec) == rows, STATS[stat](value).over(spec))


def lags(df: DataFrame, value: str, steps: Sequence[int], *, keys=(), ts: str = "ts", layout: Layout | None = None) -> DataFrame:
    """``lag_k`` columns: the value ``k`` rows earlier."""
    return apply_windows(
        df,
        lambda f: {f"lag_{k}": F.lag(value, k).over(f.order) for k in steps},
        before=max(steps),
        keys=keys,
        ts=ts,
        layout=layout,
    )


def trailing(
    df: DataFrame,
    value: str,
    windows: Sequence[int],
    *,
    stats: Sequence[str] = ("mean", "std", "max", "min"),
    include_current: bool = False,
    keys=(),
    ts: str = "ts",
    layout: Layout | None = None,
) -> DataFrame:
    """``rolling_<stat>_<w>`` over the ``w`` rows before (or up to) each row; full windows only."""
    shift = 0 if include_current else 1

    def build(f: Frames) -> dict[str, Column]:
        return {
            f"rolling_{s}_{w}": full_frame(value, f.rows(-w + 1 - shift, -shift), s, w) for w in windows for s in stats
        }

    return apply_windows(df, build, before=max(windows), keys=keys, ts=ts, layout=layout)


def centred_bounds(window: int) -> tuple[int, int]:
    """Rows of a centred frame; an even one reaches one row further back than ahead."""
    return -(window // 2), (window - 1) // 2


def centred(
    df: DataFrame,
    value: str,
    window: int = 24,
    *,
    partial_edges: bool = False,
    keys=(),
    ts: str = "ts",
    layout: Layout | None = None,
) -> DataFrame:
    """Centred ``roll_mean`` and ``roll_std``.

    Without ``partial_edges`` only full frames count. With it every frame does, and a frame with
    fewer than two values has deviation 1.
    """
    lo, hi = centred_bounds(window)

    def build(f: Frames) -> dict[str, Column]:
        spec = f.rows(lo, hi)
        if partial_edges:
            return {
                "roll_mean": F.avg(value).over(spec),
                "roll_std": F.coalesce(F.stddev_samp(value).over(spec), F.lit(1.0)),
            }
        return {
            "roll_mean": full_frame(value, spec, "mean", window),
            "roll_std": full_frame(value, spec, "std", window),
        }

    return apply_windows(df, build, before=-lo, after=hi, keys=keys, ts=ts, layout=layout)


def difference(
    df: DataFrame,
    value: str,
    *,
    seasonal: int = 24,
    keys=(),
    ts: str = "ts",
    layout: Layout | None = None,
    name: str = "diff",
) -> DataFrame:
    """First difference of the seasonal difference; ``seasonal=0`` gives the first difference only."""

    def build(f: Frames) -> dict[str, Column]:
        step = F.col(value) - F.lag(value, 1).over(f.order)
        if seasonal:
            step = step - (F.lag(value, seasonal).over(f.order) - F.lag(value, seasonal + 1).over(f.order))
        return {name: step}

    return apply_windows(df, build, before=seasonal + 1, keys=keys, ts=ts, layout=layout)


def undifference(
    df: DataFrame,
    diff: str,
    start: str,
    *,
    keys=(),
    ts: str = "ts",
    layout: Layout | None = None,
    name: str = "level",
) -> DataFrame:
    """Level from first differences: the anchor in ``start`` (constant per series) plus the running sum."""
    summed = running_sums(df, {"__run": F.col(diff)}, keys, ts, layout=layout)
    return summed.withColumn(name, F.col(start) + F.col("__run")).drop("__run")


def positions(df: DataFrame, *, keys=(), ts: str = "ts", layout: Layout | None = None, total: str | None = "n") -> DataFrame:
    """Zero-based row position ``rn`` and series length ``n``."""
    return add_positions(df, keys, ts, layout=layout, total=total)

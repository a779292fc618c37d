"""Feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns
from ..plans.joins import null_safe_join
from ..plans.positions import Frames, Layout, apply_windows
from .rolling import full_frame

# Lag steps and trailing window lengths, in rows.
LAGS = (1, 2, 3, 6, 12, 24, 48)
WINDOWS = (6, 12, 24, 48)
COMPONENTS = ("trend", "seasonal", "residual")


def lag_rolling_columns(f: Frames, target: str) -> dict[str, Column]:
    cols = {f"lag_{k}": F.lag(target, k).over(f.order) for k in LAGS}
    for w in WINDOWS:
        spec = f.rows(-w, -1)
        for stat in ("mean", "std", "max", "min"):
            cols[f"rolling_{stat}_{w}"] = full_frame(target, spec, stat, w)
    return cols


def build_features(
    df: DataFrame, target: str, *, keys: Sequence[str] = (), ts: str = "ts", layout: Layout | None = None
) -> DataFrame:
    """Calendar, lag and rolling columns from one ordered pass; rows without full history are dropped."""
    windowed = apply_windows(
        df, lambda f: lag_rolling_columns(f, target), before=max(*LAGS, *WINDOWS), keys=keys, ts=ts, layout=layout
    )
    derived = calendar_columns(ts)
    history = [c for c in windowed.columns if c not in df.columns]
    out = windowed.select(*df.columns, *[c.alias(n) for n, c in derived.items()], *history)
    return out.na.drop("any", subset=[c for c in out.columns if c not in keys])  # a null key is a key


def add_components(
    features: DataFrame, components: DataFrame, *, keys: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """Left-join trend, seasonal and residual by time and drop incomplete rows.

    The three sum to the target, so models trained on them see the answer. Kept as an explicit
    choice; leave it out for an honest comparison.
    """
    right = components.select(*keys, ts, *COMPONENTS)
    out = null_safe_join(features, right, [*keys, ts])
    return out.na.drop("any", subset=[c for c in out.columns if c not in keys])


def feature_columns(df: DataFrame, target: str, *, ids: Sequence[str] = ("ts",)) -> list[str]:
    return [c for c in df.columns if c != target and c not in ids]

"""Seasonal decomposition of regular series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import null_safe_join
from ..plans.positions import Frames, Layout, add_positions, apply_windows, halo_chunks, resolve
from ..plans.quantiles import exact_quantiles
from ..plans.session import materialize
from ..sources.readings import no_nan


def classical(
    df: DataFrame, value: str, *, period: int = 24, keys: Sequence[str] = (), ts: str = "ts", layout: Layout | None = None
) -> DataFrame:
    """Additive decomposition: centred moving average, mean seasonal profile, remainder.

    Trend and residual are null for half a period at both ends.
    """
    base = df.select(*keys, ts, F.col(value).alias("observed"))
    half = period // 2

    def build(f: Frames) -> dict[str, Column]:
        if period % 2:
            spec = f.rows(-half, half)
            return {"trend": F.when(F.count("observed").over(spec) == period, F.avg("observed").over(spec))}
        early, late = f.rows(-half, half - 1), f.rows(-half + 1, half)
        full = (F.count("observed").over(early) == period) & (F.count("observed").over(late) == period)
        return {"trend": F.when(full, (F.avg("observed").over(early) + F.avg("observed").over(late)) / 2)}

    trended = apply_windows(base, build, before=half, after=half, keys=keys, ts=ts, layout=layout, keep_position=True)
    phased = trended.withColumn("__phase", F.col("rn") % period)
    profile = phased.groupBy(*keys, "__phase").agg(F.avg(F.col("observed") - F.col("trend")).alias("__raw"))
    # The profile has `period` rows per series.
    if keys:
        centre = profile.groupBy(*keys).agg(F.avg("__raw").alias("__centre"))
        profile = null_safe_join(profile, centre, keys)
    else:
        profile = profile.withColumn("__centre", profile.agg(F.avg("__raw").alias("c")).scalar())
    profile = profile.select(*keys, "__phase", (F.col("__raw") - F.col("__centre")).alias("seasonal"))
    joined = null_safe_join(phased, profile, [*keys, "__phase"])
    rest = F.col("observed") - F.col("trend") - F.col("seasonal")
    return joined.select(*keys, ts, "observed", "trend", "seasonal", rest.alias("residual"))


def _odd_above(x: float) -> int:
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


def smooth(y: np.ndarray, weight: np.ndarray, q: int, span: int, at: np.ndarray | None = None) -> np.ndarray:
    """Local linear fit with tricube weights over the ``q`` nearest points (Cleveland 1979).

    ``span`` is the length of the whole series minus one: below a thousandth of it the fit stays
    level, as in the published procedure.
    """
    n = len(y)
    m = min(q, n)
    x = np.arange(n, dtype=float) if at is None else np.asarray(at, dtype=float)
    left = np.clip(x - (q - 1) // 2, 0, n - m).astype(int)
    idx = left[:, None] + np.arange(m)
    reach = np.maximum(x - left, left + m - 1 - x) + max(q - n, 0) // 2
    dist = np.abs(idx - x[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        w = (1 - (dist / reach[:, None]) ** 3) ** 3
        w = np.where(dist <= 0.001 * reach[:, None], 1.0, w)
        w = np.where(dist > 0.999 * reach[:, None], 0.0, w) * weight[idx]
        total = w.sum(axis=1)
        w = w / total[:, None]
        mean = (w * idx).sum(axis=1)
        off = idx - mean[:, None]
        var = (w * off**2).sum(axis=1)
        slope = np.where(np.sqrt(var) > 0.001 * span, (x - mean) / var, 0.0)
        fit = (w * (1 + slope[:, None] * off) * y[idx]).sum(axis=1)
    known = np.flatnonzero(weight > 0)
    if not len(known):
        return np.zeros(len(x))
    if np.all(total > 0):
        return fit
    # no weight within reach: the nearest value that has any
    after = np.clip(np.searchsorted(known, x), 0, len(known) - 1)
    before = np.maximum(after - 1, 0)
    nearest = np.where(np.abs(known[before] - x) <= np.abs(known[after] - x), known[before], known[after])
    return np.where(total > 0, fit, y[nearest])


def _moving(x: np.ndarray, k: int) -> np.ndarray:
    return np.convolve(x, np.full(k, 1.0 / k), mode="valid")


def _inner(y, trend, weight, start, total, period, q_seasonal, q_low, q_trend, rounds):
    """Inner rounds of the procedure on consecutive rows ``start``.. of a series of ``total`` rows."""
    n = len(y)
    seasonal = np.zeros(n)
    for _ in range(rounds):
        wide = np.empty(n + 2 * period)
        detrended = y - trend
        for k in range(period):
            sub, w = detrended[k::period], weight[k::period]
            if len(sub) == 0:
                wide[k::period] = 0.0
                continue
            span = (total - 1 - (start + k) % period) // period
            ends = smooth(sub, w, q_seasonal, span, at=np.array([-1, len(sub)]))
            wide[k::period] = np.concatenate([ends[:1], smooth(sub, w, q_seasonal, span), ends[1:]])
        low = smooth(_moving(_moving(_moving(wide, period), period), 3), np.ones(n), q_low, total - 1)
        seasonal = wide[period : period + n] - low
        trend = smooth(y - seasonal, weight, q_trend, total - 1)
    return seasonal, trend


def stl(
    df: DataFrame,
    value: str,
    *,
    period: int = 24,
    keys: Sequence[str] = (),
    ts: str = "ts",
    layout: Layout | None = None,
    seasonal: int = 7,
    robust: bool = True,
    inner: int | None = None,
    outer: int | None = None,
) -> DataFrame:
    """Seasonal-trend decomposition by LOESS (Cleveland et al. 1990).

    Every smoother looks only so many rows to either side. Chunks that carry that many neighbours
    are therefore smoothed independently and agree with one pass over the whole series. The
    robustness weights need the median residual of the series, an exact distributed quantile per
    outer round. Each round is written to the shared folder, so lineage does not grow.

    Missing values have no weight: their trend and seasonal come from their neighbours, their residual is null.
    """
    inner = inner if inner is not None else (2 if robust else 5)
    outer = outer if outer is not None else (15 if robust else 0)
    q_trend = _odd_above(1.5 * period / (1 - 1.5 / seasonal))
    q_low = period + 1 if period % 2 == 0 else period + 2
    reach = inner * (period * (seasonal // 2 + 2) + q_low // 2 + q_trend // 2 + 2)
    layout = resolve(df, keys, ts, layout)

    base = add_positions(df.select(*keys, ts, no_nan(F.col(value).cast("double")).alias("observed")), keys, ts, layout=layout, total="n")
    state = base.withColumns({"seasonal": F.lit(0.0), "trend": F.lit(0.0), "weight": F.lit(1.0)})
    fields = [f for f in state.schema.fields]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields if f.name not in ("weight",)])
    names = schema.names

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        there = pdf["observed"].notna().to_numpy()
        s, t = _inner(
            pdf["observed"].fillna(0.0).to_numpy(), pdf["trend"].to_numpy(), np.where(there, pdf["weight"].to_numpy(), 0.0),
            int(pdf["rn"].iloc[0]), int(pdf["n"].iloc[0]), period, seasonal, q_low, q_trend, inner,
        )
        return pdf.assign(seasonal=s, trend=t).loc[pdf["__own"], names]

    for k in range(outer + 1):
        chunks = halo_chunks(state, before=reach, after=reach, chunk_rows=layout.chunk_rows)
        fitted = chunks.where(_has_own_rows(layout.chunk_rows, reach)).groupBy(*keys, "__chunk").applyInPandas(fit, schema)
        fitted = materialize(fitted, "stl")
        if k == outer:
            break
        off = F.abs(F.col("observed") - F.col("trend") - F.col("seasonal"))
        medians = exact_quantiles(fitted.withColumn("__off", off).where("__off IS NOT NULL"), "__off", [0.5], keys)
        bound = medians.select(*keys, (6 * F.col("quantile")).alias("__h"))
        with_bound = null_safe_join(fitted, bound, keys) if keys else fitted.withColumn("__h", bound.select("__h").scalar())
        bisquare = F.pow(1 - F.pow(F.try_divide(off, F.col("__h")), 2), 2)
        weight = F.when(off <= 0.001 * F.col("__h"), 1.0).when(off <= 0.999 * F.col("__h"), bisquare).otherwise(0.0)
        state = with_bound.withColumn("weight", weight).drop("__h")
    rest = F.col("observed") - F.col("trend") - F.col("seasonal")
    return fitted.select(*keys, ts, "observed", "trend", "seasonal", rest.alias("residual"))


def _has_own_rows(chunk_rows: int, reach: int) -> Column:
    """Drop copies sent to chunks that lie wholly behind the end of the series."""
    size = max(chunk_rows, 2 * reach, 1)
    return F.col("__chunk") * size < F.col("n")

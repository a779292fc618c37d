"""Stationarity test, seasonal ARIMA by least squares, and walk-forward refits."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import non_negative
from ..plans.joins import null_safe_join, with_group_stats
from ..plans.positions import Frames, Layout, add_positions, apply_windows, halo_chunks, resolve, running_sums
from ..plans.recurrence import linear_recurrence
from ..plans.session import materialize
from .filters import last_rows
from .linear import gram, solve, unpack
from .split import mark_split

# Response surface for the test with a constant (MacKinnon 1994).
ADF_TAU_STAR = -1.61
ADF_TAU_MIN = -18.83
ADF_TAU_MAX = 2.74
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)

# The long autoregression of the first stage, and the final regressors.
LONG_LAGS = (1, 2, 3, 4, 5, 6, 24, 25, 26, 27, 28, 29, 30)
FINAL_LAGS = (1, 24, 25)
SEASON = 24


def adf_p_value(tau: float) -> float:
    if tau > ADF_TAU_MAX:
        return 1.0
    if tau < ADF_TAU_MIN:
        return 0.0
    coefs = ADF_SMALL_P if tau <= ADF_TAU_STAR else ADF_LARGE_P
    z = sum(c * tau**k for k, c in enumerate(coefs))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _keyed_rows(pdf_fn, keys: Sequence[str], df: DataFrame, schema: T.StructType) -> DataFrame:
    """Apply a small solver to a table with one row per series."""
    if keys:
        return df.groupBy(*keys).applyInPandas(pdf_fn, schema)
    return df.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(pdf_fn, schema)


def _key_schema(df: DataFrame, keys: Sequence[str], extra: str) -> T.StructType:
    out = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys])
    for f in T._parse_datatype_string(extra).fields:
        out = out.add(f)
    return out


def _lag_sums(y: np.ndarray, first: int, max_lag: int) -> np.ndarray:
    """Sums over the rows from ``first`` on: of d[t] d[t-j], y[t-1] d[t-j] and d[t-j] for j up to ``max_lag``, of y[t-1] and its square."""
    d = np.diff(y, prepend=np.nan)
    now, before, end = d[first:], y[first - 1 : -1], len(y)
    lagged = [d[first - j : end - j] for j in range(max_lag + 1)]
    return np.array([*(now @ x for x in lagged), *(before @ x for x in lagged), *(x.sum() for x in lagged), before.sum(), before @ before])


def _lag_gram(sums: np.ndarray, head: np.ndarray, tail: np.ndarray, max_lag: int, rows: int) -> np.ndarray:
    """Cross products of 1, y[t-1], d[t-1] to d[t-max_lag], d[t] over the last ``rows`` rows.

    A product of two lagged differences is that of the two differences a row later but for one row at either
    end, so the first row of the matrix and the differences at both ends (``head`` from the second value on,
    ``tail`` from the last one back) give all others.
    """
    p = max_lag
    products, levels, plain = sums[: p + 1], sums[p + 1 : 2 * p + 2], sums[2 * p + 2 : 3 * p + 3]
    g = np.zeros((p + 1, p + 1))
    g[0] = products
    for i in range(p):  # d[p-i] d[p-j] enters, d[n-1-i] d[n-1-j] leaves
        j = np.arange(i, p)
        g[i + 1, i + 1 :] = g[i, i:p] + head[p - 1 - i] * head[p - 1 - j] - tail[i] * tail[j]
    g = np.triu(g) + np.triu(g, 1).T
    order = np.r_[1 : p + 1, 0]
    m = np.zeros((p + 3, p + 3))
    m[2:, 2:] = g[np.ix_(order, order)]
    m[0, 2:] = m[2:, 0] = plain[order]
    m[1, 2:] = m[2:, 1] = levels[order]
    m[0, 0], m[0, 1], m[1, 0], m[1, 1] = rows, sums[-2], sums[-2], sums[-1]
    return m


def _best_order(m: np.ndarray, rows: int, max_lag: int) -> int:
    """Lag order of the least AIC: one Cholesky factor holds the regressions of all orders."""
    try:
        lower = np.linalg.cholesky(m[:-1, :-1])
        explained = np.cumsum(np.linalg.solve(lower, m[:-1, -1]) ** 2)
    except np.linalg.LinAlgError:  # dependent regressors: each order by itself
        explained = np.array([solve(m[:q, :q], m[:q, -1]) @ m[:q, -1] for q in range(1, max_lag + 3)])
    best, order = math.inf, 0
    for lag in range(max_lag + 1):
        q = lag + 2
        if rows <= q:
            break
        aic = rows * math.log(max(m[-1, -1] - explained[q - 1], 1e-300) / rows) + 2 * q
        if aic < best - 1e-12:
            best, order = aic, lag
    return order


def _adf_of(sums: np.ndarray, head: np.ndarray, tail: np.ndarray, max_lag: int, n: int) -> tuple[float, int, int]:
    """Statistic, lag order and rows used, from the sums and the values at both ends of a series of ``n`` values."""
    rows = n - max_lag - 1
    d = np.diff(head)
    m = _lag_gram(sums, d, np.diff(tail)[::-1], max_lag, rows)
    order = _best_order(m, rows, max_lag)
    q = order + 2
    m = m[np.ix_(keep := np.r_[0:q, -1], keep)]
    for t in range(order + 1, max_lag + 1):  # rows that a lower order can use, too; all of them at the head
        x = np.r_[1.0, head[t - 1], d[t - 1 - order : t - 1][::-1], d[t - 1]]
        m = m + np.outer(x, x)
    rows += max_lag - order
    if rows <= q:
        return float("nan"), order, rows
    beta = solve(m[:q, :q], m[:q, q])
    rss = max(m[q, q] - beta @ m[:q, q], 0.0)
    se = math.sqrt(max(rss / (rows - q) * np.linalg.pinv(m[:q, :q])[1, 1], 0.0))
    return (beta[1] / se if se > 0 else float("nan")), order, rows


def adf_test(
    df: DataFrame,
    value: str,
    *,
    max_lag: int,
    keys: Sequence[str] = (),
    ts: str = "ts",
    layout: Layout | None = None,
    level: float = 0.05,
) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant; lag order by AIC: one row per series.

    One pass: a chunk with its ``max_lag + 1`` rows before gives three sums a lag, so work and plan grow with
    ``max_lag``, not with its square. These and the values at both ends of a series make its cross products for
    every order. ``default_max_lag`` gives the usual bound. Series without a row behind ``max_lag`` + 1 others give none.
    """
    base = df.select(*keys, ts, F.col(value).cast("double").alias("y")).where(F.col("y").isNotNull())
    layout = resolve(base, keys, ts, layout)
    placed = add_positions(base, keys, ts, layout=layout, total="n")
    # around its mean a series far from zero keeps its digits; with a constant in the regression nothing else changes
    centred = with_group_stats(placed, keys, {"__mean": F.avg("y")}).withColumn("y", F.col("y") - F.col("__mean")).drop("__mean")
    chunks = halo_chunks(centred, before=max_lag + 1, after=0, chunk_rows=layout.chunk_rows)
    width = 3 * (max_lag + 1) + 2

    def of_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        at, y, n = pdf["rn"].to_numpy(), pdf["y"].to_numpy(), int(pdf["n"].iloc[0])
        mine = pdf["__own"].to_numpy(bool)
        own = np.flatnonzero(mine & ((at <= max_lag) | (at >= n - max_lag - 1)))
        first = max(int(np.argmax(mine)), max_lag + 1 - int(at[0])) if mine.any() else len(y)  # behind the end there may be a chunk of copies
        sums = _lag_sums(y, first, max_lag) if first < len(y) else np.zeros(width)
        where = np.r_[np.arange(width), width + at[own]]
        return pdf[list(keys)].iloc[[0] * len(where)].assign(n=n, pos=where, v=np.r_[sums, y[own]])

    parts = chunks.groupBy(*keys, "__chunk").applyInPandas(of_chunk, _key_schema(base, keys, "n long, pos long, v double"))
    summed = parts.groupBy(*keys, "n", "pos").agg(F.sum("v").alias("v"))  # an end's value is in one chunk only

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        one = pdf[list(keys)].iloc[:1]
        if n < max_lag + 2:
            return one.iloc[:0].assign(statistic=0.0, p_value=0.0, lags=0, rows=0, stationary=False)
        v = pdf.set_index("pos")["v"]
        head = v.loc[width + np.arange(max_lag + 1)].to_numpy()
        tail = v.loc[width + np.arange(n - max_lag - 1, n)].to_numpy()
        tau, order, rows = _adf_of(v.loc[np.arange(width)].to_numpy(), head, tail, max_lag, n)
        prob = adf_p_value(tau) if tau == tau else None
        return one.assign(
            statistic=None if tau != tau else tau, p_value=prob, lags=order, rows=rows, stationary=bool(prob is not None and prob < level)
        )

    schema = _key_schema(df, keys, "statistic double, p_value double, lags int, rows long, stationary boolean")
    return _keyed_rows(test, keys, summed, schema)


def default_max_lag(n: int) -> int:
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))


def sarima_chunks(
    df: DataFrame, value: str, *, train_size: int = 1500, test_size: int = 500, train_ratio: float = 0.8,
    keys: Sequence[str] = (), ts: str = "ts", layout: Layout | None = None,
) -> DataFrame:
    """The last ``train_size + test_size`` rows of the training part, with ``pos`` and ``is_train``.

    At most that many rows per series are kept, so later windows may partition by series.
    """
    base = df.select(*keys, ts, F.col(value).cast("double").alias("y")).where(F.col("y").isNotNull())
    first = mark_split(base, test_ratio=1 - train_ratio, keys=keys, ts=ts, layout=layout).where("is_train").drop("is_train")
    tail = last_rows(first, train_size + test_size, keys=keys, ts=ts)
    order = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(ts)
    placed = tail.withColumn("pos", F.row_number().over(order) - 1)
    return placed.withColumn("is_train", F.col("pos") < train_size)


def _bounded(keys: Sequence[str]):
    """Window over a chunk whose rows per series are bounded by its construction."""
    return Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("pos")


def _seasonal_difference(w) -> Column:
    return (F.col("y") - F.lag("y", 1).over(w)) - (F.lag("y", SEASON).over(w) - F.lag("y", SEASON + 1).over(w))


def fit_sarima(chunks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Two-stage least squares (Hannan, Rissanen 1982) on the differenced training rows.

    Orders (1,1,1)(1,1,0) with season 24. A long autoregression gives residuals; the final equation
    regresses on lags 1, 24, 25 and the last residual, with lag 25 left free. One row per series:
    ``coef`` (three lags, then the residual), the last differences, levels and residual.
    """
    w = _bounded(keys)
    diffed = chunks.where("is_train").withColumn("w", _seasonal_difference(w))
    lagged = diffed.withColumns({f"l{k}": F.lag("w", k).over(w) for k in LONG_LAGS})
    p = len(LONG_LAGS)

    def first_stage(pdf: pd.DataFrame) -> pd.DataFrame:
        m = unpack(pdf["products"].iloc[0], p + 1)
        return pdf[list(keys)].assign(a=[solve(m[:p, :p], m[:p, p])])

    grams = gram(lagged, [F.col(f"l{k}") for k in LONG_LAGS] + [F.col("w")], keys)
    long_ar = _keyed_rows(first_stage, keys, grams, _key_schema(chunks, keys, "a array<double>"))
    joined = _attach(lagged, long_ar, keys, ["a"])
    fitted = sum((F.col("a")[i] * F.col(f"l{k}") for i, k in enumerate(LONG_LAGS)), F.lit(0.0))
    resid = joined.withColumn("e", F.col("w") - fitted).withColumn("e1", F.lag("e", 1).over(w))
    q = len(FINAL_LAGS) + 1

    def second_stage(pdf: pd.DataFrame) -> pd.DataFrame:
        m = unpack(pdf["products"].iloc[0], q + 1)
        return pdf[list(keys)].assign(coef=[solve(m[:q, :q], m[:q, q])])

    grams = gram(resid, [F.col(f"l{k}") for k in FINAL_LAGS] + [F.col("e1"), F.col("w")], keys)
    coefs = _keyed_rows(second_stage, keys, grams, _key_schema(chunks, keys, "coef array<double>"))
    # The state needs the last 25 rows of a chunk of bounded length.
    newest = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(F.col("pos").desc())
    ends = resid.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= SEASON + 1)
    state = ends.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", "w", "y"))).alias("s"), F.max_by("e", "pos").alias("last_e")
    )
    state = state.select(
        *keys, F.transform("s", lambda r: r["w"]).alias("last_w"), F.transform("s", lambda r: r["y"]).alias("last_y"), "last_e"
    )
    return _attach(state, coefs, keys, ["coef"])


def _attach(df: DataFrame, small: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Attach a one-row-per-series table."""
    if keys:
        return null_safe_join(df, small, keys)
    out = df
    for c in columns:
        out = out.withColumn(c, small.select(c).scalar())
    return out


def moving_average_residuals(
    df: DataFrame, signal: Column, theta: Column, *, name: str = "e", previous: str | None = None, keys: Sequence[str] = (),
    ts: str = "ts", layout: Layout | None = None, position: str | None = None,
) -> DataFrame:
    """Residuals ``e[t] = signal[t] - theta * e[t-1]`` of a whole series, 0 before its first row; rows without a signal pass them on."""
    return linear_recurrence(df, -theta, signal, name=name, previous=previous, keys=keys, ts=ts, layout=layout, position=position)


def fit_sarima_series(
    df: DataFrame, value: str, *, rounds: int = 4, keys: Sequence[str] = (), ts: str = "ts", layout: Layout | None = None
) -> DataFrame:
    """``coef`` (lags 1, 24, 25, then the moving average), ``sigma2`` and ``rows`` from every row of each series.

    Starts as ``fit_sarima`` and then repeats: residuals by the model's own recursion over the whole series, and
    the regression on lags and the residual before. No series gathers in a task; what is solved is 4 by 4.
    """
    base = df.select(*keys, ts, F.col(value).cast("double").alias("y")).where(F.col("y").isNotNull())
    wanted = sorted({0, 1, *LONG_LAGS, *(k + 1 for k in LONG_LAGS), *FINAL_LAGS})

    def build(f: Frames) -> dict[str, Column]:
        lag = lambda k: F.lag("y", k).over(f.order) if k else F.col("y")
        return {f"l{k}": (lag(k) - lag(k + 1)) - (lag(k + SEASON) - lag(k + SEASON + 1)) for k in wanted}

    reach = max(wanted) + SEASON + 1
    windows = apply_windows(base, build, before=reach, keys=keys, ts=ts, layout=layout, keep_position=True)
    lagged = materialize(windows, "lagged")
    p, q = len(LONG_LAGS), len(FINAL_LAGS) + 1

    def solved(size: int):
        def run(parts):
            for pdf in parts:
                fits = []
                for n, products in zip(pdf["n"], pdf["products"]):
                    m = unpack(products, size + 1)
                    beta = solve(m[:size, :size], m[:size, size]) if n > size else np.zeros(size)
                    fits.append((beta, float(m[size, size] - beta @ m[:size, size]) / n if n else None))
                yield pdf[list(keys)].assign(coef=[f for f, _ in fits], sigma2=[s for _, s in fits], rows=pdf["n"].to_numpy())

        return run

    schema = _key_schema(lagged, keys, "coef array<double>, sigma2 double, rows long")
    target = F.col("l0")
    # a series shorter than the lags has no equation: its products are null
    full = lambda columns: gram(rows_of, columns, keys).where(F.forall("products", lambda v: v.isNotNull()))
    rows_of = lagged
    long_ar = full([F.col(f"l{k}") for k in LONG_LAGS] + [target]).mapInPandas(solved(p), schema)
    tagged = _attach(lagged, long_ar.withColumnRenamed("coef", "a"), keys, ["a"])
    before = F.col("l1") - sum((F.col("a")[i] * F.col(f"l{k + 1}") for i, k in enumerate(LONG_LAGS)), F.lit(0.0))
    rows_of = tagged.withColumn("e1", before)
    regressors = [F.col(f"l{k}") for k in FINAL_LAGS] + [F.col("e1"), target]
    fit = materialize(full(regressors).mapInPandas(solved(q), schema), "fit")
    for _ in range(rounds):
        known = _attach(lagged, fit.drop("sigma2", "rows"), keys, ["coef"])
        signal = target - sum((F.col("coef")[i] * F.col(f"l{k}") for i, k in enumerate(FINAL_LAGS)), F.lit(0.0))
        theta = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.col("coef")[q - 1]))  # the recursion has to forget its start
        rows_of = moving_average_residuals(known, signal, theta, previous="e1", keys=keys, ts=ts, layout=layout, position="rn")
        fit = materialize(full(regressors).mapInPandas(solved(q), schema), "fit")
    return fit


def sarima_paths(fits: DataFrame, steps: int, keys: Sequence[str] = ()) -> DataFrame:
    """Forecast of ``steps`` values per series, integrated back to levels and clipped at zero."""

    def advance(state: Column, k: Column) -> Column:
        ws, ys = state["w"], state["y"]
        nxt = (
            F.col("coef")[0] * F.element_at(ws, -1)
            + F.col("coef")[1] * F.element_at(ws, -SEASON)
            + F.col("coef")[2] * F.element_at(ws, -SEASON - 1)
            + F.when(k == 1, F.col("coef")[3] * F.coalesce("last_e", F.lit(0.0))).otherwise(0.0)
        )
        level = nxt + F.element_at(ys, -1) + F.element_at(ys, -SEASON) - F.element_at(ys, -SEASON - 1)
        return F.struct(
            F.slice(F.array_append(ws, nxt), 2, SEASON + 1).alias("w"),
            F.slice(F.array_append(ys, level), 2, SEASON + 1).alias("y"),
            F.array_append(state["path"], level).alias("path"),
        )

    start = F.struct(F.col("last_w").alias("w"), F.col("last_y").alias("y"), F.array().cast("array<double>").alias("path"))
    ready = fits.where((F.size("last_y") == SEASON + 1) & F.forall("last_w", lambda v: v.isNotNull()))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, advance, lambda s: s["path"])
    long = ready.select(*keys, F.posexplode(path).alias("pos", "raw"))
    return long.select(*keys, (F.col("pos") + 1).alias("step"), non_negative(F.col("raw")).alias("predicted"))


def sarima_forecast(
    df: DataFrame, value: str, *, train_size: int = 1500, test_size: int = 500, keys: Sequence[str] = (), ts: str = "ts",
    layout: Layout | None = None,
) -> DataFrame:
    """One-shot forecast of the rows right after the training chunk: ``actual``, ``predicted``."""
    chunks = sarima_chunks(df, value, train_size=train_size, test_size=test_size, keys=keys, ts=ts, layout=layout)
    ahead = sarima_paths(fit_sarima(chunks, keys), test_size, keys)
    test = chunks.where("NOT is_train").withColumn("step", (F.col("pos") - train_size + 1).cast("int"))
    joined = null_safe_join(test, ahead, [*keys, "step"], "inner")
    return joined.select(*keys, ts, F.col("y").alias("actual"), "predicted")


def walk_forward(
    df: DataFrame, value: str, *, train_ratio: float = 0.8, max_steps: int | None = None, keys: Sequence[str] = (),
    ts: str = "ts", layout: Layout | None = None,
) -> DataFrame:
    """One-step forecasts refitted before every row of the test part: ``actual``, ``predicted``.

    The normal equations of an expanding fit are running sums, so one ordered pass replaces a refit
    per step; each row then solves a 3 by 3 system. The whole test part is evaluated unless ``max_steps`` limits it.
    """
    base = df.select(*keys, ts, F.col(value).cast("double").alias("y")).where(F.col("y").isNotNull())
    placed = add_positions(base, keys, ts, layout=layout, total="n")

    def build(f: Frames) -> dict[str, Column]:
        lag = lambda k: F.lag("y", k).over(f.order)
        diff = lambda k: (lag(k) - lag(k + 1)) - (lag(k + SEASON) - lag(k + SEASON + 1))
        cols = {f"x{i}": diff(k) for i, k in enumerate(FINAL_LAGS)}
        cols["w"] = (F.col("y") - lag(1)) - (lag(SEASON) - lag(SEASON + 1))
        cols["carry"] = lag(1) + lag(SEASON) - lag(SEASON + 1)
        return cols

    reach = max(FINAL_LAGS) + SEASON + 1
    lagged = apply_windows(placed, build, before=reach, keys=keys, ts=ts, layout=layout, position="rn")
    names = ["x0", "x1", "x2", "w"]
    whole = F.when(F.col("x2").isNotNull(), 1)
    sums = {f"s{i}{j}": whole * F.col(names[i]) * F.col(names[j]) for i in range(3) for j in range(i, 4)}
    summed = running_sums(lagged, sums, keys, ts, layout=layout, include_current=False)
    cut = F.floor(F.col("n") * F.lit(train_ratio))
    test = summed.where(F.col("rn") >= cut)
    if max_steps is not None:
        test = test.where(F.col("rn") < cut + max_steps)
    cells = [f"s{i}{j}" for i in range(3) for j in range(i, 4)]

    @F.pandas_udf("double")
    def step(parts: pd.DataFrame) -> pd.Series:
        m = {c: parts[c].to_numpy(float) for c in cells}
        xx = np.stack([np.stack([m[f"s{min(i, j)}{max(i, j)}"] for j in range(3)], -1) for i in range(3)], -2)
        xy = np.stack([m[f"s{i}3"] for i in range(3)], -1)
        x = parts[["x0", "x1", "x2"]].to_numpy(float)
        beta = np.einsum("nij,nj->ni", np.linalg.pinv(xx, rcond=1e-12, hermitian=True), xy)
        return pd.Series((beta * x).sum(axis=1))

    ready = test.where(F.col("x2").isNotNull())
    level = step(F.struct(*cells, "x0", "x1", "x2")) + F.col("carry")
    return ready.select(*keys, ts, F.col("y").alias("actual"), non_negative(level).alias("predicted"))

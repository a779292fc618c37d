import numpy as np
import pandas as pd
from helpers import hours, series, to_spark
from pyspark.sql import functions as F

from tidemark.operators.arima import fit_sarima_series, moving_average_residuals
from tidemark.plans.positions import DAY, HOUR, Layout
from tidemark.plans.recurrence import compose, linear_recurrence


def by_hand(a, b, start=0.0):
    out, s = [], start
    for x, y in zip(a, b):
        if x == x and y == y:
            s = x * s + y
        out.append(s)
    return np.array(out)


def test_maps_compose():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 64, 1000):
        a, b = rng.uniform(-1, 1, n), rng.normal(size=n)
        through, added = compose(a, b)
        np.testing.assert_allclose(through * 3 + added, by_hand(a, b, 3.0), atol=1e-9)


def test_panel_equals_the_loop(spark):
    parts = [series(n, seed=n, gaps=0.1, nulls=0.2).assign(k=k) for k, n in (("a", 150), ("b", 1), (None, 40))]
    rng = np.random.default_rng(2)
    pdf = pd.concat(parts)
    pdf["c"] = rng.uniform(-1, 1, len(pdf))
    for layout in (Layout("sliced", 9 * HOUR, 7), Layout("keyed", DAY, 1000)):
        out = linear_recurrence(to_spark(spark, pdf).repartition(4), F.col("c"), F.col("v"), start=2.0, previous="was", keys=["k"], layout=layout)
        got = out.toPandas()
        assert len(got) == len(pdf)
        for key in ("a", "b", None):
            mine, own = ((t[t["k"].isna()] if key is None else t[t["k"] == key]).sort_values("ts") for t in (got, pdf))
            want = by_hand(own["c"], own["v"], 2.0)
            np.testing.assert_allclose(mine["state"], want, atol=1e-9)
            np.testing.assert_allclose(mine["was"], np.r_[2.0, want[:-1]], atol=1e-9)
    empty = to_spark(spark, pdf).limit(0)
    assert linear_recurrence(empty, F.lit(0.5), F.col("v"), layout=Layout("sliced", DAY, 10)).count() == 0


def test_a_million_rows_equal_the_loop(spark):
    n = 1_000_000
    df = spark.range(n).select(F.timestamp_micros(F.col("id") * 60_000_000).alias("ts"), ((F.col("id") * 7919 % 1000) / 100 - 5).alias("u"))
    got = moving_average_residuals(df, F.col("u"), F.lit(-0.9), layout=Layout("sliced", 30 * DAY, 65_536)).select("ts", "e").toPandas().sort_values("ts")
    u = (np.arange(n) * 7919 % 1000) / 100 - 5
    np.testing.assert_allclose(got["e"], by_hand(np.full(n, 0.9), u), atol=1e-8)


def test_fit_recovers_the_process(spark):
    rng = np.random.default_rng(7)
    parts = []
    for k, phi, theta in (("a", 0.5, 0.4), ("b", 0.2, -0.6)):
        n = 6_000
        e, w = rng.normal(size=n), np.zeros(n)
        for t in range(1, n):
            w[t] = phi * w[t - 1] + e[t] + theta * e[t - 1]
        level = np.zeros(n + 25)  # first and seasonal differences taken back
        for t in range(n):
            level[t + 25] = w[t] + level[t + 24] + level[t + 1] - level[t]
        parts.append(pd.DataFrame({"k": k, "ts": hours(n + 25), "v": level}))
    parts.append(pd.DataFrame({"k": "short", "ts": hours(20), "v": np.arange(20.0)}))
    df = to_spark(spark, pd.concat(parts)).repartition(4)
    fits = {r.k: r for r in fit_sarima_series(df, "v", keys=["k"], layout=Layout("sliced", 30 * DAY, 500)).collect()}
    assert set(fits) == {"a", "b"}
    for k, phi, theta in (("a", 0.5, 0.4), ("b", 0.2, -0.6)):
        np.testing.assert_allclose(fits[k].coef, [phi, 0, 0, theta], atol=0.06)
        assert abs(fits[k].sigma2 - 1) < 0.06 and fits[k].rows > 5_900

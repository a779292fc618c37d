import math

import numpy as np
import pandas as pd
from helpers import hours, to_spark

from tidemark.operators import arima
from tidemark.plans.positions import DAY, Layout


def by_hand(y, max_lag):
    """Each order by least squares on the rows themselves."""
    d = np.diff(y, prepend=np.nan)

    def design(order, first):
        t = np.arange(first, len(y))
        return np.column_stack([np.ones(len(t)), y[t - 1], *(d[t - k] for k in range(1, order + 1))]), d[t]

    def fit(x, z):
        beta = np.linalg.lstsq(x, z, rcond=None)[0]
        return beta, float(((z - x @ beta) ** 2).sum())

    scores = []
    for order in range(max_lag + 1):
        x, z = design(order, max_lag + 1)
        scores.append(len(z) * math.log(fit(x, z)[1] / len(z)) + 2 * (order + 2))
    order = int(np.argmin(scores))
    x, z = design(order, order + 1)
    beta, rss = fit(x, z)
    se = math.sqrt(rss / (len(z) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    return beta[1] / se, order, len(z)


def processes():
    rng = np.random.default_rng(5)
    e = rng.normal(size=900)
    ar = np.zeros(900)
    for t in range(3, 900):
        ar[t] = 0.5 * ar[t - 1] + 0.3 * ar[t - 3] + e[t]
    return {"walk": np.cumsum(e), "stationary": ar + 5_000, "noise": e[:120], "short": np.cumsum(e[:40])}


def test_equals_least_squares_on_the_rows(spark):
    parts = processes()
    pdf = pd.concat([pd.DataFrame({"k": k, "ts": hours(len(y)), "v": y}) for k, y in parts.items()])
    pdf = pd.concat([pdf, pd.DataFrame({"k": "few", "ts": hours(12), "v": np.arange(12.0)}), pd.DataFrame({"k": "flat", "ts": hours(60), "v": 3.0})])
    df = to_spark(spark, pdf).repartition(4)
    for layout in (Layout("sliced", 3 * DAY, 25), Layout("keyed", DAY, 100_000)):
        got = {r.k: r for r in arima.adf_test(df, "v", max_lag=12, keys=["k"], layout=layout).collect()}
        assert set(got) == {*parts, "flat"} and got["flat"].statistic is None and not got["flat"].stationary
        for k, y in parts.items():
            tau, order, rows = by_hand(y, 12)
            assert (got[k].lags, got[k].rows) == (order, rows), k
            assert abs(got[k].statistic - tau) < 1e-6 * max(1, abs(tau)), k
        assert got["stationary"].stationary and not got["walk"].stationary
    whole = df.where("k = 'walk'").drop("k")
    one = arima.adf_test(whole, "v", max_lag=0, layout=Layout("sliced", DAY, 64)).collect()[0]
    assert abs(one.statistic - by_hand(parts["walk"], 0)[0]) < 1e-8


def test_gram_of_all_orders():
    y = processes()["walk"][:200]
    p, d = 30, np.diff(processes()["walk"][:200], prepend=np.nan)
    m = arima._lag_gram(arima._lag_sums(y, p + 1, p), np.diff(y[: p + 1]), np.diff(y[-p - 1 :])[::-1], p, 200 - p - 1)
    t = np.arange(p + 1, 200)
    x = np.column_stack([np.ones(len(t)), y[t - 1], *(d[t - k] for k in range(1, p + 1)), d[t]])
    np.testing.assert_allclose(m, x.T @ x, atol=1e-9)


def test_plan_does_not_grow_with_the_lags(spark):
    df = to_spark(spark, pd.DataFrame({"ts": hours(50), "v": np.arange(50.0)}))
    sizes = [len(arima.adf_test(df, "v", max_lag=p, layout=Layout("sliced", DAY, 1000))._jdf.queryExecution().optimizedPlan().toString()) for p in (2, 216)]
    assert abs(sizes[0] - sizes[1]) < 200

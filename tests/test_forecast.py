import numpy as np
import pandas as pd
from helpers import hours, seasonal, to_spark
from pyspark.sql import functions as F

from tidemark.operators import arima, metrics
from tidemark.operators.forecast import future_forecast, look_back_regression, multi_step_forecast
from tidemark.operators.linear import solve
from tidemark.plans.positions import DAY, Layout

LAYOUT = Layout("sliced", 5 * DAY, 200)


def test_direct_model_equals_least_squares(spark):
    pdf = seasonal(400, seed=2)
    df = to_spark(spark, pdf).repartition(4)
    model, scored = multi_step_forecast(df, "v", look_back=24, horizon=6, layout=LAYOUT)
    lo, hi = pdf["v"].min(), pdf["v"].max()
    s = ((pdf["v"] - lo) / (hi - lo)).to_numpy()
    x = np.stack([s[i - 24 : i] for i in range(24, 395)])
    y = np.stack([s[i : i + 6] for i in range(24, 395)])
    cut = int(len(x) * 0.8)
    a = np.column_stack([np.ones(cut), x[:cut]])
    want = np.linalg.lstsq(a, y[:cut], rcond=None)[0]
    np.testing.assert_allclose(model.weights, want, atol=1e-6)
    got = scored.toPandas().sort_values("ts")
    assert len(got) == len(x) - cut
    np.testing.assert_allclose(np.stack(got["y"]), y[cut:] * (hi - lo) + lo, atol=1e-9)
    ahead = future_forecast(df, "v", model, look_back=24).orderBy("step").toPandas()
    assert ahead["ts"].tolist() == list(pd.date_range(pdf["ts"].iloc[-1], periods=7, freq="h")[1:])
    tail = np.concatenate([[1], s[-24:]]) @ want * (hi - lo) + lo
    np.testing.assert_allclose(ahead["forecast"], tail, atol=1e-6)


def test_look_back_beats_the_seasonal_naive(spark):
    pdf = seasonal(600, seed=3, noise=1.0)
    got = look_back_regression(to_spark(spark, pdf), "v", layout=LAYOUT).toPandas().sort_values("ts")
    naive = pdf.set_index("ts")["v"].shift(24).loc[got["ts"]].to_numpy()
    rmse = lambda e: float(np.sqrt(np.mean(e**2)))
    assert rmse(got["actual"] - got["predicted"]) < rmse(got["actual"].to_numpy() - naive)


def test_forecasts_stay_above_zero(spark):
    pdf = pd.DataFrame({"ts": hours(200), "v": np.linspace(200, 1, 200)})
    df = to_spark(spark, pdf)
    model, _ = multi_step_forecast(df, "v", look_back=12, horizon=24, layout=LAYOUT)
    assert future_forecast(df, "v", model, look_back=12).agg(F.min("forecast")).first()[0] == 0.0


def planted(n, seed=0):
    """Doubly differenced series with known coefficients on lags 1 and 24."""
    rng = np.random.default_rng(seed)
    w = np.zeros(n)
    e = rng.normal(0, 1, n)
    for t in range(25, n):
        w[t] = 0.5 * w[t - 1] - 0.4 * w[t - 24] + 0.2 * w[t - 25] + e[t]
    y = np.full(n, 500.0)
    for t in range(25, n):
        y[t] = w[t] + y[t - 1] + y[t - 24] - y[t - 25]
    return pd.DataFrame({"ts": hours(n), "v": y})


def test_sarima_recovers_coefficients(spark):
    df = to_spark(spark, planted(2600))
    chunks = arima.sarima_chunks(df, "v", train_size=1900, test_size=100, layout=LAYOUT)
    assert chunks.count() == 2000
    fits = arima.fit_sarima(chunks)
    phi, season, both, _ = fits.first()["coef"]
    assert abs(season + 0.4) < 0.1 and abs(phi - 0.5) < 0.25 and abs(both - 0.2) < 0.2
    got = arima.sarima_paths(fits, 100).orderBy("step").toPandas()
    assert len(got) == 100 and got["predicted"].min() >= 0


def test_walk_forward_equals_refits(spark):
    pdf = planted(260, seed=5)
    got = arima.walk_forward(to_spark(spark, pdf), "v", layout=Layout("sliced", 2 * DAY, 60), max_steps=20)
    got = got.toPandas().sort_values("ts", ignore_index=True)
    y = pdf["v"].to_numpy()
    w = pd.Series(y).diff().diff(24).to_numpy()
    x = np.stack([pd.Series(w).shift(k) for k in (1, 24, 25)], 1)
    cut = int(260 * 0.8)
    for k, t in enumerate(range(cut, cut + 20)):
        rows = [i for i in range(t) if np.isfinite(x[i]).all() and np.isfinite(w[i])]
        beta = np.linalg.lstsq(x[rows], w[rows], rcond=None)[0]
        want = max(beta @ x[t] + y[t - 1] + y[t - 24] - y[t - 25], 0)
        np.testing.assert_allclose(got["predicted"][k], want, rtol=1e-6)


def test_unit_root_statistic(spark):
    rng = np.random.default_rng(0)
    walk = np.cumsum(rng.normal(size=300))
    noise = rng.normal(size=300)
    results = []
    for v in (walk, noise):
        df = to_spark(spark, pd.DataFrame({"ts": hours(300), "v": v}))
        r = arima.adf_test(df, "v", max_lag=3, layout=LAYOUT).first()
        d, p = np.diff(v), r["lags"]
        rows = range(p, len(d))
        a = np.array([[1, v[t], *[d[t - k] for k in range(1, p + 1)]] for t in rows])
        b = d[p:]
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        s2 = ((b - a @ beta) ** 2).sum() / (len(b) - a.shape[1])
        np.testing.assert_allclose(r["statistic"], beta[1] / np.sqrt(s2 * np.linalg.inv(a.T @ a)[1, 1]), rtol=1e-6)
        assert r["rows"] == len(b)
        results.append(r["stationary"])
    assert results == [False, True]
    assert abs(arima.adf_p_value(-2.86) - 0.05) < 0.002 and abs(arima.adf_p_value(-3.43) - 0.01) < 0.001
    assert solve(np.eye(2), np.ones(2)).tolist() == [1.0, 1.0]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 1.0), ("a", 4.0, 5.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0)], "Model string, actual double, predicted double")
    rows = {r["Model"]: r for r in metrics.compare_models(df).collect()}
    assert list(rows) == ["b", "a"]
    assert (rows["a"]["MAE"], rows["a"]["RMSE"], rows["a"]["MAPE"], rows["a"]["R2"]) == (1.0, 1.0, 37.5, 0.625)
    best = metrics.best_flags(metrics.compare_models(df)).where("is_best").select("Model").distinct().collect()
    assert [r[0] for r in best] == ["b"]


def test_boosted_strategies_agree_in_shape(spark):
    df = to_spark(spark, seasonal(160, seed=4))
    small = {"maxIter": 2, "maxDepth": 2}
    for strategy in ("pooled", "per_step"):
        model, scored = multi_step_forecast(df, "v", look_back=12, horizon=2, strategy=strategy, params=small, layout=LAYOUT)
        rows = scored.collect()
        assert model.horizon == 2 and len(rows) == 30
        assert all(len(r["y_hat"]) == 2 and 5 < r["y_hat"][0] < 40 for r in rows)
        assert future_forecast(df, "v", model, look_back=12).count() == 2

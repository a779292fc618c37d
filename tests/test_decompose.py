import numpy as np
from helpers import seasonal, to_spark

from tidemark.operators.decompose import classical, smooth, stl
from tidemark.plans.positions import DAY, Layout


def slow_fit(y, q, i):
    """Tricube-weighted line through the q nearest points, by the book."""
    n = len(y)
    left = min(max(i - (q - 1) // 2, 0), n - q)
    x = np.arange(left, left + q, dtype=float)
    h = max(i - left, left + q - 1 - i)
    w = (1 - np.clip(np.abs(x - i) / h, 0, 1) ** 3) ** 3
    a = np.column_stack([np.ones(q), x - i])
    return np.linalg.lstsq(a * np.sqrt(w)[:, None], y[left : left + q] * np.sqrt(w), rcond=None)[0][0]


def test_smoother_is_a_weighted_line():
    y = np.random.default_rng(0).normal(size=60)
    got = smooth(y, np.ones(60), 13, 59)
    want = [slow_fit(y, 13, i) for i in range(60)]
    np.testing.assert_allclose(got, want, atol=2e-3)  # the outermost weights are cut off


def test_chunks_agree_with_one_pass(spark):
    pdf = seasonal(700, noise=0.5)
    pdf.loc[300, "v"] += 6
    df = to_spark(spark, pdf).repartition(3)
    runs = [
        stl(df, "v", layout=Layout("sliced", 3 * DAY, size), outer=1).toPandas().sort_values("ts", ignore_index=True)
        for size in (50, 10_000)
    ]
    for c in ("trend", "seasonal", "residual"):
        np.testing.assert_allclose(runs[0][c], runs[1][c], atol=1e-9)
    one = runs[0]
    np.testing.assert_allclose(one["trend"] + one["seasonal"] + one["residual"], one["observed"], atol=1e-9)
    inside = one.iloc[48:-48]
    i = inside.index.to_numpy()
    assert np.abs(inside["trend"] - (20 + 0.01 * i)).mean() < 0.3
    assert np.abs(inside["seasonal"] - 3 * np.sin(2 * np.pi * i / 24)).mean() < 0.4
    assert inside["residual"].idxmax() == 300


def test_classical_recovers_the_profile(spark):
    got = classical(to_spark(spark, seasonal(240, noise=0.0)), "v", layout=Layout("sliced", DAY, 40)).toPandas().sort_values("ts")
    i = np.arange(240)
    np.testing.assert_allclose(got["seasonal"], 3 * np.sin(2 * np.pi * i / 24), atol=1e-6)
    assert got["trend"].isna().sum() == 24

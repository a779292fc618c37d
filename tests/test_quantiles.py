import numpy as np
import pandas as pd
import pytest

from tidemark.plans import quantiles
from tidemark.plans.quantiles import exact_quantiles

PROBS = (0.0, 0.25, 0.5, 0.9, 1.0)


@pytest.mark.parametrize("driver_rows", [5_000, 0])
def test_refinement_equals_numpy(spark, monkeypatch, driver_rows):
    monkeypatch.setattr(quantiles, "DRIVER_ROWS", driver_rows)
    rng = np.random.default_rng(1)
    groups = {
        "hot": np.concatenate([np.full(400, 7.0), rng.normal(0, 1, 200)]),  # one value holds most rows
        "wide": rng.lognormal(0, 6, 300),
        "one": np.array([3.5]),
        "flat": np.full(20, -2.0),
    }
    pdf = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in groups.items()])
    df = spark.createDataFrame(pdf).repartition(4)
    probs = PROBS if driver_rows else (0.5,)
    got = exact_quantiles(df, "v", probs, ["g"], bins=8, sort_rows=5).toPandas()
    assert len(got) == len(groups) * len(probs)
    for r in got.itertuples():
        np.testing.assert_allclose(r.quantile, np.quantile(groups[r.g], r.prob), rtol=1e-12)


def test_whole_table_and_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (4.0,)], "v double")
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, "v", [0.5, 1.0]).collect()}
    assert got == {0.5: 2.5, 1.0: 4.0}
    assert exact_quantiles(df.where("v > 100"), "v", [0.5]).count() == 0

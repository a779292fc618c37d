import numpy as np
import pandas as pd
from helpers import to_spark

from tidemark.batch import Settings, default_view, run_batch
from tidemark.plans.positions import DAY, Layout
from tidemark.plans.session import scratch_path
from tidemark.sources.catalog import available_predictions, open_catalogue


def test_whole_run(spark):
    rng = np.random.default_rng(0)
    n = 24 * 30 * 4
    ts = pd.date_range("2024-01-01", periods=n, freq="15min")
    power = 2 + np.sin(2 * np.pi * np.arange(n) / 96) + rng.normal(0, 0.2, n)
    raw = pd.DataFrame({"ts": ts, "power": power, "sub": rng.random(n)})
    raw.loc[5, "power"] = np.nan
    settings = Settings(
        target="power", mean=("power",), total=("sub",), horizons={"24h": 24}, robust_rounds=0,
        forest={"numTrees": 3, "maxDepth": 3}, boosted={"maxIter": 2, "maxDepth": 2}, arima_train=300, arima_test=48,
        explain_rows=20, isolation_trees=10, layout=Layout("sliced", 10 * DAY, 500),
    )
    out = scratch_path(spark, "run")
    paths = run_batch(spark, to_spark(spark, raw), out, settings)
    found = open_catalogue(spark, out)
    assert found.complete and set(found.tables) >= {"stl_components", "alert_log", "anomalies"}
    assert default_view(spark, out).first()["records"] == 720
    assert found.tables["featured_data"].count() == 720 - 48
    assert available_predictions(spark, out, ["Random Forest", "Other"]) == ["Random Forest"]
    scores = {r["Model"]: r["RMSE"] for r in found.tables["model_comparison"].collect()}
    assert len(scores) == 4 and scores["Look-back Linear"] < 0.3
    assert spark.read.parquet(paths["future_forecast_24h"]).count() == 24

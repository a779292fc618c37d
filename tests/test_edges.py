"""Zones, null keys, gaps, lost versions, long tails: cases the driver tables don't hold."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import hours, seasonal, series, to_spark
from pyspark.sql import functions as F

from tidemark.operators import decompose, forecast
from tidemark.operators.features import build_features
from tidemark.operators.filters import last_rows
from tidemark.operators.isolation_forest import draw_samples
from tidemark.plans.positions import DAY, Layout
from tidemark.sources.readings import parse_date_time, with_time_column
from tidemark.streaming.jobs import live_tail


@pytest.fixture
def paris(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    yield
    spark.conf.set("spark.sql.session.timeZone", before)


def test_times_are_naive_in_a_zone_with_daylight_saving(spark, paris):
    rows = [("25/3/2007", "2:30:00"), ("25/3/2007", "3:30:00"), ("31/2/2007", "1:00:00"), ("1/1/2007", "24:00:00"), (None, "1:00:00"), ("x", "y")]
    got = [r.ts for r in parse_date_time(spark.createDataFrame(rows, "Date string, Time string").coalesce(1)).collect()]
    assert got == [dt.datetime(2007, 3, 25, 2, 30), dt.datetime(2007, 3, 25, 3, 30), None, None, None, None]
    table = with_time_column(spark.createDataFrame([("2007-03-25 02:30:00",)], "Datetime string"))
    assert table.first().ts == dt.datetime(2007, 3, 25, 2, 30)


def test_a_null_key_is_a_series_of_its_own(spark):
    pdf = series(120, seed=1)
    df = to_spark(spark, pdf)
    both = df.withColumn("k", F.lit("a")).unionByName(df.withColumn("k", F.lit(None).cast("string")))
    counts = {r.k: r["count"] for r in build_features(both, "v", keys=["k"]).groupBy("k").count().collect()}
    assert counts == {"a": 72, None: 72}


def test_stl_bridges_missing_values(spark):
    pdf = seasonal(600, seed=3)
    gaps = [5, 100, 101, 102, 333, 599]
    holed = pdf.assign(v=pdf["v"].where(~pdf.index.isin(gaps)))
    layout = Layout("sliced", 2 * DAY, chunk_rows=200)
    got = decompose.stl(to_spark(spark, holed), "v", layout=layout, outer=1).toPandas().sort_values("ts", ignore_index=True)
    full = decompose.stl(to_spark(spark, pdf), "v", layout=layout, outer=1).toPandas().sort_values("ts", ignore_index=True)
    assert got[["trend", "seasonal"]].notna().all().all()
    assert got["residual"].isna().to_numpy().nonzero()[0].tolist() == gaps
    assert np.abs(got["trend"] - full["trend"]).max() < 1 and np.abs(got["seasonal"] - full["seasonal"]).max() < 1


def test_live_tail_fails_without_its_last_version_and_deletes_older_ones(spark, tmp_path):
    batch = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), float(h)) for h in range(3)], "ts timestamp, actual double")
    path = str(tmp_path / "tail")
    update = live_tail(path, n=5)
    for k in range(3):
        update(batch, k)
    assert spark.read.parquet(f"{path}/v2").count() == 5
    assert sorted(p.name for p in (tmp_path / "tail").iterdir()) == ["v1", "v2"]
    with pytest.raises(FileNotFoundError):
        update(batch, 7)


def test_long_tails_of_many_series(spark):
    n = 3_000
    pdf = pd.DataFrame({"ts": hours(n), "v": np.arange(n)})
    df = to_spark(spark, pdf)
    both = df.withColumn("k", F.lit("a")).unionByName(df.limit(40).withColumn("k", F.lit("b")))
    got = last_rows(both, 1_500, keys=["k"]).toPandas()
    assert sorted(got.loc[got["k"] == "a", "v"]) == list(range(1_500, 3_000)) and (got["k"] == "b").sum() == 40


@pytest.mark.parametrize("rows", [60, 700, 60_000])
def test_every_tree_draws_its_own_sample(spark, rows):
    df = spark.range(rows).select(F.col("id").cast("double").alias("x"), "id")
    drawn = draw_samples(df, ["x"], ["id"], trees=12, sample_size=100, seed=1).toPandas()
    sizes = drawn.groupby("tree")["x"].agg(["size", "nunique"])
    assert len(sizes) == 12 and (sizes["size"] == min(rows, 100)).all() and (sizes["size"] == sizes["nunique"]).all()


def test_future_forecast_uses_the_bounds_of_its_model(spark):
    pdf = seasonal(400, seed=5)
    pdf.loc[390, "v"] = 500.0  # in the test part: outside the bounds of the first part
    df = to_spark(spark, pdf)
    layout = Layout("sliced", 2 * DAY, chunk_rows=100)
    model, _ = forecast.multi_step_forecast(df, "v", look_back=8, horizon=3, layout=layout, fit_on="train")
    bounds = model.bounds.first()
    assert bounds.hi < 100
    ahead = forecast.future_forecast(df.where("ts < '2024-01-16 00:00:00'"), "v", model, look_back=8).toPandas()
    assert len(ahead) == 3 and ahead["forecast"].between(10, 40).all()

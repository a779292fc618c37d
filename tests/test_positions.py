import numpy as np
import pandas as pd
import pytest
from helpers import series, to_spark
from pyspark.sql import functions as F

from tidemark.operators.features import build_features
from tidemark.operators.rolling import centred, difference, lags, trailing, undifference
from tidemark.plans.positions import DAY, HOUR, Layout, add_positions, choose_layout, fill_forward_back, running_sums

LAYOUTS = [Layout("sliced", 7 * HOUR, 10), Layout("sliced", DAY, 64), Layout("sliced", 1 << 62, 1000)]


def pandas_of(df):
    return df.toPandas().sort_values([c for c in ("k", "ts") if c in df.columns]).reset_index(drop=True)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_frames_equal_pandas(spark, layout):
    pdf = series(150, seed=3, gaps=0.2, nulls=0.1)
    df = to_spark(spark, pdf).repartition(5)
    got = pandas_of(lags(df, "v", [1, 7], layout=layout))
    np.testing.assert_allclose(got["lag_7"], pdf["v"].shift(7))
    got = pandas_of(trailing(df, "v", [6, 12], layout=layout))
    past = pdf["v"].shift(1)
    for w in (6, 12):
        for stat in ("mean", "std", "max", "min"):
            want = getattr(past.rolling(w), stat)()
            np.testing.assert_allclose(got[f"rolling_{stat}_{w}"], want, atol=1e-9)
    got = pandas_of(centred(df, "v", 24, layout=layout))
    np.testing.assert_allclose(got["roll_mean"], pdf["v"].rolling(24, center=True).mean(), atol=1e-9)
    got = pandas_of(centred(df, "v", 24, partial_edges=True, layout=layout))
    want = pdf["v"].rolling(24, center=True, min_periods=1)
    np.testing.assert_allclose(got["roll_mean"], want.mean(), atol=1e-9)
    np.testing.assert_allclose(got["roll_std"], want.std().fillna(1), atol=1e-9)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_fill_and_running_sums(spark, layout):
    pdf = series(120, seed=5, nulls=0.4)
    pdf.loc[:4, "v"] = np.nan
    pdf.loc[40:80, "v"] = np.nan
    pdf.loc[117:, "v"] = np.nan
    df = to_spark(spark, pdf).repartition(5)
    got = pandas_of(fill_forward_back(df, ["v"], layout=layout))
    np.testing.assert_allclose(got["v"], pdf["v"].ffill().bfill())
    got = pandas_of(running_sums(df, {"s": F.col("v")}, layout=layout))
    np.testing.assert_allclose(got["s"], pdf["v"].fillna(0).cumsum())
    got = pandas_of(running_sums(df, {"s": F.col("v")}, layout=layout, include_current=False))
    np.testing.assert_allclose(got["s"], pdf["v"].fillna(0).cumsum().shift(1, fill_value=0))


def test_panel_equals_single_series(spark):
    parts = [series(n, seed=n).assign(k=k) for k, n in (("a", 200), ("b", 60), (None, 30))]
    panel = pd.concat(parts)
    df = to_spark(spark, panel).repartition(3)
    for layout in (Layout("keyed"), Layout("sliced", DAY, 16)):
        got = add_positions(df, ["k"], layout=layout, total="n").toPandas()
        for part in parts:
            key = part["k"].iloc[0]
            one = got[got["k"].isna()] if key is None else got[got["k"] == key]
            one = one.sort_values("ts")
            assert one["rn"].tolist() == list(range(len(part))) and set(one["n"]) == {len(part)}
        got = centred(df, "v", 6, keys=["k"], layout=layout).where("k = 'a'").toPandas().sort_values("ts")
        np.testing.assert_allclose(got["roll_mean"], parts[0]["v"].rolling(6, center=True).mean(), atol=1e-9)


def test_layout_follows_the_largest_series(spark):
    big, small = series(500, 1).assign(k="big"), series(20, 2).assign(k="small")
    df = to_spark(spark, pd.concat([big, small]))
    assert choose_layout(df, ["k"], max_rows=1000).mode == "keyed"
    hot = choose_layout(df, ["k"], max_rows=100)
    assert hot == Layout("sliced", DAY)
    same = to_spark(spark, pd.DataFrame({"ts": [pd.Timestamp("2024-01-01")] * 50, "id": range(50)}))
    for tie in (["id"], []):  # without columns that tell the rows apart, a hash of the whole row does
        tied = choose_layout(same, tie=tie, max_rows=10)
        assert tied.tie_bits > 0
        got = add_positions(same, tie=tie, layout=tied).toPandas()
        assert sorted(got["rn"]) == list(range(50))


def test_no_window_without_partition_over_rows(spark):
    """The only unpartitioned window reads the per-slice table, behind an aggregate."""
    df = to_spark(spark, series(100))
    plan = build_features(df, "v", layout=Layout("sliced", DAY, 32))._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    single = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    for i in single:
        assert any("HashAggregate" in line for line in lines[i + 1 : i + 3])
    assert "__chunk" in plan


def test_difference_and_back(spark):
    pdf = series(100, seed=9)
    df = to_spark(spark, pdf)
    layout = Layout("sliced", 13 * HOUR, 20)
    got = pandas_of(difference(df, "v", layout=layout))
    np.testing.assert_allclose(got["diff"], pdf["v"].diff().diff(24), atol=1e-9)
    first = difference(df, "v", seasonal=0, layout=layout).withColumn("start", F.lit(float(pdf["v"][0])))
    got = pandas_of(undifference(first, "diff", "start", layout=layout))
    np.testing.assert_allclose(got["level"], pdf["v"], atol=1e-9)


def test_features_keep_rows_with_full_history(spark):
    got = build_features(to_spark(spark, series(500)), "v", layout=Layout("sliced", 7 * DAY, 128))
    assert got.count() == 452 and len(got.columns) == 2 + 34

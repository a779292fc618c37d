import numpy as np
import pandas as pd
from helpers import hours, series, to_spark

from tidemark.operators.alerts import alert_table, assign_severity, severity_columns, severity_counts, top_alerts
from tidemark.operators.anomaly import combined_anomalies, detect_rolling, detect_zscore
from tidemark.operators.isolation_forest import detect_isolation_forest
from tidemark.plans.positions import DAY, Layout

LAYOUT = Layout("sliced", 2 * DAY, 32)


def test_severity_bands_and_edges(spark):
    rows = [(0.0, 0.0, 1.0), (2.0, 0.0, 1.0), (2.5, 0.0, 1.0), (3.0, 0.0, 1.0), (4.0, 0.0, 1.0), (9999.0, 0.0, 1.0), (5.0, 0.0, 0.0), (None, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "value double, roll_mean double, roll_std double").coalesce(1)
    got = [r["severity"] for r in severity_columns(df).collect()]
    assert got == ["NORMAL", "LOW", "MEDIUM", "HIGH", "CRITICAL", "NORMAL", "NORMAL", "NORMAL"]


def test_severity_equals_pandas(spark):
    pdf = series(300, seed=4)
    pdf.loc[[50, 200], "v"] = [60.0, -40.0]
    got = assign_severity(to_spark(spark, pdf), "v", layout=LAYOUT).toPandas().sort_values("ts").reset_index(drop=True)
    roll = pdf["v"].rolling(24, center=True, min_periods=1)
    z = ((pdf["v"] - roll.mean()) / roll.std().fillna(1)).abs()
    np.testing.assert_allclose(got["z_score"], z.round(3), atol=1e-9)
    assert got["is_anomaly"].tolist() == ((z >= 2) & (z < 9999)).tolist()
    df = spark.createDataFrame(got)
    assert [r["severity"] for r in top_alerts(df, 2).collect()] == ["CRITICAL", "CRITICAL"]
    assert {r["severity"]: r["count"] for r in severity_counts(df).collect()}["CRITICAL"] == 2
    by_name = alert_table(df.where("is_anomaly"), sort_by="severity").collect()
    assert by_name[0]["severity"] == max(r["severity"] for r in by_name)


def test_constant_and_short_series(spark):
    flat = to_spark(spark, pd.DataFrame({"ts": hours(40), "v": [5.0] * 40}))
    assert assign_severity(flat, "v", layout=LAYOUT).where("severity <> 'NORMAL'").count() == 0
    assert detect_zscore(flat, "v").where("zscore").count() == 0
    short = to_spark(spark, series(5))
    assert detect_rolling(short, "v", layout=LAYOUT).where("rolling").count() == 0


def test_zscore_flags_the_right_rows_with_nulls(spark):
    pdf = series(200, seed=6, nulls=0.2)
    pdf.loc[150, "v"] = 80.0
    got = detect_zscore(to_spark(spark, pdf), "v").where("zscore").toPandas()
    assert got["v"].tolist() == [80.0]


def test_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(2)
    n = 3000
    pdf = pd.DataFrame(rng.normal(0, 1, (n, 3)), columns=["a", "b", "c"]).assign(ts=hours(n))
    planted = [10, 500, 2500]
    pdf.loc[planted, ["a", "b", "c"]] = [[9, -9, 9], [-8, 9, 8], [9, 9, -9]]
    pdf.loc[7, "a"] = np.nan
    df = to_spark(spark, pdf)
    got = detect_isolation_forest(df.repartition(5), ["a", "b", "c"], trees=60, contamination=0.01).toPandas()
    assert len(got) == n - 1 and abs(got["iforest"].sum() - 30) <= 1
    top = got.sort_values("score").tail(3)["ts"]
    assert set(top) == set(pdf.loc[planted, "ts"])
    again = detect_isolation_forest(df.repartition(3), ["a", "b", "c"], trees=60, contamination=0.01).toPandas()
    assert set(again.loc[again["iforest"], "ts"]) == set(got.loc[got["iforest"], "ts"])


def test_combined_table_aligns_partial_flags(spark):
    df = to_spark(spark, series(60))
    flags = df.limit(10).selectExpr("ts", "true as iforest")
    got = combined_anomalies(df, "v", iforest=flags, layout=LAYOUT)
    assert got.columns == ["ts", "value", "zscore", "rolling", "iforest", "severity", "z_score"]
    assert got.count() == 60 and got.where("iforest").count() == 10

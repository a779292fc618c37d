import datetime as dt

from tidemark.operators import filters
from tidemark.operators.profile import histogram
from tidemark.operators.resample import interval_of, preprocess, resample
from tidemark.plans.positions import Layout
from tidemark.plans.session import scratch_path
from tidemark.sources.catalog import open_catalogue
from tidemark.sources.readings import MEASURES, find_time_column, read_readings
from tidemark.sources.sinks import write_result

RAW = """Date;Time;Global_active_power;Global_reactive_power;Voltage;Global_intensity;Sub_metering_1;Sub_metering_2;Sub_metering_3
16/12/2006;17:24:00;4.216;0.418;234.840;18.400;0.000;1.000;17.000
16/12/2006;17:25:00;?;?;?;?;?;?;?
16/12/2006;19:05:00;5.000;0.500;233.000;20.000;1.000;x;16.000
99/12/2006;17:26:00;1.000;0.100;230.000;4.000;0.000;0.000;0.000
17/12/2006;0:00:00;2.000;0.200;231.000;8.000;0.000;2.000;0.000
"""


def raw_file(spark):
    path = scratch_path(spark, "raw")
    spark.createDataFrame([(line,) for line in RAW.strip().splitlines()], "value string").coalesce(1).write.text(path)
    return path


def test_scan_coerces_and_keeps_every_row(spark):
    rows = read_readings(spark, raw_file(spark)).collect()
    assert len(rows) == 5
    assert sum(r["ts"] is None for r in rows) == 1
    first = next(r for r in rows if r["ts"] == dt.datetime(2006, 12, 16, 17, 24))
    assert first["Global_active_power"] == 4.216 and first["Sub_metering_3"] == 17.0
    assert next(r for r in rows if r["ts"] == dt.datetime(2006, 12, 16, 19, 5))["Sub_metering_2"] is None


def test_preprocess_fills_then_drops_empty_hours(spark):
    got = preprocess(read_readings(spark, raw_file(spark)), "H", layout=Layout("sliced", 3_600_000_000, 4)).orderBy("ts").collect()
    assert [r["ts"].hour for r in got] == [17, 19, 0]
    assert got[0]["Global_active_power"] == 4.216  # the missing minute took the earlier value
    assert got[0]["Sub_metering_3"] == 34.0 and got[1]["Sub_metering_2"] == 1.0


def test_resample_null_rules(spark):
    rows = [("2024-01-01 00:10", 1.0, None), ("2024-01-01 00:20", 3.0, None), ("2024-01-01 01:10", None, 5.0), (None, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "t string, m double, s double").selectExpr("cast(t as timestamp_ntz) ts", "m", "s")
    got = resample(df, "h", mean=["m"], total=["s"]).collect()
    assert [(r["m"], r["s"]) for r in got] == [(2.0, 0.0)]
    assert interval_of("15min") == "15 minute" and interval_of("D") == "1 day"


def test_date_range_ends_at_midnight(spark):
    df = spark.range(72).selectExpr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,cast(id as int)) ts")
    assert filters.date_range(df, "2024-01-02", "2024-01-03").count() == 25


def test_catalogue_reports_what_is_missing(spark):
    root = scratch_path(spark, "cat")
    write_result(spark.range(3).selectExpr("id", "timestamp_ntz'2024-01-01' as Datetime"), f"{root}/a")
    found = open_catalogue(spark, root, required=("a", "b"), optional=())
    assert found.missing == ["b"] and not found.tables
    found = open_catalogue(spark, root, required=("a",), optional=("c",))
    assert found.complete and set(found.tables) == {"a"} and "ts" in found.tables["a"].columns
    assert find_time_column(["x", "Datetime"]) == "Datetime" and find_time_column(["x", "y"]) == "x"
    assert len(MEASURES) == 7


def test_histogram_counts_every_value(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 2, 3, 4]], "v double")
    assert [r["count"] for r in histogram(df, "v", 4).orderBy("bin").collect()] == [2, 1, 1, 2]
    flat = spark.createDataFrame([(2.0,)] * 3, "v double")
    assert sum(r["count"] for r in histogram(flat, "v", 4).collect()) == 3

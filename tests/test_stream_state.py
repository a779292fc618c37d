import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.filters import last_rows
from tidemark.plans.session import scratch_path
from tidemark.streaming.sources import run_available, stream_files
from tidemark.streaming.state import adaptive_monitor, latest_tail, live_series, use_state_store

SCHEMA = "id long, meter string, ts timestamp_ntz, actual double, extra int"


def readings(n=400, seed=0):
    rng = np.random.default_rng(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        meter = rng.choice(["hot", "hot", "hot", "b", "c", None])
        actual = None if i % 37 == 0 else float(round(rng.normal(10, 2) + 30 * (i % 53 == 0), 3))
        rows.append((i, meter, start + dt.timedelta(minutes=int(rng.integers(0, 300))), actual, None if i % 5 else i))
    return rows


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(autouse=True)
def store(spark):
    use_state_store(spark)


@pytest.mark.parametrize("salts", [1, 3])
def test_tail_of_many_series_survives_restarts(spark, salts):
    rows = readings()
    path, out, state = (scratch_path(spark, n) for n in ("in", "views", "state"))
    for part in (rows[:150], rows[150:300], rows[300:]):  # every part is a run of its own from the same checkpoint
        write(spark, path, part)
        views = live_series(stream_files(spark, path, SCHEMA), keys=["meter"], n=20, tie=["id"], salts=salts)
        run_available(views, out, state)
    got = latest_tail(spark.read.parquet(out), keys=["meter"], n=20, tie=["id"])
    want = last_rows(spark.createDataFrame(rows, SCHEMA), 20, keys=["meter"], tie=["id"])
    columns = ["id", "meter", "actual", "extra"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def expanding(rows):
    """Count, mean and deviation of all earlier readings of the series, one reading after another."""
    seen, out = {}, {}
    for i, meter, _, v, _ in rows:
        before = seen.setdefault(meter, [])
        limit = np.mean(before) + 2.5 * np.std(before, ddof=1) if len(before) > 1 else None
        mean = float(np.mean(before)) if before else None
        out[i] = (mean, limit, "HIGH ALERT" if limit is not None and v is not None and v > limit else "Normal")
        if v is not None:
            before.append(v)
    return out


def test_moving_threshold_equals_an_expanding_window(spark):
    rows = readings(300, 1)
    parts = [sorted(rows[a : a + 100], key=lambda r: (r[2], r[0])) for a in (0, 100, 200)]
    path, out, state = (scratch_path(spark, n) for n in ("in", "status", "state"))
    for part in parts:
        write(spark, path, part)
        run_available(adaptive_monitor(stream_files(spark, path, SCHEMA), keys=["meter"], tie=["id"]), out, state)
    got = {r["id"]: r for r in spark.read.parquet(out).collect()}
    want = expanding([r for part in parts for r in part])
    assert len(got) == len(rows) and sum(w[2] != "Normal" for w in want.values()) >= 3
    for i, (mean, limit, status) in want.items():
        assert got[i]["status"] == status
        for have, ought in ((got[i]["predicted"], mean), (got[i]["threshold"], limit)):
            assert (have is None) == (ought is None) and (have is None or abs(have - ought) < 1e-9)


def test_empty_stream(spark):
    path, out, state = (scratch_path(spark, n) for n in ("in", "views", "state"))
    write(spark, path, [])
    run_available(live_series(stream_files(spark, path, SCHEMA), keys=["meter"]), out, state)
    assert spark.read.schema("meter string, salt int, seen long, tail array<struct<id:long,ts:timestamp>>").parquet(out).count() == 0


def until(condition, seconds=60):
    end = time.time() + seconds
    while not condition():
        assert time.time() < end, "the stream did not get there"
        time.sleep(0.5)


def test_rows_are_forgotten(spark):
    path, out, state = (scratch_path(spark, n) for n in ("in", "views", "state"))
    start = dt.datetime(2024, 1, 1)
    write(spark, path, [(i, "a", start + dt.timedelta(minutes=i), 1.0, None) for i in range(10)])
    views = live_series(stream_files(spark, path, SCHEMA), keys=["meter"], n=20, tie=["id"], ttl_ms=2000)
    query = views.writeStream.format("parquet").option("checkpointLocation", state).trigger(processingTime="1 second").start(out)
    told = spark.read.schema("meter string, salt int, seen long, tail array<struct<id:long,ts:timestamp>>")
    try:
        until(lambda: told.parquet(out).where("seen = 10").count() == 1)
        time.sleep(4)
        write(spark, path, [(i, "a", start + dt.timedelta(minutes=i), 1.0, None) for i in range(3, 6)])
        until(lambda: told.parquet(out).where("seen = 13").count() == 1)
    finally:
        query.stop()
    assert sorted(r["id"] for r in latest_tail(told.parquet(out), keys=["meter"], n=20, tie=["id"]).collect()) == [3, 4, 5]

import datetime as dt

from pyspark.sql import functions as F

from tidemark.plans.session import scratch_path
from tidemark.streaming.jobs import live_tail, live_view, monitor, resample_stream
from tidemark.streaming.sources import run_available, stream_files

SCHEMA = "id long, ts timestamp_ntz, actual double"


def write_files(spark, batches):
    path = scratch_path(spark, "live")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def at(hour, minute=0, day=1):
    return dt.datetime(2024, 1, day, hour, minute)


def test_late_rows_within_the_bound_count_and_later_ones_do_not(spark):
    batches = [
        [(1, at(0, 10), 1.0), (2, at(1, 30), 10.0)],
        [(3, at(0, 50), 3.0), (4, at(5, 0), 5.0)],  # 00:50 is late but within the hour
        [(7, at(6, 0), 6.0)],  # the bound that drops rows trails by one batch
        [(5, at(1, 40), 99.0), (6, at(9, 0), 9.0)],  # 01:40 is beyond the watermark of 04:00
    ]
    path = write_files(spark, batches)
    stream = stream_files(spark, path, SCHEMA, files_per_batch=1)
    out = scratch_path(spark, "out")
    run_available(resample_stream(stream, "h", mean=["actual"]), out, scratch_path(spark, "cp"))
    got = {r["ts"].hour: r["actual"] for r in spark.read.parquet(out).collect()}
    assert got == {0: 2.0, 1: 10.0, 5: 5.0, 6: 6.0}


def test_tail_over_many_batches(spark):
    batches = [[(i, at(i // 10, i % 10), float(i)) for i in range(k * 40, k * 40 + 40)] for k in range(4)]
    path = write_files(spark, batches)
    tail = scratch_path(spark, "tail")
    query = (
        stream_files(spark, path, SCHEMA, files_per_batch=1)
        .writeStream.foreachBatch(live_tail(tail, n=50))
        .option("checkpointLocation", scratch_path(spark, "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    last = spark.read.parquet(f"{tail}/v3")
    assert sorted(r["id"] for r in last.collect()) == list(range(110, 160))
    rolled, hist = live_view(last.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    assert rolled.where("rolling_mean_24 IS NOT NULL").count() == 27
    assert hist.agg(F.sum("count")).first()[0] == 50


def test_monitor_with_one_threshold(spark):
    df = spark.createDataFrame([(1.0, 2.0), (9.0, 7.0)], "actual double, predicted double")
    got = [(r["abs_error"], r["status"]) for r in monitor(df, 5.0).orderBy("actual").collect()]
    assert got == [(1.0, "Normal"), (2.0, "HIGH ALERT")]

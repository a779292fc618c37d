"""Live resampling, threshold monitor and live tail."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import last_rows
from ..operators.profile import histogram
from ..operators.resample import interval_of
from ..operators.rolling import trailing
from ..plans.positions import Layout
from ..sources.catalog import delete_path, path_exists

# Length of the live view, its rolling mean and its histogram.
LIVE_ROWS = 200
LIVE_WINDOW = 24
LIVE_BINS = 30
ALERT = "HIGH ALERT"
NORMAL = "Normal"


def monitor(
    stream: DataFrame, threshold: DataFrame | float, *, value: str = "actual", predicted: str = "predicted", keys: Sequence[str] = ()
) -> DataFrame:
    """Status of every reading as it arrives: absolute error, and an alert above the threshold.

    ``threshold`` is one number, or a static table of thresholds per series.
    """
    if isinstance(threshold, DataFrame):
        joined = stream.join(threshold, list(keys), "left")
    else:
        joined = stream.withColumn("threshold", F.lit(float(threshold)))
    over = F.col(value) > F.col("threshold")
    return joined.withColumns(
        {
            "abs_error": F.abs(F.col(value) - F.col(predicted)),
            "status": F.when(over, F.lit(ALERT)).otherwise(F.lit(NORMAL)),
        }
    )


def resample_stream(
    stream: DataFrame,
    freq: str = "h",
    *,
    keys: Sequence[str] = (),
    ts: str = "ts",
    mean: Sequence[str] = (),
    total: Sequence[str] = (),
    late: str = "1 hour",
) -> DataFrame:
    """Resample live readings. A bin is emitted once no reading may still arrive within ``late``."""
    bins = F.window(ts, interval_of(freq))
    aggs: list[Column] = [F.avg(c).alias(c) for c in mean] + [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in total]
    grouped = stream.withWatermark(ts, late).groupBy(*keys, bins.alias("__w")).agg(*aggs)
    out = grouped.select(*keys, F.col("__w.start").alias(ts), *mean, *total)
    return out.na.drop("any", subset=list(mean)) if mean else out


def live_tail(
    path: str, *, n: int = LIVE_ROWS, ts: str = "ts", tie: Sequence[str] = ()
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that keeps the last ``n`` readings below ``path``.

    Every batch writes its own version from the previous one, so a batch that runs again after a
    failure replaces only its own result. A batch whose previous version is gone fails; versions older
    than that are deleted.
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        previous = f"{path}/v{batch_id - 1}"
        rows = batch
        if batch_id > 0:
            if not path_exists(spark, previous):
                raise FileNotFoundError(f"the live tail's version {previous} is missing")
            rows = batch.unionByName(spark.read.schema(batch.schema).parquet(previous))
        last_rows(rows, n, ts=ts, tie=tie).write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        delete_path(spark, f"{path}/v{batch_id - 2}")

    return update


def live_view(tail: DataFrame, *, value: str = "actual", ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rolling mean and histogram of the live tail, whose length is fixed."""
    layout = Layout("sliced", 1 << 62)
    rolled = trailing(tail, value, [LIVE_WINDOW], stats=["mean"], include_current=True, ts=ts, layout=layout)
    return rolled, histogram(tail, value, LIVE_BINS)

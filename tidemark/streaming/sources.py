"""Streams of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_files(
    spark: SparkSession, folder: str, schema: T.StructType | str, *, glob: str | None = None, ts: str = "ts", files_per_batch: int | None = None
) -> DataFrame:
    """Stream the Parquet files of a folder; event time becomes a zoned timestamp, as watermarks need."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def run_available(df: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> None:
    """Process everything that has arrived into Parquet files, then stop."""
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()

"""Sinks: result tables, exports of a filtered view, models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.util import JavaMLWritable
from pyspark.sql import DataFrame, SparkSession

from ..operators.filters import date_range


def write_result(df: DataFrame, path: str, *, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """Replace the result table at ``path``."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def export_view(df: DataFrame, path: str, *, start=None, end=None, ts: str = "ts", columns: Sequence[str] = ()) -> str:
    """Write the rows of a date range as CSV."""
    view = date_range(df, start, end, ts=ts) if start is not None and end is not None else df
    return write_result(view.select(*columns) if columns else view, path, fmt="csv")


def save_model(model: JavaMLWritable, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(path)

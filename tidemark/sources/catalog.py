"""The folder of result tables: what is there, what is missing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .readings import with_time_column

# Result tables the report pages need, and those they can do without.
REQUIRED = ("processed_hourly", "featured_data", "anomalies", "model_comparison")
OPTIONAL = ("stl_components", "alert_log")


@dataclass
class Catalogue:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    missing: list[str] = field(default_factory=list)

    @property
    def complete(self) -> bool:
        return not self.missing


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system behind ``path``, whichever it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete ``path`` and what is below it, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def open_catalogue(
    spark: SparkSession, root: str, *, required: Sequence[str] = REQUIRED, optional: Sequence[str] = OPTIONAL
) -> Catalogue:
    """Open every table below ``root``. Nothing is opened while a required one is missing."""
    present = {t: path_exists(spark, f"{root}/{t}") for t in (*required, *optional)}
    missing = [t for t in required if not present[t]]
    if missing:
        return Catalogue(missing=missing)
    tables = {}
    for name, there in present.items():
        if there:
            df = spark.read.parquet(f"{root}/{name}")
            tables[name] = with_time_column(df) if name != "model_comparison" else df
    return Catalogue(tables=tables)


def available_predictions(spark: SparkSession, root: str, models: Sequence[str]) -> list[str]:
    """Models whose prediction table exists."""
    from ..functions.text import model_slug_text

    return [m for m in models if path_exists(spark, f"{root}/predictions_{model_slug_text(m)}")]

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Rows of one Arrow batch that a Python task holds as objects at a time.
SLICE_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


_DROPPED: list[Callable[[], None]] = []


def at_task_end(drop: Callable[[], None]) -> Callable[[], None]:
    """Registers what a module frees when a Python task ends."""
    _DROPPED.append(drop)
    return drop


def released(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``rows``; when they end, memory goes back to the system, as Spark reuses a worker for tasks of later stages."""
    try:
        yield from rows
    finally:
        for drop in _DROPPED:
            drop()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in the GNU library
        if trim is not None:
            trim(0)


def map_slices(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: T.StructType | str,
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows, so that a task never unpacks a whole batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = function(batch.slice(start, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(lambda batches: released(run(batches)), schema)


def free_name(taken: Sequence[str], name: str) -> str:
    """``name``, or ``name`` with underscores in front until no column of ``taken`` is called so."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def buckets_for(spark: SparkSession, least: int = 64) -> int:
    """Sub-buckets that split a hot key: as many as the session's shuffles have tasks, 64 at least."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ranked_in(df: DataFrame, group: str, bucket: str, order: Sequence[str], out: str) -> DataFrame:
    """``df`` with ``out``, the gapless rank from 0 in ``group``, counted per ``bucket`` so that a large group is split."""
    window = Window.partitionBy(group, bucket).orderBy(*[F.col(f"`{c}`") for c in order])
    earlier = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = df.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = before.withColumn("__n", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    ranked = df.withColumn(out, F.row_number().over(window).cast("long") - 1).join(before, [group, bucket])
    return ranked.withColumn(out, F.col(out) + F.col("__n")).drop("__n", bucket)

"""Shuffles of fixed-width records: packed by key range in the map tasks, sorted by numpy in the reduce tasks.

A record is a row of a numpy structured array with an unsigned 64-bit ``key``. Map tasks cut their records
into cells of equal key ranges and ship one binary row per cell; Spark deals cells over tasks and sorts them
by cell, and a reduce task holds the records of one cell at a time. Cells of hashed keys are even as long
as the map side keeps one record (or a bounded number) of a key per task, which each user of this module
must see to: that is its map-side combine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import released

# Bytes of records that a map task holds before it ships them, so its memory is bounded whatever its input.
HELD = 24_000_000


def cells_for(spark: SparkSession) -> int:
    """Twice the shuffle's tasks, 256 at least: raise ``spark.sql.shuffle.partitions`` with the data."""
    return max(256, 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def cell_of(keys: np.ndarray, cells: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)


def hashed(values: np.ndarray) -> np.ndarray:
    """Mixes the bits of unsigned 64-bit integers."""
    x = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def ship(
    df: DataFrame,
    make: Callable[[pa.RecordBatch], np.ndarray | None],
    cells: int,
    combine: Callable[[np.ndarray], np.ndarray] | None = None,
    rows: int = 256,
) -> DataFrame:
    """(cell, records) rows from the records that ``make`` gives for slices of ``df``.

    ``combine`` sees all records that a task ships at once, some ``HELD`` bytes, and returns those to ship.
    """

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        records = np.concatenate(held)
        if combine is not None:
            records = combine(records)
        if not len(records):
            return
        cell = cell_of(records["key"], cells).astype(np.uint16 if cells <= 1 << 16 else np.uint32)
        order = np.argsort(cell, kind="stable")
        records, cell = records[order], cell[order]
        edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
        blobs = [records[a:b].tobytes() for a, b in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(cell[edges[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["cell", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                made = make(batch.slice(start, rows))
                if made is not None and len(made):
                    held.append(made)
                    n += made.nbytes
                    if n >= HELD:
                        yield from packed(held)
                        held, n = [], 0
        if held:
            yield from packed(held)

    return df.mapInArrow(lambda batches: released(run(batches)), "cell int, records binary")


def gather(
    blobs: DataFrame,
    dtype: np.dtype,
    reduce: Callable[[np.ndarray], pa.RecordBatch | None],
    schema: T.StructType | str,
) -> DataFrame:
    """Rows that ``reduce`` makes of all records of one cell, for every cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            out = reduce(np.frombuffer(b"".join(held), dtype))
            if out is not None and out.num_rows:
                yield out

        for batch in batches:
            for cell, records in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and cell != current:
                    yield from done()
                    held = []
                current = cell
                held.append(records.as_py())
        if held:
            yield from done()

    spark = blobs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return blobs.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(lambda batches: released(run(batches)), schema)

"""Filters of fixed size that keep rows without a partner out of a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import map_slices
from .exchange import hashed

BITS = 1 << 23
PIECES = 64


def bit_of(docs: pa.Array) -> np.ndarray:
    return (hashed(docs.to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)


def bitmap(ids: DataFrame) -> np.ndarray:
    """Which hashes of the ids (one long column) occur: ``BITS`` flags, whatever the data. A full one lets every row through, which costs time only."""

    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = np.unique(bit_of(batch.column(0)))
        return pa.RecordBatch.from_arrays([pa.array((at // (BITS // PIECES)).astype(np.int32)), pa.array(at)], names=["piece", "at"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                marks.setdefault(piece, np.zeros(BITS // PIECES, bool))[at % (BITS // PIECES)] = True
        if marks:
            packed = [np.packbits(m).tobytes() for m in marks.values()]
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int32()), pa.array(packed, pa.binary())], names=["piece", "flags"])

    found = map_slices(ids, places, "piece int, at long", rows=10_000)
    bits = np.zeros(BITS, np.uint8)
    for row in found.repartition(PIECES, "piece").mapInArrow(mark, "piece int, flags binary").collect():
        start = row["piece"] * (BITS // PIECES)
        bits[start : start + BITS // PIECES] = np.unpackbits(np.frombuffer(row["flags"], np.uint8))
    return bits


def with_flag(df: DataFrame, bits: Broadcast, flag: bool = True) -> DataFrame:
    """Rows of ``df`` whose first column's flag is set (or is not)."""

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(bits.value[bit_of(batch.column(0))].astype(bool) == flag))

    return map_slices(df, keep, df.schema, rows=2048)

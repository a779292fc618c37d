"""Shards of near equal bytes: best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts form a group that stays together. Group sizes are known after one aggregate
over text digests; only the histogram of sizes reaches the driver. Sizes up to ``EXACT`` are exact
classes, larger ones share a class with those at most one part in 2048 smaller, which bounds the
classes whatever the table holds (some 100,000 rows at most). A class packs by its largest size, so bins
differ from the plan by less than one part in 2048.

The bins' free room lies in a sorted list (a balanced tree's order, searched by bisection): a run of
equal groups goes to the tightest bin that still takes one, and fills it before the next. ``pack_into``
asks for the fewest bins of a given capacity; ``near_equal`` for the smallest capacity that a given
number of bins allows. A group larger than the capacity gets a bin of its own. Each group then finds its
bin from its rank within its class, and documents theirs from their text's digest.

Null texts have size 1 like empty ones and are equal to them. Repeated rows are placed each.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize
from .common import buckets_for, free_name, map_slices, ranked_in, text_or_empty

EXACT = 1 << 14
STEPS = 2048


def best_fit_decreasing(runs: Sequence[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int]] | None:
    """Places for ``runs`` of (size, number): (size, number, bin) in the order of packing.

    Opens bins as needed, or None if more than ``bins`` would be needed.
    """
    free: list[tuple[int, int]] = []  # (room, bin), sorted
    opened = 0
    out = []
    for size, number in sorted(runs, reverse=True):
        while number:
            at = bisect_left(free, (size, -1))
            if at == len(free):
                if bins is not None and opened == bins:
                    return None
                insort(free, (max(capacity, size), opened))
                opened += 1
                continue
            room, which = free.pop(at)
            used = min(number, room // size)
            out.append((size, used, which))
            insort(free, (room - used * size, which))
            number -= used
    return out


def pack_into(runs: Sequence[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """As few bins of ``capacity`` as best-fit decreasing needs."""
    return best_fit_decreasing(runs, capacity) or []


def near_equal(runs: Sequence[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """The packing into ``bins`` bins with the smallest capacity that best-fit decreasing manages."""
    total = sum(s * n for s, n in runs)
    if not total:
        return []
    rest, left = total, bins
    for size, number in sorted(runs, reverse=True):  # a group above the mean of what is left has a bin of its own
        while number and left > 1 and size * left > rest:
            rest, left, number = rest - size, left - 1, number - 1
        if number:
            break
    low = high = max(-(-rest // left), 1)
    while best_fit_decreasing(runs, high, bins) is None:
        high = high + max(high // 64, 1)
    for _ in range(40):
        if low >= high:
            break
        middle = (low + high) // 2
        if best_fit_decreasing(runs, middle, bins) is None:
            low = middle + 1
        else:
            high = middle
    return best_fit_decreasing(runs, high, bins) or []


def shard(df: DataFrame, shards: int = 8, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, size, text_crc32, shard and slot for every row of ``df``."""
    spark = df.sparkSession
    keep = [c for c in keep if c not in ("size", "text_crc32", "shard", "slot", "bucket")]
    size, crc, digest = "size", "text_crc32", free_name(keep, "digest")
    rows = materialize(
        df.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text).alias("__text")).select(
            *[F.col(f"`{c}`") for c in keep],
            (F.octet_length("__text") + 1).cast("long").alias(size),
            F.crc32(F.col("__text").cast("binary")).alias(crc),
            F.unhex(F.md5("__text")).alias(digest),
        ),
        "sizes",
    )
    groups = rows.groupBy(digest, size, crc).agg(F.sum(size).alias("bytes"))
    step = f"shiftleft(1L, length(bin(bytes)) - {STEPS.bit_length()})"
    kind = F.expr(f"CASE WHEN bytes <= {EXACT} THEN bytes ELSE (bytes + {step} - 1) div {step} * {step} END")
    groups = groups.withColumns({"class": kind, "bucket": F.pmod(F.xxhash64(digest), F.lit(buckets_for(spark)))})
    groups = materialize(groups, "groups")
    runs = [(r["class"], r["n"]) for r in groups.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()]  # bounded, see above
    classes, starts, bins = _intervals(near_equal(runs, shards))

    ranked = ranked_in(groups, "class", "bucket", [digest, size, crc], "rank")

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
        at = np.searchsorted(starts, np.searchsorted(classes, kind) * (1 << 44) + rank, side="right") - 1
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bins[at])], names=[digest, size, crc, "shard"])

    ranked = ranked.select(digest, size, crc, "class", "rank")
    placed = map_slices(ranked, place, ranked.select(digest, size, crc, F.lit(0).alias("shard")).schema, rows=50_000)
    split = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in keep], digest), F.lit(buckets_for(spark)))
    joined = materialize(rows.join(placed, [digest, size, crc]).withColumn("bucket", split).drop(digest), "placed")
    out = ranked_in(joined, "shard", "bucket", [*keep, crc, size], "slot")
    return out.select(*[F.col(f"`{c}`") for c in keep], size, crc, "shard", "slot")


def _intervals(placed: Sequence[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted classes; class index << 44 | first rank of each run; the run's bin."""
    classes = np.array(sorted({size for size, _, _ in placed}), np.int64)
    index = {size: i for i, size in enumerate(classes.tolist())}
    used = dict.fromkeys(index, 0)
    rows = []
    for size, number, which in placed:
        rows.append(((index[size] << 44) + used[size], which))
        used[size] += number
    rows.sort()
    return classes, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32)

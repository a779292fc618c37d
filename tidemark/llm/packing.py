"""Best-fit packing of token pieces into sequences by exact complements.

The lengths are at most ``capacity``, so their histogram is bounded and is all the driver sees. The
planner works on that histogram: for each length, longest first, it looks up a single length, a pair
or a triple whose sum is exactly the gap, consumes the combination as often as its lengths last, and
packs what has no exact complement by best fit. A plan is a list of (lengths, times). Spark then ranks
the pieces of each length (ranks are counted per bucket, so a length that holds most rows is split) and
each piece finds its place from its rank.

Null texts count as empty. Pieces without a length between 1 and ``capacity`` raise.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize
from .common import SLICE_ROWS, buckets_for, free_name, map_slices, ranked_in, released

CAPACITY = 2048
# Parts that a task's memo holds, twice over; the memo goes when the task ends, so later stages have the worker's memory.
MEMO = 400_000


# -- planning on the histogram --


class ComplementIndex:
    """Available lengths, asked for one, two or three of them with a given sum."""

    def __init__(self, available: np.ndarray):
        self.left = available
        present = (available > 0).astype(float)
        size = 2 * len(present)
        spectrum = np.fft.rfft(present, size)
        self.pair_sums = np.fft.irfft(spectrum * spectrum, size) > 0.5  # lengths only run out: never misses a sum

    def single(self, gap: int, most: int) -> tuple[int, ...] | None:
        return (gap,) if 0 < gap <= most and self.left[gap] > 0 else None

    def pair(self, gap: int, most: int) -> tuple[int, ...] | None:
        """The most uneven pair, longest first."""
        if gap < 2 or not self.pair_sums[gap]:
            return None
        a = np.arange(min(gap - 1, most), (gap - 1) // 2, -1)
        b = gap - a
        found = np.flatnonzero((self.left[a] > 0) & (self.left[b] > (a == b)))
        return (int(a[found[0]]), int(b[found[0]])) if found.size else None

    def triple(self, gap: int, most: int) -> tuple[int, ...] | None:
        first = np.arange(min(gap - 2, most), (gap - 1) // 3, -1)
        for a in first[(self.left[first] > 0) & self.pair_sums[gap - first]] if first.size else ():
            self.left[a] -= 1
            rest = self.pair(gap - int(a), int(a))
            self.left[a] += 1
            if rest:
                return (int(a), *rest)
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences); every length is used as often as it occurs."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    index = ComplementIndex(left)
    made: list[tuple[tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        while left[length]:
            left[length] -= 1
            gap = capacity - length
            rest = () if gap == 0 else index.single(gap, length) or index.pair(gap, length) or index.triple(gap, length)
            left[length] += 1
            if rest is None:
                break
            lengths = (length, *rest)
            times = min(int(left[x]) // n for x, n in Counter(lengths).items())
            for x in lengths:
                left[x] -= times
            made.append((lengths, times))
    return made + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over runs of equal lengths; open sequences are runs of equal content."""
    open_at: dict[int, list[list]] = {}  # gap -> [lengths, times]
    gaps: list[int] = []  # sorted, those with open runs

    def add(lengths: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in open_at:
            open_at[gap] = []
            insort(gaps, gap)
        open_at[gap].append([lengths, times])

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    add((length,) * each, full)
                if rest:
                    add((length,) * rest, 1)
                break
            gap = gaps[at]
            lengths, times = open_at[gap][-1]
            each = gap // length  # a sequence that took one is the tightest for the next
            used = min(times, n // each)
            if used == 0:
                used, each = 1, n
            if used == times:
                open_at[gap].pop()
                if not open_at[gap]:
                    del open_at[gap]
                    gaps.pop(at)
            else:
                open_at[gap][-1][1] -= used
            add(lengths + (length,) * each, used)
            n -= used * each
    return [(lengths, times) for runs in open_at.values() for lengths, times in runs]


# -- places for the pieces --


def pack(df: DataFrame, ids: Sequence[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``df`` with ``sequence_id`` and ``offset``. ``ids`` names a row; equal ids are told apart by their other columns.

    ``df`` is read three times: pass a written table.
    """
    spark = df.sparkSession
    own = F.least(F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0)), F.lit(capacity + 1))
    counts = df.groupBy(F.greatest(own, F.lit(0)).alias("length")).count().collect()  # at most ``capacity`` + 2 rows
    if any(not 1 <= r["length"] <= capacity for r in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    start_key, start_seq, offsets = _slots(plan({r["length"]: r["count"] for r in counts}, capacity))

    taken = df.columns
    bucket, rank = (free_name(taken, n) for n in ("bucket", "rank"))
    split = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in ids]), F.lit(buckets_for(spark)))
    rows = df.withColumn(bucket, split)
    joined = ranked_in(rows, length, bucket, [*ids, *(c for c in taken if c not in (*ids, length))], rank)
    key = F.col(length).cast("long") * F.lit(1 << 44) + F.col(rank)
    placed = joined.select(*[F.col(f"`{c}`") for c in taken if c not in ("sequence_id", "offset")], key.alias(rank))
    names = [*placed.columns[:-1], "sequence_id", "offset"]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        at = np.searchsorted(start_key, keys, side="right") - 1
        seq = start_seq[at] + keys - start_key[at]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(offsets[at])], names=names)

    schema = placed.drop(rank).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return map_slices(placed, place, schema, rows=100_000)


def _slots(made: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of equal places: length << 44 | first rank, first sequence, offset; sorted."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for lengths, times in made:
        offset = 0
        for length in lengths:
            rows.append((length * (1 << 44) + used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    table = np.array(sorted(rows) or [(0, 0, 0)], np.int64)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()


# -- token pieces --


# Parts of only these characters have plain units: composed already, one lower-case letter per letter.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+").fullmatch
_UNITS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+").findall


def _byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if printable, else the next from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordTokenizer:
    """Ids of a text from memoised ids of its parts between blanks: merges and normalising never cross a blank.

    A part of plain characters is cut into its units as the tokenizer's own pattern does, and the
    tokenizer's model encodes each unit; any other part goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.older_units: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        found = self.older_units.get(unit)
        if found is None:
            letters = unit if unit.isascii() else "".join(map(self.letters.__getitem__, unit.encode()))
            ids = [t.id for t in self.model.tokenize(letters)]
            found = pack_ids(f"<{len(ids)}I", *ids)
        if len(self.units) >= MEMO:
            self.units, self.older_units = {}, self.units
        self.units[unit] = found
        return found

    def _part(self, part: str) -> bytes:
        if _PLAIN(part) and "<|" not in part:  # no special token
            return b"".join([self.units.get(u) or self._unit(u) for u in _UNITS(part.lower())])
        ids = self.tokenizer.encode(part, add_special_tokens=False).ids if part else ()
        return pack_ids(f"<{len(ids)}I", *ids)

    def forget(self) -> None:
        for memo in (self.memo, self.older, self.units, self.older_units):
            memo.clear()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        parts = text.replace("\n", " ").split(" ")
        memo, older, large = self.memo, self.older, []
        for part in [p for p in parts if p not in memo]:
            memo[part] = older.get(part) or self._part(part)
            if len(part) > 64:
                large.append(part)
        out = b"".join(map(memo.__getitem__, parts))
        for part in large:
            memo.pop(part, None)
        if len(memo) >= MEMO:  # what was not used since the last turn goes
            self.memo, self.older = {}, memo
        return out


@lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    """The tokenizer, read once per worker process."""
    return WordTokenizer(path)


def token_pieces(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Documents cut into pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids (little-endian unsigned 32-bit)."""
    last = end_id.to_bytes(4, "little")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = load(tokenizer).ids(text or "") + last
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc, piece, at // 4, len(part) // 4, part))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE_ROWS):
                    yield cut(batch.slice(start, SLICE_ROWS))
        finally:
            load(tokenizer).forget()

    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: released(run(batches)), f"doc_id {kind}, piece int, start long, length long, ids binary")


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, digest: Column | None = None) -> DataFrame:
    """Token pieces of ``df`` with their places. ``digest`` (an expression over ids) replaces the ids, which are then not written."""
    pieces = token_pieces(df, tokenizer, capacity=capacity)
    if digest is not None:
        pieces = pieces.select("doc_id", "piece", "start", "length", digest)
    return pack(materialize(pieces, "pieces"), ["doc_id", "piece"], capacity=capacity)


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """sequence_id and the joined ids of its pieces; a sequence has at most ``capacity`` pieces."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", ids)))
    joined = F.aggregate(pieces, F.lit(b""), lambda done, piece: F.concat(done, piece[ids]))
    return packed.groupBy("sequence_id").agg(joined.alias(ids))

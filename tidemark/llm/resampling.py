"""Importance resampling towards a target corpus, with CRC-32 features from position tables.

Words are runs of digits, letters a-z (A-Z count as a-z) and characters beyond ASCII; a feature is a run of 1 to
``longest`` words joined by one space, and falls into bucket ``crc32(feature) % buckets``. A bucket's gain is the floored
log ratio of its smoothed share among the target texts to that among all texts; a text's weight is the floored mean of its
features' gains. Gumbel noise from a hash of the id is added, and the texts with the highest scores are drawn.

CRC-32 is linear over XOR: the value of a span is the XOR of one table entry for each byte, looked up by the byte and its
distance from the span's end, and a constant of the span's length. So the features of many texts take one gather and one
``bitwise_xor.reduceat`` over their spans. The table reaches back ``REACH`` bytes; a longer span is cut into blocks of that
many bytes from its end, and each block's value is moved on by a table of four times 256 entries and folded into the next.

Counts cover all rows of both tables: every task sums its own buckets, so ``buckets`` rows at most reach the driver. Ranks
come from exact counts per score; scores are integers bounded by the gains and the noise, so their number does not grow
with the rows.

Null and empty texts have no features and weight 0. Null ids share one noise value and rank first among equal scores; rows
with equal ids and scores rank by their number of features, and arbitrarily among equal rows. Empty tables count nothing.
Only the id and text columns are read, so other columns may have any names. Equal rows count and rank each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import materialize
from .common import map_slices

BUCKETS = 10_000
REACH = 64
POLYNOMIAL = 0xEDB88320

# -- CRC-32 of many spans --


@cache
def _steps() -> np.ndarray:
    """The byte table: what one more byte does to the low byte of a register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def _zero_byte(register: np.ndarray) -> np.ndarray:
    return _steps()[register & 0xFF] ^ (register >> np.uint32(8))


@cache
def _positions() -> np.ndarray:
    """Contribution of a byte by its distance from the end of its span: ``REACH`` rows of 256."""
    rows = [_steps()]
    for _ in range(REACH - 1):
        rows.append(_zero_byte(rows[-1]))
    return np.concatenate(rows)


@cache
def _block_shift() -> np.ndarray:
    """Registers moved on by ``REACH`` zero bytes, for each value of each of their four bytes."""
    out = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(REACH):
        out = _zero_byte(out)
    return out


def _moved(register: np.ndarray) -> np.ndarray:
    shift = _block_shift()
    return shift[0][register & 0xFF] ^ shift[1][(register >> 8) & 0xFF] ^ shift[2][(register >> 16) & 0xFF] ^ shift[3][register >> 24]


@cache
def _length_constants(n: int) -> np.ndarray:
    """CRC-32 of 0 to n - 1 zero bytes: what a span's length adds."""
    return np.array([crc32(bytes(k)) for k in range(n)], np.uint32)


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[starts[i]:ends[i]]``; spans may overlap and be empty."""
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint32)
    short = lengths <= REACH
    whole = np.flatnonzero(short & (lengths > 0))
    out[whole] = _linear(data, starts[whole], ends[whole])
    out[short] ^= _length_constants(REACH + 1)[lengths[short]]
    for i in np.flatnonzero(~short):
        out[i] = _long_span(data[starts[i] : ends[i]])
    return out


def _linear(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The part that the bytes of each span add; spans hold 1 to ``REACH`` bytes."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    back = np.repeat(lengths, lengths) - 1 - at
    return np.bitwise_xor.reduceat(_positions()[(back << 8) + data[np.repeat(starts, lengths) + at]], first)


def _long_span(span: np.ndarray) -> int:
    """A span of more than ``REACH`` bytes: blocks from its end, the first one shorter; blocks fold in pairs."""
    edges = np.arange(len(span), -1, -REACH)[::-1]
    if edges[0]:
        edges = np.r_[0, edges]
    register = np.zeros(1, np.uint32)
    for value in _linear(span, edges[:-1], edges[1:]):
        register = _moved(register) ^ value
    return int(register[0]) ^ _zeros_crc(len(span))


def _zeros_crc(n: int) -> int:
    """CRC-32 of n zero bytes, blockwise."""
    register = np.array([0xFFFFFFFF], np.uint32)
    for _ in range(n // REACH):
        register = _moved(register)
    for _ in range(n % REACH):
        register = _zero_byte(register)
    return int(register[0]) ^ 0xFFFFFFFF


# -- features --

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def features(texts: Sequence[str | None], longest: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, text after text; the number of features and of words of each text."""
    raw = [b"" if not t else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(_WORD[joined].view(np.int8), prepend=0))
    starts, ends = edge[0::2], edge[1::2]
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    at = np.searchsorted(starts, begins)
    words = np.diff(at)
    if longest == 1:
        return (span_crcs(joined, starts, ends) % np.uint32(buckets)).astype(np.int64), words, words
    # words put side by side with one space after each, so that a run of words is one span
    lengths = ends - starts + 1
    new_starts = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(new_starts, lengths)
    tight = np.append(joined, 32)[np.repeat(starts, lengths) + within]
    tight[new_starts + lengths - 1] = 32
    new_ends = new_starts + lengths - 1
    found, owner = [], []
    text_of = np.repeat(np.arange(len(raw)), words)
    for n in range(1, longest + 1):
        last = len(starts) - n + 1
        inside = np.flatnonzero(text_of[:last] == text_of[n - 1 :]) if last > 0 else np.zeros(0, np.int64)
        found.append(span_crcs(tight, new_starts[inside], new_ends[inside + n - 1]) % np.uint32(buckets))
        owner.append(text_of[inside])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.bincount(owners, minlength=len(raw)), words


# -- on Spark --


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (one string column) fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                n += np.bincount(features(batch.column(0).slice(start, 256).to_pylist(), longest, buckets)[0], minlength=buckets)
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln) of the smoothed share among target features over that among raw ones."""
    n, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    ratios = ((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(raw.tolist(), target.tolist()))
    return np.array([math.floor(scale * math.log(r)) for r in ratios], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of every text's features."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, n, words = features(batch.column(1).to_pylist(), longest, len(gain))
        total = np.r_[0, np.cumsum(gain[found])]
        at = np.r_[0, np.cumsum(n)]
        weight = np.where(n > 0, (total[at[1:]] - total[at[:-1]]) // np.maximum(n, 1), 0)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    long = F.lit(0).cast("long")
    return map_slices(rows, run, rows.select("doc_id", *[long.alias(c) for c in ("n_words", "n_features", "weight")]).schema)


def noise(doc_id: Column, seed: int, scale: int = 1000) -> Column:
    """floor(scale * Gumbel noise) from the first 32 bits of sha256(seed:id)."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(head, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(scale)) * F.log(-F.log(u)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, least_words: int = 20, buckets: int = BUCKETS, seed: int = 2024
) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs`` (doc_id, text); undrawn rows have no rank.

    ``target`` (text) shows what the drawn texts should be like. ``percent`` of the texts of at least ``least_words``
    words are drawn.
    """
    text = F.col("text").cast("string").alias("text")
    gain = gains(bucket_counts(docs.select(text), longest, buckets), bucket_counts(target.select(text), longest, buckets))
    scored = weigh(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialize(scored.withColumn("part", F.col("n_words") >= least_words), "scored")
    counts = materialize(scored.where("part").groupBy("score").agg(F.count(F.lit(1)).alias("n")), "scores")
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = (percent * (counts.agg(F.sum("n")).first()[0] or 0)) // 100
    # one row for each distinct score: integers within the gains' and the noise's range, however many texts there are
    places = counts.select("score", F.lit(True).alias("part"), before.alias("before")).where(F.col("before") < drawn)
    in_score = Window.partitionBy("score").orderBy("doc_id", "n_features")
    reach = scored.where("part").join(F.broadcast(places), ["score", "part"])
    ranked = reach.withColumn("rank", F.col("before") + F.row_number().over(in_score))
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.join(F.broadcast(places.select("score", "part")), ["score", "part"], "left_anti")
    return ranked.select(*columns, rank).unionAll(rest.select(*columns, F.lit(None).cast("long").alias("rank")))

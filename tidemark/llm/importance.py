"""Quality selection by importance resampling.

Words and word pairs of a text are hashed into ``BUCKETS`` buckets. Two generative models are fitted, one on
target texts and one on all texts: smoothed bucket frequencies. A text's log weight is the sum of
log(target / raw) over its n-grams, which is the log ratio of its likelihoods. Gumbel top-k samples without
replacement in proportion to the weights: a text's key is its log weight plus Gumbel noise drawn from a hash
of its id, and the k largest keys are selected. k is a share of the rows.

Bucket counts are summed in each task and then over tasks, so ``BUCKETS`` rows reach the driver. The target
model may be fitted on a bounded sample of labelled rows (``max_target``); raw counts, weights and ranks cover
every row. Ranks come from exact counts per key range, not from a sort in one task.

Null and empty texts have no n-grams and weight 0. Null ids share one noise value. Rows equal in id and
text have equal keys; ties rank by id and then arbitrarily among equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize
from .common import map_slices, ranked_in
from .exchange import hashed

BUCKETS = 10_000
MAX_TARGET = 20_000
SHARE = 0.87
RANGES = 256


def grams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every word and of every pair of neighbours."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    one = np.fromiter(map(crc32, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    return (hashed(np.concatenate([one, two + np.uint64(1 << 40)])) % np.uint64(buckets)).astype(np.int64)


def fit(df: DataFrame, targets: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(target / raw) for each bucket. ``targets`` (doc_id) must be small enough to send to every task."""
    marked = df.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(targets.select("doc_id", F.lit(True).alias("hit"))), "doc_id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for text, hit in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if text:
                        n = np.bincount(grams(text, buckets), minlength=buckets)
                        raw += n
                        if hit:
                            target += n
        used = np.flatnonzero(raw)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    counts = marked.select("text", "hit").mapInArrow(count, "bucket long, raw long, target long")
    total = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # ``buckets`` rows at most
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in total:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def target_ids(labels: DataFrame, most: int = MAX_TARGET) -> DataFrame:
    """Up to ``most`` ids of good texts, by the order of a hash."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def weigh(df: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, n_grams, log_weight."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [grams(t or "", len(ratio)) for t in batch.column(1).to_pylist()]
        weights = [float(ratio[g].sum()) for g in found]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(g) for g in found], pa.int64()), pa.array(weights, pa.float64())], names=["doc_id", "n_grams", "log_weight"])

    rows = df.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_slices(rows, run, rows.select("doc_id", F.lit(0).cast("long").alias("n_grams"), F.lit(0.0).alias("log_weight")).schema)


def select(df: DataFrame, labels: DataFrame, share: float = SHARE, max_target: int = MAX_TARGET, buckets: int = BUCKETS, seed: int = 0) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key, rank (from 1), selected, for every row of ``df`` (doc_id, text)."""
    weights = weigh(df, fit(df, target_ids(labels, max_target), buckets))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / float(1 << 53)
    keyed = materialize(weights.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))), "keys")
    total = keyed.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("gumbel_key", [i / RANGES for i in range(1, RANGES)], 10_000).alias("cuts")).first()
    cuts = F.array(*[F.lit(c) for c in sorted(set(total["cuts"] or []))]).cast("array<double>")
    rows = keyed.withColumns({"all": F.lit(0), "range": F.size(F.filter(cuts, lambda c: c > F.col("gumbel_key"))), "minus": -F.col("gumbel_key")})
    ranked = ranked_in(rows, "all", "range", ["minus", "doc_id"], "rank")
    rank = F.col("rank") + 1
    return ranked.select("doc_id", "n_grams", "log_weight", "gumbel_key", rank.alias("rank"), (rank <= round(share * total["n"])).alias("selected"))

"""Isolation forest (Liu, Ting, Zhou 2008) as a Spark job.

Rows are drawn for the trees by hash, every tree grows in its own task from at most
``sample_size`` rows, and the table is scored in batches against the grown trees, whose number of
nodes is bounded by the parameters and does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.quantiles import exact_quantiles
from ..plans.session import materialize

NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, size int, depth int"


def average_path(n):
    """Mean depth of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def draw_samples(df: DataFrame, features: Sequence[str], ids: Sequence[str], trees: int, sample_size: int, seed: int) -> DataFrame:
    """Rows per tree, without replacement within a tree: ``tree`` and the features.

    Each tree has its own hash of every row, and takes the rows with the lowest. Rows above a limit that
    about a third more than ``sample_size`` rows pass are left out before the shuffle.
    """
    n = df.count()
    rows = df.select(*features, F.xxhash64(*ids, F.lit(seed)).alias("__h"))
    limit = np.uint64(min(1.35 * sample_size / max(n, 1), 1.0) * (2**64 - 2**11))
    own = _mixed(np.arange(1, trees + 1, dtype=np.uint64))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            for tree in range(trees):
                rank = _mixed(h ^ own[tree])
                at = np.flatnonzero(rank <= limit)
                if len(at):
                    part = batch.take(pa.array(at))
                    columns = [*part.columns[:-1], pa.array(rank[at].view(np.int64)), pa.array(np.full(len(at), tree, np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "__rank", "tree"])

    schema = rows.drop("__h").withColumns({"__rank": F.lit(0).cast("long"), "tree": F.lit(0)}).schema
    lowest = F.col("__rank").bitwiseXOR(F.lit(-(1 << 63)))  # as unsigned
    order = Window.partitionBy("tree").orderBy(lowest, *features)
    drawn = rows.mapInArrow(draw, schema).withColumn("__r", F.row_number().over(order))
    return drawn.where(F.col("__r") <= sample_size).drop("__r", "__rank")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree as (node, feature, cut, left, right, size, depth); leaves have feature -1."""
    nodes: list[list] = []
    stack = [(rows, 0, None, "")]
    while stack:
        part, depth, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(part), depth])
        if parent is not None:
            nodes[parent][3 if side == "l" else 4] = me
        lo, hi = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(part) <= 1 or len(usable) == 0:
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        nodes[me][1:3] = [f, cut]
        below = part[:, f] <= cut
        stack.append((part[~below], depth + 1, me, "r"))
        stack.append((part[below], depth + 1, me, "l"))
    return [tuple(x) for x in nodes]


def grow_forest(
    df: DataFrame, features: Sequence[str], ids: Sequence[str], *, trees: int = 200, sample_size: int = 256, seed: int = 42
) -> pd.DataFrame:
    """Node table of the forest. At most ``trees * 2 * sample_size`` rows reach the driver."""
    limit = int(np.ceil(np.log2(max(sample_size, 2))))
    columns = list(features)
    names = [part.split()[0] for part in NODE_SCHEMA.split(", ")]

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        rows = pdf.sort_values(columns)[columns].to_numpy(float)
        nodes = _grow(rows, np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=names)

    samples = draw_samples(df, features, ids, trees, sample_size, seed)
    return samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()


def score(df: DataFrame, features: Sequence[str], forest: pd.DataFrame, *, sample_size: int, name: str = "score") -> DataFrame:
    """Anomaly score of every row: near 1 is isolated early, near 0.5 is ordinary."""
    packed = []
    for _, nodes in forest.sort_values(["tree", "node"]).groupby("tree"):
        packed.append(tuple(nodes[c].to_numpy() for c in ("feature", "cut", "left", "right", "size", "depth")))
    shared = df.sparkSession.sparkContext.broadcast(packed)
    used = min(sample_size, int(forest.loc[forest["depth"] == 0, "size"].max()))
    columns = list(features)

    @F.pandas_udf("double")
    def path_score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in parts:
            x = pdf.to_numpy(float)
            rows = np.arange(len(x))
            depth_sum = np.zeros(len(x))
            for feature, cut, left, right, size, depth in shared.value:
                at = np.zeros(len(x), dtype=int)
                for _ in range(int(depth.max())):
                    f = feature[at]
                    go_left = x[rows, np.maximum(f, 0)] <= cut[at]
                    at = np.where(f < 0, at, np.where(go_left, left[at], right[at]))
                depth_sum += depth[at] + average_path(size[at])
            yield pd.Series(np.power(2.0, -depth_sum / len(shared.value) / float(average_path(used))))

    return df.withColumn(name, path_score(F.struct(*[F.col(c).cast("double").alias(c) for c in columns])))


def detect_isolation_forest(
    df: DataFrame,
    features: Sequence[str],
    *,
    ids: Sequence[str] = ("ts",),
    contamination: float = 0.01,
    trees: int = 200,
    sample_size: int = 256,
    seed: int = 42,
    flag: str = "iforest",
) -> DataFrame:
    """Flag the ``contamination`` share of rows that are isolated first.

    Rows with a missing feature are not scored and not returned; bring flags back to all rows with
    ``align_flags``. The threshold is the exact quantile of the scores.
    """
    complete = df.na.drop("any", subset=list(features))
    forest = grow_forest(complete, features, ids, trees=trees, sample_size=sample_size, seed=seed)
    # Written once: the quantile reads the scores several times, and scoring runs in Python.
    scored = materialize(score(complete, features, forest, sample_size=sample_size), "scores")
    cut = exact_quantiles(scored.select("score"), "score", [1 - contamination]).select("quantile").scalar()
    return scored.withColumn(flag, F.col("score") > cut)

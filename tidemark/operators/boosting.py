"""Boosted regression trees on histograms, with one value per output in every leaf.

Squared loss with gradient and Hessian sums: a split gains G * G / (H + penalty) of its sides over that of the node, summed
over the outputs, and a leaf holds rate * G / (H + penalty). So one tree serves all steps of a forecast. Each tree sees one
sample of the rows (by hash) and one sample of the columns.

Columns are cut once at approximate quantiles. Rows live in blocks of binned columns, targets and current predictions. A tree
grows level by level: each task adds up the histograms of its rows for all open nodes, one aggregate sums them by (node, column)
and finds each column's best split, and the driver picks a node's best column. A node of at most ``node_rows`` rows is instead
sent to one task, which grows all below it by the same rule (the in-memory stage of PLANET, Panda et al. 2009), so the number of jobs
follows from depth and data, not from the number of nodes. Where the root is such a node, the task goes on to the next trees. Neither histograms nor rows reach the driver.

Blocks carry predictions from tree to tree and are written to the shared folder every ``CHECKPOINT`` trees.

Null and NaN columns go left at every split. Rows with a null target (or a null among the outputs) train nothing. Equal rows of
equal ``ids`` are drawn together. Ties between splits go to the first column and the lowest cut.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize, scratch_path

# Training parameters of the boosted model, and of the one for many steps.
BOOSTED = {"rounds": 500, "depth": 7, "rate": 0.05, "row_share": 0.8, "column_share": 0.8, "seed": 42}
MULTI_STEP = {**BOOSTED, "rounds": 300, "depth": 6}

BINS = 256
PENALTY = 1.0
LEAST_WEIGHT = 1.0
BLOCK_ROWS = 8_192
CELLS = 4_000_000
NODE_ROWS = 65_536
CHECKPOINT = 50


@dataclass
class Tree:
    """Nodes as arrays, the root first. Rows with bin <= cut_bin (value <= cut) go left; leaves have left -1."""

    feature: np.ndarray
    cut_bin: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray  # (nodes, outputs)

    def leaf_of(self, columns: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        at = np.zeros(len(columns), np.int64)
        rows = np.arange(len(columns))
        while True:
            inner = self.left[at] >= 0
            if not inner.any():
                return at
            goes = columns[rows, self.feature[at]] <= cuts[at]
            at = np.where(inner, np.where(goes, self.left[at], self.right[at]), at)


# -- one node --


def histogram(bins: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Used bins, ascending, and the sums of their rows."""
    order = np.argsort(bins, kind="stable")
    ordered = bins[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[starts], np.add.reduceat(sums[order], starts, axis=0)


def best_cut(used: np.ndarray, sums: np.ndarray, penalty: float = PENALTY, least: float = LEAST_WEIGHT) -> tuple[float, int, np.ndarray] | None:
    """(gain, last bin on the left, sums on the left) of a column; ``sums`` holds the weight, then the gradients."""
    if len(used) < 2:
        return None
    left = np.cumsum(sums, axis=0)
    total = left[-1]
    left = left[:-1]
    right = total - left
    gain = (left[:, 1:] ** 2).sum(axis=1) / (left[:, 0] + penalty) + (right[:, 1:] ** 2).sum(axis=1) / (right[:, 0] + penalty)
    gain = np.where((left[:, 0] >= least) & (right[:, 0] >= least), gain, -np.inf)
    at = int(np.argmax(gain))
    gained = float(gain[at] - (total[1:] ** 2).sum() / (total[0] + penalty))
    return (gained, int(used[at]), left[at]) if gained > 1e-12 else None


def _first_best(found: list[tuple[float, int, int, np.ndarray]]) -> tuple[float, int, int, np.ndarray] | None:
    """Largest gain of (gain, column, bin, sums on the left); the first column among equals."""
    return min(found, key=lambda s: (-s[0], s[1])) if found else None


def _best_of(bins: np.ndarray, sums: np.ndarray, columns: Sequence[int]) -> tuple[float, int, int] | None:
    """(gain, column, bin) over all columns of a node's rows, some columns at a time so that ``CELLS`` numbers are held."""
    total = sums.sum(axis=0)
    parent = (total[1:] ** 2).sum() / (total[0] + PENALTY)
    step = max(1, CELLS // sums.size)
    best = None
    for first in range(0, len(columns), step):
        own = bins[:, columns[first : first + step]]
        order = np.argsort(own, axis=0, kind="stable")
        ordered = np.take_along_axis(own, order, axis=0)
        left = np.cumsum(sums[order], axis=0)[:-1]  # (rows - 1, columns, 1 + outputs)
        right = total - left
        weights = left[..., 0], right[..., 0]
        gain = sum(np.einsum("nch,nch->nc", side[..., 1:], side[..., 1:]) / (w + PENALTY) for side, w in zip((left, right), weights))
        allowed = (ordered[:-1] != ordered[1:]) & (weights[0] >= LEAST_WEIGHT) & (weights[1] >= LEAST_WEIGHT)
        gain = np.where(allowed, gain, -np.inf)
        at = gain.argmax(axis=0)
        top = gain[at, np.arange(len(at))]
        c = int(top.argmax())
        if top[c] - parent > 1e-12 and (best is None or top[c] - parent > best[0]):
            best = float(top[c] - parent), columns[first + c], int(ordered[at[c], c])
    return best


def grow(bins: np.ndarray, sums: np.ndarray, columns: Sequence[int], depth: int) -> list[tuple]:
    """Nodes (column, bin, left, right, sums) of the tree over these rows, the root first; leaves have column -1."""
    nodes: list[list] = []
    stack = [(np.arange(len(bins)), depth, -1, 2)]
    while stack:
        rows, left_depth, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([-1, 0, -1, -1, sums[rows].sum(axis=0)])
        if parent >= 0:
            nodes[parent][side] = me
        best = _best_of(bins[rows], sums[rows], columns) if left_depth and len(rows) > 1 else None
        if best is None:
            continue
        nodes[me][0], nodes[me][1] = best[1], best[2]
        goes = bins[rows, best[1]] <= best[2]
        stack.append((rows[~goes], left_depth - 1, me, 3))
        stack.append((rows[goes], left_depth - 1, me, 2))
    return [tuple(n) for n in nodes]


# -- blocks --


@dataclass
class Rows:
    bins: np.ndarray
    target: np.ndarray
    guess: np.ndarray
    draw: np.ndarray  # unsigned 64-bit hashes

    def sums(self) -> np.ndarray:
        """Weight and gradients of every row."""
        return np.column_stack([np.ones(len(self.target)), self.target - self.guess])

    def drawn(self, tree: int, share: float) -> np.ndarray:
        x = self.draw ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(31))) < np.uint64(min(share, 1.0) * (2**64 - 2**11))


def _blocks(df: DataFrame, edges: list[np.ndarray], start: np.ndarray, ids: Sequence[str], seed: int, n_rows: int) -> RDD:
    """``df`` (x array, y array) as written blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            y = batch["y"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            x = np.where(np.isnan(x), -np.inf, x)
            bins = np.column_stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8)
            data = io.BytesIO()
            np.savez(data, bins=bins, target=y, draw=batch["draw"].to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([data.getvalue()], pa.binary())], names=["data"])

    conf = df.sparkSession.conf
    limit = conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK_ROWS))
    try:
        rows = df.select("x", "y", F.xxhash64(F.lit(seed), *ids).alias("draw")).coalesce(max(1, -(-n_rows // BLOCK_ROWS)))
        written = materialize(rows.mapInArrow(run, "data binary"), "blocks")
    finally:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)

    def unpack(row) -> Rows:
        with np.load(io.BytesIO(row["data"])) as z:
            return Rows(z["bins"], z["target"], np.tile(start, (len(z["target"]), 1)), z["draw"])

    return written.rdd.map(unpack)


def _grow_tree(blocks: RDD, tree_number: int, n_rows: float, n_outputs: int, columns: list[int], edges: list[np.ndarray], depth: int, rate: float,
               row_share: float, node_rows: int) -> Tree:
    nodes: list[list] = [[-1, 0, -1, -1, None]]
    open_nodes = {0: (depth, n_rows)}  # node -> (levels left, rows)
    while open_nodes:
        made = _as_tree(nodes, edges, n_outputs, rate)
        finish = {n: left for n, (left, rows) in open_nodes.items() if rows <= node_rows or left == 0}
        wide = [n for n in open_nodes if n not in finish]

        def parts(block: Rows, made=made, finish=finish, wide=wide) -> Iterator[tuple]:
            rows = np.flatnonzero(block.drawn(tree_number, row_share))
            at = made.leaf_of(block.bins[rows], made.cut_bin)
            sums = block.sums()[rows]
            for n in finish:
                mine = rows[at == n]
                if len(mine):
                    yield (n, -1), (block.bins[mine], sums[at == n])
            for n in wide:
                mine = at == n
                if mine.any():
                    for column in columns:
                        used, added = histogram(block.bins[rows[mine], column], sums[mine])
                        whole = np.zeros((BINS, sums.shape[1]))
                        whole[used] = added
                        yield (n, column), whole

        def add(a, b):
            if isinstance(a, tuple):
                return tuple(np.concatenate(x) for x in zip(a, b))  # at most ``node_rows`` rows, or sums of a leaf
            return a + b

        def choose(pair, finish=finish):
            (n, column), got = pair
            if column < 0:
                return n, -1, grow(*got, columns, finish[n]) if finish[n] else [(-1, 0, -1, -1, got[1].sum(axis=0))]
            used = np.flatnonzero(got[:, 0] > 0)
            return n, column, (got.sum(axis=0), best_cut(used, got[used]))

        tasks = max(1, min(blocks.getNumPartitions(), len(finish) + len(wide) * len(columns)))
        best: dict[int, list] = {}
        following: dict[int, tuple[int, float]] = {}
        for n, column, got in sorted(blocks.flatMap(parts).reduceByKey(add, tasks).map(choose).collect(), key=lambda r: r[:2]):
            if column < 0:
                base = len(nodes) - 1  # the subtree's root takes the node's place
                moved = [[f, b, *(c + base if c > 0 else c for c in (lo, hi)), s] for f, b, lo, hi, s in got]
                nodes[n] = moved[0]
                nodes.extend(moved[1:])
            else:
                nodes[n][4] = got[0]
                if got[1]:
                    best.setdefault(n, []).append((got[1][0], column, got[1][1], got[1][2]))
        for n, found in best.items():
            _, column, cut, on_left = _first_best(found)
            left_depth = open_nodes[n][0] - 1
            nodes[n][:4] = [column, cut, len(nodes), len(nodes) + 1]
            for side in (on_left, nodes[n][4] - on_left):
                following[len(nodes)] = (left_depth, float(side[0]))
                nodes.append([-1, 0, -1, -1, side])
        # a node whose depth is used up is a leaf already, with its sums
        open_nodes = {n: v for n, v in following.items() if v[0] > 0}
    return _as_tree(nodes, edges, n_outputs, rate)


def _grow_batch(blocks: RDD, batch: list[tuple[int, list[int]]], edges: list[np.ndarray], n_outputs: int, depth: int, rate: float, row_share: float) -> list[Tree]:
    """Trees (number, columns) one after another in the task that holds all rows: at most ``node_rows``."""

    def run(pair) -> Iterator[Tree]:
        parts = list(pair[1])
        whole = Rows(*(np.concatenate([getattr(b, f) for b in parts]) for f in ("bins", "target", "guess", "draw")))
        order = np.argsort(whole.draw, kind="stable")
        whole = Rows(whole.bins[order], whole.target[order], whole.guess[order], whole.draw[order])
        for number, columns in batch:
            rows = np.flatnonzero(whole.drawn(number, row_share))
            tree = _as_tree(grow(whole.bins[rows], whole.sums()[rows], columns, depth), edges, n_outputs, rate)
            whole.guess = whole.guess + tree.value[tree.leaf_of(whole.bins, tree.cut_bin)]
            yield tree

    return blocks.map(lambda block: (0, block)).groupByKey(1).flatMap(run).collect()


def _as_tree(nodes: list, edges: list[np.ndarray], n_outputs: int, rate: float) -> Tree:
    sums = np.array([np.zeros(1 + n_outputs) if n[4] is None else n[4] for n in nodes])
    feature, cut_bin, left, right = (np.array([n[i] for n in nodes], np.int64) for i in range(4))
    cut = np.array([edges[f][b] if f >= 0 else 0.0 for f, b in zip(feature, cut_bin)])
    value = rate * sums[:, 1:] / (sums[:, :1] + PENALTY)
    return Tree(feature, cut_bin, cut, left, right, sums[:, 0], value)


@dataclass
class BoostedModel:
    start: np.ndarray
    trees: list[Tree]

    @property
    def horizon(self) -> int:
        return len(self.start)

    def guess(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), -np.inf, x)
        out = np.tile(self.start, (len(x), 1))
        for tree in self.trees:
            out += tree.value[tree.leaf_of(x, tree.cut)]
        return out

    def predict(self, df: DataFrame, out: str = "y_hat", x: str = "x") -> DataFrame:
        """``df`` (``x`` array<double>) with an array of the outputs. The trees' size follows from the parameters."""
        shared = df.sparkSession.sparkContext.broadcast(BoostedModel(self.start, self.trees))

        @F.pandas_udf("array<double>")
        def outputs(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            return pd.Series(list(shared.value.guess(np.stack(rows.to_numpy()).astype(float))))

        return df.withColumn(out, outputs(x))


def train(
    df: DataFrame,
    *,
    ids: Sequence[str] = ("x",),
    rounds: int = BOOSTED["rounds"],
    depth: int = BOOSTED["depth"],
    rate: float = BOOSTED["rate"],
    row_share: float = BOOSTED["row_share"],
    column_share: float = BOOSTED["column_share"],
    seed: int = BOOSTED["seed"],
    bins: int = BINS,
    node_rows: int = NODE_ROWS,
) -> BoostedModel:
    """Boosted trees from ``df`` (x array<double>, y array<double> of equal lengths in all rows). ``ids`` names a row for sampling.

    ``df`` is read three times: pass a written table.
    """
    rows = df.where(F.col("y").isNotNull() & F.forall("y", lambda v: v.isNotNull() & ~F.isnan(v)))
    shape = rows.agg(F.max(F.size("x")).alias("p"), F.max(F.size("y")).alias("h"), F.count(F.lit(1)).alias("n")).first()
    if not shape["n"]:
        raise ValueError("no training rows")
    p, h = shape["p"], shape["h"]
    shares = [i / bins for i in range(1, bins)]
    told = rows.agg(
        *[F.percentile_approx(F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]), shares, 10_000).alias(f"e{i}") for i in range(p)],
        *[F.avg(F.col("y")[k]).alias(f"m{k}") for k in range(h)],
    ).first()
    edges = [np.unique(np.array(told[f"e{i}"] or [0.0], float)) for i in range(p)]
    start = np.array([told[f"m{k}"] for k in range(h)])
    context = df.sparkSession.sparkContext
    context.setCheckpointDir(scratch_path(df.sparkSession, "boosting"))
    blocks = _blocks(rows, edges, start, ids, seed, shape["n"]).persist(StorageLevel.MEMORY_AND_DISK)
    rng = np.random.default_rng(seed)
    drawn = [sorted(int(c) for c in rng.choice(p, max(1, int(column_share * p)), replace=False)) for _ in range(rounds)]
    at_once = CHECKPOINT if shape["n"] <= node_rows else 1
    trees: list[Tree] = []
    held = [blocks]
    while len(trees) < rounds:
        batch = list(enumerate(drawn))[len(trees) : len(trees) + at_once]
        if at_once > 1:
            made = _grow_batch(blocks, batch, edges, h, depth, rate, row_share)
        else:
            made = [_grow_tree(blocks, batch[0][0], shape["n"] * row_share, h, batch[0][1], edges, depth, rate, row_share, node_rows)]
        trees += made

        def move(block: Rows, made: list[Tree] = made) -> Rows:
            return Rows(block.bins, block.target, block.guess + sum(t.value[t.leaf_of(block.bins, t.cut_bin)] for t in made), block.draw)

        blocks = blocks.map(move).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(blocks)
        if len(trees) % CHECKPOINT == 0:
            blocks.checkpoint()
            blocks.count()
        while len(held) > 2:  # the next job still reads the blocks before these
            held.pop(0).unpersist()
    for rdd in held:
        rdd.unpersist()
    return BoostedModel(start, trees)

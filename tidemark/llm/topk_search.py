"""Exact top-k inner-product search: one ball tree per shard, branch and bound over blocks of queries.

The vectors are dealt evenly over shards of about ``shard_rows`` rows; each shard's task builds a ball
tree in numpy and writes it as one row of bounded size. Queries are packed into blocks. Shards and blocks meet in the
cells of a grid: a task holds the trees of its cell, at most ``HELD`` bytes of vectors, while its blocks pass by, so one
exchange brings a block to every column of the grid and not to every shard. A block takes its k-th scores from tree
to tree: a node is opened only for queries whose bound ``q . center + |q| * radius`` reaches them. Nodes are taken by
their largest bound, and each raises the k-th scores that later nodes must reach. A block brings at most k rows a
query from a cell, and one more exchange merges them.

Nothing is joined or broadcast, and the driver gets counts only. The grid has as many cells as the shuffle has
tasks, unless its copies would then be over some ``2 * sqrt(COPIES)`` times the tables; beyond that, only ``HELD`` makes it finer.

Ties go to the smaller id. Null vectors and vectors with null or non-finite components take no part, nor
do those of another length than most. Rows that share an id are one query per distinct vector, and none of
them is a candidate of that query.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize
from .common import released

LEAF = 48
# Levels of nodes that are opened together, so that a product has a thousand rows or more.
OPENED = 5
# Bytes of vectors, at four a component, that a cell holds.
HELD = 128 << 20
COPIES = 4
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


# -- one shard --


class Best:
    """The k best scores of every query so far, ties by smaller id; free places hold ``LOWEST`` and ``HIGHEST``."""

    def __init__(self, n: int, k: int):
        self.ids, self.scores = np.full((n, k), HIGHEST), np.full((n, k), LOWEST)

    @property
    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched, row = np.unique(row, return_inverse=True)
        n, k = len(touched), self.ids.shape[1]
        row = np.concatenate([np.repeat(np.arange(n), k), row])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        order = np.lexsort((ids, ~scores, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
        top = order[place < k].reshape(n, k)  # every row has its k former places
        self.ids[touched], self.scores[touched] = ids[top], scores[top]


def _reaching(scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores that reach their row's ``least``; where these are few, eight at a time are passed over."""
    flags = np.zeros(-(-scores.size // 8) * 8, bool)
    np.greater_equal(scores, least[:, None], out=flags[: scores.size].reshape(scores.shape))
    eights = np.flatnonzero(flags.view(np.uint64))
    at = (8 * eights[:, None] + np.arange(8))[flags.reshape(-1, 8)[eights]]
    return np.divmod(at, scores.shape[1])


class BallTree:
    """Rows reordered so that every node is a slice; children of node i are 2i+1 and 2i+2."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, bounds: np.ndarray, centers: np.ndarray, radii: np.ndarray):
        self.ids, self.rows, self.bounds, self.centers, self.radii = ids, rows, bounds, centers, radii
        self.longest = math.sqrt((rows.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
        # Bounds are of single precision; their radii are longer by what rounding may take away.
        size = np.sqrt((centers**2).sum(axis=1))
        self.single = centers.astype(np.float32)
        self.reach = (radii + (centers.shape[1] + 16) * 2.0**-23 * (size + radii)).astype(np.float32)

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray) -> BallTree:
        n = len(ids)
        depth = max(0, math.ceil(math.log2(max(n, 1) / LEAF))) if n > LEAF else 0
        size = 2 ** (depth + 1) - 1
        order = np.lexsort((ids,))
        points = rows.astype(np.float64)
        bounds = np.zeros((size, 2), np.int64)
        centers = np.zeros((size, rows.shape[1] if n else 1))
        radii = np.zeros(size)
        bounds[0] = 0, n
        for node in range(size):
            a, b = bounds[node]
            own = points[order[a:b]]
            if b > a:
                centers[node] = own.mean(axis=0)
                radii[node] = math.sqrt(((own - centers[node]) ** 2).sum(axis=1).max())
            if 2 * node + 2 < size:
                middle = (a + b) // 2
                if b - a > 1:  # along the line between two far points
                    far = own[((own - centers[node]) ** 2).sum(axis=1).argmax()]
                    other = own[((own - far) ** 2).sum(axis=1).argmax()]
                    order[a:b] = order[a:b][np.argsort(own @ (other - far), kind="stable")]
                bounds[2 * node + 1] = a, middle
                bounds[2 * node + 2] = middle, b
        return cls(ids[order], rows[order], bounds, centers, radii)

    def dump(self) -> bytes:
        return _packed(ids=self.ids, rows=self.rows, bounds=self.bounds, centers=self.centers, radii=self.radii)

    @classmethod
    def load(cls, data: bytes) -> BallTree:
        return cls(**_unpacked(data))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, best: Best) -> None:
        """Adds to ``best`` what this shard has."""
        if not len(self.ids) or not len(query_ids):
            return
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        peak = float(length.max()) * self.longest  # bounds all sums of products on the way to a score
        kind = np.float32 if peak < 2**24 else np.float64 if peak < 2**52 else np.int64  # sums of integers are exact
        points, rows = queries.astype(kind), self.rows.astype(kind)
        single, length = queries.astype(np.float32), length.astype(np.float32)

        def bounds_of(who: np.ndarray, nodes: slice) -> np.ndarray:
            return single[who] @ self.single[nodes].T + length[who, None] * self.reach[nodes]

        first = len(self.radii) // 2  # leaf
        under = 1 << min(OPENED, len(self.radii).bit_length() - 1)  # leaves of a top node
        tops = (first + 1) // under
        above = bounds_of(np.arange(len(query_ids)), slice(tops - 1, 2 * tops - 1))
        for top in np.argsort(-above.max(axis=0), kind="stable"):
            who = np.flatnonzero(above[:, top] >= best.kth.astype(np.float32))
            if not len(who):
                continue
            nodes = slice(first + top * under, first + (top + 1) * under)
            bound = bounds_of(who, nodes)
            near = bound >= best.kth[who, None].astype(np.float32)
            some, any_near = near.any(axis=0), near.any(axis=1)
            if not some.any():
                continue
            if 4 * near.sum() >= some.sum() * any_near.sum():  # one product costs less than one a leaf
                at = np.concatenate([np.arange(a, b) for a, b in self.bounds[nodes][some]])
                self._take(who[any_near], at, points, rows, query_ids, best)
                continue
            for leaf in np.argsort(-bound.max(axis=0), kind="stable"):
                at = np.arange(*self.bounds[nodes][leaf])
                self._take(who[bound[:, leaf] >= best.kth[who].astype(np.float32)], at, points, rows, query_ids, best)

    def _take(self, who: np.ndarray, at: np.ndarray, points: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, best: Best) -> None:
        """Scores of the queries ``who`` with the rows ``at``."""
        if not len(who) or not len(at):
            return
        k = best.ids.shape[1]
        ids, scores, least = self.ids[at], points[who] @ rows[at].T, best.kth[who]
        free = np.flatnonzero(least == LOWEST)
        if len(free) and len(at) > k:  # a first k-th score from some of the rows
            own = scores[free, : max(256, 2 * k)].astype(np.int64)
            own[query_ids[who[free], None] == ids[: own.shape[1]]] = LOWEST
            least[free] = np.partition(own, -k, axis=1)[:, -k]
        row, column = _reaching(scores, least.astype(scores.dtype))
        if not len(row):
            return
        score, vec = scores[row, column].astype(np.int64), ids[column]
        good = (vec != query_ids[who[row]]) & ((score > best.kth[who[row]]) | (vec <= best.ids[who[row], -1]))
        if good.any():
            best.add(who[row[good]], vec[good], score[good])


def needed(ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of all rows that may be among the k best of a query: of rows with equal vectors, k for each of the k + 1 smallest ids."""
    rows = np.ascontiguousarray(rows)
    same = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, same))
    same, ids = same[order], ids[order]
    place = np.arange(len(order))
    new = np.r_[True, same[1:] != same[:-1]]
    fresh = new | np.r_[True, ids[1:] != ids[:-1]]
    nth = np.cumsum(fresh) - 1  # of an id in all, then in its group
    nth -= np.maximum.accumulate(np.where(new, nth, 0))
    copy = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return order[(nth <= k) & (copy < k)]


# -- on Spark --


def scaled(embedding: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component, null if the vector takes no part."""
    doubles = F.transform(embedding, lambda x: x.cast("double"))
    fit = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(embedding.isNotNull() & fit, F.transform(doubles, lambda x: F.floor(F.lit(factor) * x)))


def _vectors(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1).astype(np.int64)


def _small(rows: np.ndarray) -> np.ndarray:
    """The narrowest integers that hold the values."""
    for kind in (np.int16, np.int32):
        if rows.size == 0 or (rows.max() <= np.iinfo(kind).max and rows.min() >= np.iinfo(kind).min):
            return rows.astype(kind)
    return rows


def _partition_rows(df: DataFrame, make: Callable[[np.ndarray, np.ndarray], bytes], name: str, columns: list[str]) -> DataFrame:
    """One row (number, bytes) for each partition of (id, vector) rows; partitions are of bounded size."""

    def run(batches):
        got = [(b.column(0).to_numpy(zero_copy_only=False), _vectors(b, 1)) for b in batches if b.num_rows]
        if got:
            ids, rows = (np.concatenate(x) for x in zip(*got))
            number = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([make(ids, rows)], pa.binary())], names=columns)

    return materialize(df.mapInArrow(run, f"{columns[0]} int, {columns[1]} binary"), name)


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def _dealt(table: DataFrame, kind: int, to: Callable[[int], range]) -> DataFrame:
    """(cell, kind, number, part): every (number, part) row once for each cell that ``to`` gives, one copy at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, part = (batch.column(c).slice(i, 1) for c in (0, 1))
                for cell in to(number[0].as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([kind], pa.int32()), number, part], names=["cell", "kind", "number", "part"])

    return table.mapInArrow(lambda batches: released(run(batches)), "cell int, kind int, number int, part binary")


def top_k(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = 5,
    shard_rows: int = 8192,
    block_rows: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id, score. Both tables: id long, vector array<long>.

    Vectors are integers, so scores are exact. Both tables are read more than once.
    """
    usable = F.col("vector").isNotNull()
    sizes = candidates.where(usable).groupBy(F.size("vector").alias("dim")).count()
    common = sizes.orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score long"
    spark = candidates.sparkSession
    if common is None or common["dim"] == 0:
        return spark.createDataFrame([], schema)
    fits = usable & (F.size("vector") == common["dim"])
    count = common["count"]
    shards = max(1, -(-count // shard_rows))
    asked = queries.where(fits).select("id", "vector").distinct()
    n_asked = asked.count()
    blocks_n = max(1, -(-n_asked // block_rows))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    held = max(1, HELD // (4 * common["dim"]))
    ratio = count / max(1, n_asked)
    cells = min(tasks, COPIES * (1 + ratio) ** 2 / ratio)  # of the grid: shards are dealt over its columns, blocks over its lines
    columns = min(shards, max(-(-count // held), round(math.sqrt(cells * ratio))))
    lines = min(blocks_n, max(1, -(-n_asked // held), round(math.sqrt(cells / ratio))))

    def tree(ids: np.ndarray, rows: np.ndarray) -> bytes:
        rows = _small(rows)
        stay = needed(ids, rows, k)
        return BallTree.build(ids[stay], rows[stay]).dump()

    trees = _partition_rows(candidates.where(fits).select("id", "vector").repartition(shards), tree, "trees", ["shard", "tree"])
    blocks = _partition_rows(
        asked.repartition(blocks_n).sortWithinPartitions("id"), lambda ids, rows: _packed(ids=ids, rows=_small(rows)), "blocks", ["block", "queries"]
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held_trees = None, []
        for batch in batches:
            for cell, kind, number, part in zip(*(batch.column(c) for c in range(4))):
                if cell.as_py() != current:
                    current, held_trees = cell.as_py(), []
                if kind.as_py() == 0:
                    held_trees.append(BallTree.load(part.as_py()))
                    continue
                q = _unpacked(part.as_py())
                best = Best(len(q["ids"]), k)
                for one in held_trees:
                    one.search(q["ids"], q["rows"], best)
                full = best.scores > LOWEST
                if full.any():
                    out = _packed(query_ids=q["ids"], found=full.sum(axis=1).astype(np.int32), ids=best.ids[full], scores=_small(best.scores[full]))
                    yield pa.RecordBatch.from_arrays([pa.array([number.as_py()], pa.int32()), pa.array([out], pa.binary())], names=["block", "best"])

    met = _dealt(trees, 0, lambda shard: range(shard % columns * lines, (shard % columns + 1) * lines))
    met = met.unionByName(_dealt(blocks, 1, lambda block: range(block % lines, columns * lines, lines)))
    met = met.repartitionById(columns * lines, "cell").sortWithinPartitions("cell", "kind", "number")
    parts = met.mapInArrow(lambda batches: released(meet(batches)), "block int, best binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, best, query_ids = None, None, None

        def done() -> pa.RecordBatch:
            row, place = np.nonzero(best.scores > LOWEST)
            out = query_ids[row], (place + 1).astype(np.int32), best.ids[row, place], best.scores[row, place]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = _unpacked(part.as_py())
                if block != current:
                    if best is not None:
                        yield done()
                    current, query_ids = block, found["query_ids"]
                    best = Best(len(query_ids), k)
                row, ids, scores = np.repeat(np.arange(len(query_ids)), found["found"]), found["ids"], found["scores"].astype(np.int64)
                good = scores >= best.kth[row]
                best.add(row[good], ids[good], scores[good])
        if best is not None:
            yield done()

    parts = parts.repartitionById(min(tasks, blocks_n), "block").sortWithinPartitions("block")
    return parts.mapInArrow(lambda batches: released(merge(batches)), schema)

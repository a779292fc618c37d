"""Hard negatives by rotated one-bit codes: estimates from popcounts, intervals that cannot miss, integer scores.

Vectors are integers. Rows are packed into groups of about ``group_rows``. In a group every row's difference r from the
group's mean is rotated (two rounds of sign flips and Walsh-Hadamard steps, so nothing is stored for it) and kept as its
signs s, one bit each, with its alignment a = <r, s> / d and the length of its rest r - a s. A query is rotated and rounded to
``PLANES`` bits a component; ``popcount(plane & code)`` over the planes gives <q, s>, and a <q, s> estimates <q, r>. The rest
is orthogonal to s, so by Cauchy-Schwarz the error is at most |q - <q, s> s / d| * |r - a s| plus |q - rounded q| * |r|: an
interval that holds the true score. The rest is coded in the same way, ``LEVELS`` times in all; each level reads the rows that
the one before left, in a basis of its own, and shortens their intervals to about 0.6 times. Rows whose interval meets the wanted range and reaches the
k-th best certain lower bound are scored with the integers themselves; all others are out, without an error of sampling.

A search has two rounds. Every query first meets one group, which gives it a k-th score; then all groups, with that score to
reach. A task holds one group at a time, and queries pass by in blocks; at most k rows a query and group go on.

Positives are the k best rows of the anchor's label. Each (anchor, positive) is then a query of its own for rows of other
labels with a score in [least_percent / 100 * positive, positive].

Null vectors and labels and vectors with null components or of another length than most take no part. Anchors that are equal in id, label
and vector are one anchor. A row never is a partner of an anchor with its id. Ties go to the smaller id, and are arbitrary
among rows that share an id. Scores must fit 64 bits. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import materialize

# Bits of a rotated query's components, and one-bit codes of a row.
PLANES = 10
LEVELS = 5
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


# -- codes --


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def rotate(rows: np.ndarray, seed: int = 0) -> np.ndarray:
    """Rows in another orthonormal basis, padded with zeros to a power of two (64 at least)."""
    width = max(64, 1 << (max(rows.shape[1], 1) - 1).bit_length())
    out = np.zeros((len(rows), width))
    out[:, : rows.shape[1]] = rows
    signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (2, width))
    for flip in signs:
        out *= flip
        step = 1
        while step < width:
            pair = out.reshape(len(rows), -1, 2, step)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(rows), width)
            step *= 2
        out /= math.sqrt(width)
    return out


def _bits(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, axis=-1, bitorder="little").view(np.uint64)


class Codes:
    """The rows of one group with their codes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        points = rows.astype(np.float64)
        self.center = points.mean(axis=0)
        rest = points - self.center
        self.length = np.sqrt((rest**2).sum(axis=1))
        self.levels = []  # words of the codes, alignment, length of the rest
        for level in range(LEVELS):
            rest = rotate(rest, level)
            self.width = rest.shape[1]
            signs = rest >= 0
            align = np.abs(rest).sum(axis=1) / self.width
            rest = rest - np.where(signs, align[:, None], -align[:, None])
            self.levels.append((_bits(signs), align, np.sqrt((rest**2).sum(axis=1))))
        self.size = np.sqrt((points**2).sum(axis=1))
        self.peak = float(np.abs(points).max(initial=0))

    def dump(self) -> bytes:
        words, aligns, rests = (np.stack(x) for x in zip(*self.levels))
        return _dump(
            ids=self.ids, labels=self.labels, rows=self.rows, center=self.center, length=self.length, size=self.size,
            words=words, aligns=aligns, rests=rests, width=self.width, peak=self.peak,
        )

    @classmethod
    def load(cls, data: bytes) -> Codes:
        out = cls.__new__(cls)
        part = _load(data)
        out.levels = list(zip(part.pop("words"), part.pop("aligns"), part.pop("rests")))
        out.width, out.peak = int(part.pop("width")), float(part.pop("peak"))
        vars(out).update(part)
        return out

    def narrowing(self, query: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each level, the lowest and highest possible inner product of ``query`` with the rows at ``places``.

        Between two levels the caller may send which of the places stay.
        """
        q = query.astype(np.float64)
        turned = q[None, :]
        q_size, middle_size = math.sqrt((q**2).sum()), math.sqrt((self.center**2).sum())
        middle = np.full(len(places), float(q @ self.center))
        before, missed_before = self.length, 0.0
        for number, (words, align, rest) in enumerate(self.levels):
            turned = rotate(turned, number)
            low = turned.min()
            step = max((turned.max() - low) / ((1 << PLANES) - 1), 1e-300)
            level = np.rint((turned[0] - low) / step).astype(np.int64)
            rounded = low + step * level
            planes = [_bits((level >> p) & 1 == 1) for p in range(PLANES)]
            missed = missed_before + math.sqrt(((turned[0] - rounded) ** 2).sum()) * (before + rest)[places]
            codes = words[places]
            hits = np.zeros(len(places), np.int64)
            for p, plane in enumerate(planes):
                hits += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << p
            ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
            along = low * (2.0 * ones - self.width) + step * (2.0 * hits - level.sum())  # <rounded query, signs>
            across = np.sqrt(np.maximum((rounded**2).sum() - along**2 / self.width, 0))
            middle = middle + align[places] * along
            slack = 1e-9 * (1 + q_size * (self.size[places] + self.length[places] + middle_size))
            wide = across * rest[places] + missed + slack
            stay = yield middle - wide, middle + wide
            before, missed_before = rest, missed
            if stay is not None:
                places, middle, missed_before = places[stay], middle[stay], missed[stay]

    def exact(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.peak * float(np.abs(query).max(initial=0)) * max(len(query), 1) < 2**52:  # then sums of doubles are exact
            return np.rint(self.rows[at].astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
        return self.rows[at].astype(np.int64) @ query.astype(np.int64)

    def search(
        self, anchor_id: int, query: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, k: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each (low, high, least): places and scores of the k best ``wanted`` rows in [low, high] that reach ``least``."""
        places = np.flatnonzero(wanted & (self.ids != anchor_id))
        reach = [max(float(a), float(b)) for a, b in zip(low, least)]
        levels = self.narrowing(query, places)
        stay = None
        for _ in range(LEVELS):
            lower, upper = levels.send(stay)
            stay = np.zeros(len(places), bool)
            for i, (a, b) in enumerate(zip(low, high)):
                certain = lower[(lower >= a) & (upper <= b)]
                if len(certain) >= k:
                    reach[i] = max(reach[i], float(np.partition(certain, len(certain) - k)[len(certain) - k]))
                stay |= (upper >= reach[i]) & (lower <= b)
            places = places[stay]
        scores = self.exact(query, places)
        out = []
        for a, b, floor in zip(low, high, least):
            good = np.flatnonzero((scores >= max(int(a), int(floor))) & (scores <= b))
            best = good[np.lexsort((self.ids[places[good]], -scores[good]))[:k]]
            out.append((places[best], scores[best]))
        return out


# -- on Spark --


def _narrow(rows: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if rows.size == 0 or (rows.max() <= np.iinfo(kind).max and rows.min() >= np.iinfo(kind).min):
            return rows.astype(kind)
    return rows


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _packed(df: DataFrame, most: int, pack: Callable[[pa.RecordBatch], bytes]) -> DataFrame:
    """(number, data) rows of at most ``most`` rows of ``df`` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        held: list[pa.RecordBatch] = []
        n = 0

        def done() -> pa.RecordBatch:
            nonlocal made
            number = (made << 32) + TaskContext.get().partitionId()
            made += 1
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pack(whole)], pa.binary())], names=["number", "data"])

        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                if n and n + part.num_rows > most:
                    yield done()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield done()

    return df.mapInArrow(run, "number long, data binary")


def _pack_rows(batch: pa.RecordBatch) -> bytes:
    return Codes(batch["id"].to_numpy(), batch["label"].to_numpy(), _narrow(_matrix(batch["vector"]))).dump()


def _pack_queries(batch: pa.RecordBatch) -> bytes:
    asked = batch["asked"]  # per anchor: list of (request, low, high, least)
    n = np.diff(asked.offsets.to_numpy()) if len(asked) else np.zeros(0, np.int64)
    flat = asked.flatten()
    part = {name: flat.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("request", "low", "high", "least")}
    return _dump(ids=batch["id"].to_numpy(), labels=batch["label"].to_numpy(), rows=_narrow(_matrix(batch["vector"])), at=np.r_[0, np.cumsum(n)].astype(np.int64), **part)


FOUND = "request long, vec_id long, score long"


def _answers(codes: Codes, queries: dict[str, np.ndarray], same: bool, k: int) -> pa.RecordBatch:
    request, ids, scores = [], [], []
    for i, (anchor, label) in enumerate(zip(queries["ids"].tolist(), queries["labels"].tolist())):
        a, b = queries["at"][i : i + 2]
        wanted = (codes.labels == label) == same
        found = codes.search(anchor, queries["rows"][i], wanted, queries["low"][a:b], queries["high"][a:b], queries["least"][a:b], k)
        for number, (places, score) in zip(queries["request"][a:b], found):
            request.append(np.full(len(places), number, np.int64))
            ids.append(codes.ids[places])
            scores.append(score)
    arrays = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (request, ids, scores)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["request", "vec_id", "score"])


def _meet(groups: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """Answers of each group to the blocks sent to it. A task holds one group; blocks pass by."""
    rows = groups.select(F.col("number").alias("to"), F.lit(0).alias("turn"), "data").unionAll(blocks.select("to", F.lit(1).alias("turn"), "data"))
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, group = None, None
        for batch in batches:
            for to, turn, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if turn == 0:
                    codes, group = Codes.load(data.as_py()), to
                elif to == group:
                    out = _answers(codes, _load(data.as_py()), same, k)
                    if out.num_rows:
                        yield out

    return rows.repartition(tasks, "to").sortWithinPartitions("to", "turn").mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("request").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(groups: DataFrame, n_groups: int, asked: DataFrame, same: bool, k: int, block_rows: int, name: str) -> DataFrame:
    """request, vec_id, score, rank of the k best rows of every request in ``asked`` (anchor, id, label, vector, asked)."""
    at_home = _packed(asked, block_rows, _pack_queries).withColumn("to", F.pmod(F.xxhash64("number"), F.lit(n_groups)))
    first = materialize(_best(_meet(groups, at_home, same, k), k), f"{name}-first")
    reached = first.where(F.col("rank") == k).select("request", F.col("score").alias("reached"))
    raised = asked.select("anchor", F.inline("asked")).join(reached, "request", "left").withColumn("least", F.greatest("least", "reached"))
    again = raised.groupBy("anchor").agg(F.collect_list(F.struct("request", "low", "high", "least")).alias("asked"))  # as many as an anchor's positives
    blocks = materialize(_packed(asked.drop("asked").join(again, "anchor"), block_rows, _pack_queries), f"{name}-blocks")
    everywhere = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))).alias("to"), "data")
    return _best(_meet(groups, everywhere, same, k), k)


def mine(
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = 80,
    group_rows: int = 65_536,
    block_rows: int = 512,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` (id long, label long, vector array<long>) is read twice; ``anchor`` says which of its rows are anchors.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    usable = F.col("vector").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    ready = rows.where(usable).select("id", "label", "vector", F.coalesce(anchor, F.lit(False)).alias("asks"))
    common = ready.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None or common["dim"] == 0:
        return empty
    ready = ready.where(F.size("vector") == common["dim"])
    n_groups = -(-common["count"] // group_rows)
    groups = materialize(_packed(ready.drop("asks").repartition(n_groups), HIGHEST, _pack_rows), "groups")
    anchors = ready.where("asks").select("id", "label", "vector").distinct()
    anchors = materialize(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")

    def request(number: Column, low: Column, high: Column) -> Column:
        return F.struct(number.alias("request"), low.alias("low"), high.alias("high"), low.alias("least"))

    any_score = anchors.withColumn("asked", F.array(request(F.col("anchor"), F.lit(LOWEST), F.lit(HIGHEST))))
    near = _search(groups, n_groups, any_score, True, positives, block_rows, "positives")
    near = near.withColumn("number", F.col("request") * positives + F.col("rank") - 1)
    near = materialize(near.select("number", F.col("request").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # a range below zero is empty: its lower end lies above its upper end
    low = F.expr(f"({least_percent} * positive_score + 99) div 100")
    ranges = near.where("positive_score >= 0").groupBy("anchor").agg(F.collect_list(request(F.col("number"), low, F.col("positive_score"))).alias("asked"))
    far = _search(groups, n_groups, anchors.join(ranges, "anchor"), False, negatives, block_rows, "negatives")
    named = near.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return far.join(named, far["request"] == named["number"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )

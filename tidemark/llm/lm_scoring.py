"""Log probabilities of texts under an interpolated modified Kneser-Ney model that Spark counts.

Words are runs of bytes other than blank, tab, line and page breaks, A-Z as a-z; a text's tokens are its words and one end.
Every token has a context of ``order - 1`` words, padded with start marks. The highest order counts occurrences, each lower
one the distinct words to the left; three discounts an order come from its counts of counts, and an order hands the discounted
mass of a context to the next lower one, down to 1 / (V + 1) for any token. A context that training never saw hands down all.

Texts are read once and become blocks of some ``block_tokens`` tokens, written to the shared folder with ids and word hashes.
Then one exchange for each order, from the highest down:

* a block ships its distinct n-grams as sorted 64-bit hashes, each with its counts in the block, one blob for each range of
  hashes. Held-out texts ship hashes too, with counts of 0: counting and looking up are one exchange;
* a range adds up the counts, names the first block that counted an n-gram as its owner, and answers every block in hash order;
* the answers of a block become one file in the shared folder: a sorted hash array of that part of the model that the block
  asks for. Workers map it into memory. For each n-gram a block owns it tells the next lower order of one more word to the left,
  and of one more continuation of its context. Below the highest order the array carries its hashes; at the highest one,
  where nearly every token has an n-gram of its own, a block derives them again from its tokens in the same order.

Scoring maps a block's arrays of all orders and needs no further exchange. So no task holds more of the model than a block or a
range of hashes needs, whatever the corpus; a frequent n-gram is one record a block. The driver receives some ten sums an order.
Files are written under another name and then moved, and say the same whenever a task runs again.

Distinct n-grams are told apart by 64 bits: among n of them about n * n / 2 ** 65 pairs are counted as one.

Null and empty texts are one end token. A null id counts as the empty string where ids decide what trains. Equal rows count and
score each. Without training texts every token has probability 1. Other columns are not read. No rows give no rows.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import materialize, scratch_path
from .exchange import cell_of, hashed
from .shingles import word_hashes

ORDER = 2
BLOCK_TOKENS = 2_000_000
CELL_TOKENS = 1_000_000
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_BASE = np.uint64(0x9E3779B97F4A7C15)


# -- compact columns of integers: byte planes, each compressed where that helps --


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length."""
    head, body = [len(columns), len(columns[0])], []
    for column in columns:
        column = np.ascontiguousarray(column, dtype="<u8")
        used = -(-int(column.max(initial=0)).bit_length() // 8)
        planes = column.view(np.uint8).reshape(-1, 8).T
        head.append(used)
        for plane in planes[:used]:
            raw = plane.tobytes()
            small = pa.compress(raw, codec="zstd", asbytes=True)
            body.append(min(raw, small, key=len))
            head.append(len(body[-1]))
    return len(head).to_bytes(4, "little") + np.array(head, "<u4").tobytes() + b"".join(body)


def unpack(data: bytes) -> list[np.ndarray]:
    size = int.from_bytes(data[:4], "little")
    head = np.frombuffer(data, "<u4", size, 4).tolist()
    at = 4 + 4 * size
    n, place, out = head[1], 2, []
    for _ in range(head[0]):
        planes = np.zeros((n, 8), np.uint8)
        used, place = head[place], place + 1
        for p in range(used):
            raw = data[at : at + head[place]]
            planes[:, p] = np.frombuffer(raw if len(raw) == n else pa.decompress(raw, n, codec="zstd", asbytes=True), np.uint8)
            at, place = at + head[place], place + 1
        out.append(planes.reshape(-1).view("<u8").copy())
    return out


# -- a block and its n-grams --


def _blocks(df: DataFrame, most: int) -> DataFrame:
    """Rows of whole texts: ids, which train, words of each, word hashes (by frequency) and every word's place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
        n = made = 0

        def done() -> pa.RecordBatch:
            nonlocal made
            block = (TaskContext.get().partitionId() << 32) + made
            made += 1
            words = np.concatenate([h for _, h, _ in held])
            found, place, count = np.unique(words, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(found), np.int64)
            rank[order] = np.arange(len(found))
            whole = pa.Table.from_batches([b for b, _, _ in held]).combine_chunks()
            ids, train = (pa.concat_arrays(whole.column(c).chunks) for c in (0, 1))
            lengths = np.concatenate([c for _, _, c in held])
            columns = [
                pa.array([block], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), train),
                pa.array([pack(lengths)], pa.binary()),
                pa.array([pack(found[order])], pa.binary()),
                pa.array([pack(rank[place])], pa.binary()),
                pa.array([len(words) + len(ids)], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "train", "lengths", "hashes", "words", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                hashes, at = word_hashes(part.column(2).to_pylist())
                held.append((part.select([0, 1]), hashes, np.diff(at)))
                n += len(hashes)
                if n >= most:
                    yield done()
                    held, n = [], 0
        if held:
            yield done()

    rows = df.select(F.col("doc_id"), "train", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("train", T.ArrayType(T.BooleanType())),
            T.StructField("lengths", T.BinaryType()),
            T.StructField("hashes", T.BinaryType()),
            T.StructField("words", T.BinaryType()),
            T.StructField("n", T.LongType()),
        ]
    )
    return rows.mapInArrow(run, schema)


class Block:
    """A block's tokens: for each text a start mark, its words and its end."""

    def __init__(self, train: np.ndarray, lengths: bytes, hashes: bytes, words: bytes):
        (length,), (found,), (place,) = unpack(lengths), unpack(hashes), unpack(words)
        length = length.astype(np.int64)
        self.first = np.cumsum(length + 2) - (length + 2)  # start marks
        total = int((length + 2).sum())
        self.tokens = np.full(total, END, np.uint64)
        self.tokens[self.first] = START
        inside = np.ones(total, bool)
        inside[self.first] = inside[self.first + length + 1] = False
        self.tokens[inside] = found[place.astype(np.int64)]
        self.start = np.zeros(total, bool)
        self.start[self.first] = True
        self.counted = ~self.start & np.repeat(train, length + 2)

    def hashes(self, order: int) -> np.ndarray:
        """Hash of the n-gram that ends at each token."""
        run, marks = self.tokens, START
        for _ in range(order - 1):
            before = np.empty_like(run)
            before[1:] = run[:-1]
            before[self.first] = marks
            with np.errstate(over="ignore"):
                run = before * _BASE + self.tokens
                marks = marks * _BASE + START
        return hashed(run) if order > 1 else run

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the distinct n-grams, the place of one occurrence of each, and the n-gram ending at each token."""
        return np.unique(self.hashes(order), return_index=True, return_inverse=True)


# -- arrays in the shared folder --


def _write(uri: str, rows: np.ndarray) -> None:
    system, path = fs.FileSystem.from_uri(uri)
    data = io.BytesIO()
    np.save(data, rows)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    fresh = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(fresh) as out:
        out.write(data.getvalue())
    system.move(fresh, path)


def _mapped(uri: str) -> np.ndarray:
    """The array, mapped into memory where the shared folder is mounted, else read."""
    system, path = fs.FileSystem.from_uri(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.load(path, mmap_mode="r")
    with system.open_input_file(path) as data:
        return np.load(io.BytesIO(data.read()))


FULL = 255  # in a column of bytes: the value stands in the list of large ones


def _keep(uri: str, columns: dict[str, np.ndarray]) -> None:
    """Two arrays: rows of a hash, if there is one, and a byte for each other column, and a list of the values from ``FULL`` on."""
    rows = np.empty(len(next(iter(columns.values()))), [(name, "<u8" if name == "key" else "u1") for name in columns])
    large = []
    for number, (name, column) in enumerate(columns.items()):
        rows[name] = column if name == "key" else np.minimum(column, FULL)
        if name != "key":
            at = np.flatnonzero(column >= FULL)
            large.append(np.rec.fromarrays([np.full(len(at), number), at, column[at]], "u1,<u4,<u8"))
    _write(f"{uri}.npy", rows)
    _write(f"{uri}-large.npy", np.concatenate(large).view(np.ndarray))


class Stored:
    """The arrays of one block and order."""

    def __init__(self, uri: str):
        self.rows, self.large = _mapped(f"{uri}.npy"), _mapped(f"{uri}-large.npy")

    def __getitem__(self, name: str) -> np.ndarray:
        if name == "key":
            return self.rows["key"]
        out = self.rows[name].astype(np.int64)
        mine = self.large[self.large["f0"] == self.rows.dtype.names.index(name)]
        out[mine["f1"]] = mine["f2"]
        return out

    @property
    def count(self) -> np.ndarray:
        return self["count"] >> 1

    @property
    def owned(self) -> np.ndarray:
        return np.flatnonzero(self["count"] & 1)


# -- counting --

# What blocks tell of an n-gram: its own count (in answers doubled, and one more for the owner); how often training has it, for single words; and, as a context, the sum of its
# continuations' counts and how many of them count 1, 2, and more.
HIGHEST = ("count",)
# Sums over an order: n-grams that count, those that count 1 to 4, all counts, training tokens, and words that training has.
SUMS = ("types", "n1", "n2", "n3", "n4", "mass", "tokens", "known")
LOWER = ("count", "raw", "mass", "ones", "twos", "more")


def _told(block: Block, order: int, top: int, above: Stored | None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    keys, _, place = block.grams(order)
    n = len(keys)
    if order == top:
        count = np.bincount(place[block.counted], minlength=n)
        if order > 1:
            return keys, {"count": count}
        none = np.zeros(n, np.int64)
        return keys, {"count": count, "raw": count, "mass": none, "ones": none, "twos": none, "more": none}
    _, example, _ = block.grams(order + 1)
    mine = above.owned
    ends, counts = example[mine], above.count[mine]
    context = place[ends - 1]
    told = {"count": np.bincount(place[ends], minlength=n), "raw": np.zeros(n, np.int64)}
    if order == 1:
        told["raw"] = np.bincount(place[block.counted], minlength=n)
    told["mass"] = np.bincount(context, counts, n).astype(np.int64)
    for name, of in (("ones", counts == 1), ("twos", counts == 2), ("more", counts > 2)):
        told[name] = np.bincount(context[of], minlength=n)
    return keys, told


def _exchange(blocks: DataFrame, order: int, top: int, cells: int, folder: str) -> dict[str, int]:
    """Count one order; every block's answers go to the folder, the sums over all n-grams are returned."""
    names = HIGHEST if order == top > 1 else LOWER
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number = batch["block"][row].as_py()
                above = Stored(f"{folder}/{order + 1}/{number}") if order < top else None
                keys, told = _told(_block_of(batch, row), order, top, above)
                edges = np.searchsorted(cell_of(keys, cells), np.arange(cells + 1))
                used = np.flatnonzero(np.diff(edges))
                blobs = []
                for cell in used:
                    part = slice(edges[cell], edges[cell + 1])
                    blobs.append(pack(np.diff(keys[part], prepend=np.uint64(0)), *[told[c][part] for c in names]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), number)), pa.array(blobs, pa.binary())], names=["cell", "block", "told"]
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, numbers, blobs = None, [], []

        def done() -> pa.RecordBatch:
            columns = [unpack(b) for b in blobs]
            sizes = [len(c[0]) for c in columns]
            keys = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in columns])
            values = [np.concatenate([c[1 + i] for c in columns]) for i in range(len(names))]
            _, place = np.unique(keys, return_inverse=True)
            sums = [np.bincount(place, v.astype(np.float64)).astype(np.uint64) for v in values]
            counted = np.flatnonzero(values[0])  # blocks ascend
            _, first = np.unique(place[counted], return_index=True)
            owned = np.zeros(len(keys), np.uint64)
            owned[counted[first]] = 1
            total = sums[0]
            stats = {"types": total > 0, **{f"n{i}": total == i for i in (1, 2, 3, 4)}}
            row = [int(s.sum()) for s in stats.values()] + [int(total.sum())]
            row += [int(sums[1].sum()), int((sums[1] > 0).sum())] if len(names) > 1 else [0, 0]
            replies, at = [], 0
            for size in sizes:
                part = slice(at, at + size)
                own = [2 * total[place[part]] + owned[part], *[s[place[part]] for s in sums[1:]]]
                replies.append(pack(np.diff(keys[part], prepend=np.uint64(0)), *own) if order < top else pack(*own))
                at += size
            block = pa.array([*numbers, -1], pa.int64())
            reply = pa.array([*replies, pack(np.array(row, np.uint64))], pa.binary())
            return pa.RecordBatch.from_arrays([block, pa.array([current] * len(block), pa.int32()), reply], names=["block", "cell", "reply"])

        for batch in batches:
            for cell, number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if blobs and cell != current:
                    yield done()
                    numbers, blobs = [], []
                current = cell
                numbers.append(number)
                blobs.append(blob.as_py())
        if blobs:
            yield done()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, sums = None, [], np.zeros(len(SUMS), np.int64)

        def done() -> None:
            parts = [unpack(b) for b in held]
            if order < top:
                parts = [[np.cumsum(p[0], dtype=np.uint64), *p[1:]] for p in parts]
            whole = [np.concatenate(c) for c in zip(*parts)]
            _keep(f"{folder}/{order}/{current}", dict(zip((*["key"] * (order < top), *names), whole)))

        for batch in batches:
            for number, reply in zip(batch.column(0).to_pylist(), batch.column(1)):
                if number == -1:
                    sums += unpack(reply.as_py())[0].astype(np.int64)
                    continue
                if held and number != current:
                    done()
                    held = []
                current = number
                held.append(reply.as_py())
        if held:
            done()
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()) for s in sums.tolist()], names=list(SUMS))

    told = blocks.mapInArrow(tell, "cell int, block long, told binary").repartition(tasks, "cell").sortWithinPartitions("cell", "block")
    replies = told.mapInArrow(answer, "block long, cell int, reply binary").repartition(tasks, "block").sortWithinPartitions("block", "cell")
    sums = replies.select("block", "reply").mapInArrow(keep, ", ".join(f"{s} long" for s in SUMS))
    return {k: int(v or 0) for k, v in sums.agg(*[F.sum(s).alias(s) for s in SUMS]).first().asDict().items()}


def _block_of(batch: pa.RecordBatch, row: int) -> Block:
    train = batch["train"][row].values.to_numpy(zero_copy_only=False).astype(bool)
    return Block(train, *(batch[c][row].as_py() for c in ("lengths", "hashes", "words")))


# -- scoring --

RESULT = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What counts of 1, 2 and more lose. Where counts of counts give none between 0 and the count: a half of 1, 2 and 3."""
    out = []
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), start=1):
        d = i - (i + 1) * y * b / a if a and y else -1.0
        out.append(d if 0 < d <= i else i / 2)
    return tuple(out)


def _probabilities(block: Block, arrays: list[Stored], sums: list[dict[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Probability of every token but start marks, and how often training has it."""
    ends = np.flatnonzero(~block.start)
    chance = np.full(len(ends), 1.0 / (sums[0]["known"] + 1))
    raw = contexts = below = None
    for order, (rows, total) in enumerate(zip(arrays, sums), start=1):
        place = np.searchsorted(rows["key"], block.hashes(order)) if order < len(arrays) else block.grams(order)[2]
        lost = np.array([0.0, *discounts(total["n1"], total["n2"], total["n3"], total["n4"])])
        count = rows.count[place[ends]]
        if order == 1:
            raw = rows["raw"][place[ends]]
            more = total["types"] - total["n1"] - total["n2"]
            mass = np.full(len(ends), float(total["mass"]))
            handed = np.full(len(ends), lost[1] * total["n1"] + lost[2] * total["n2"] + lost[3] * more)
        else:
            at = contexts[ends - 1]
            mass = below["mass"][at].astype(np.float64)
            handed = lost[1] * below["ones"][at] + lost[2] * below["twos"][at] + lost[3] * below["more"][at]
        seen = mass > 0
        own = np.maximum(count - lost[np.minimum(count, 3)], 0)
        chance[seen] = (own[seen] + handed[seen] * chance[seen]) / mass[seen]
        below, contexts = rows, place
    return chance, raw


def score(df: DataFrame, train: Column, order: int = ORDER, block_tokens: int = BLOCK_TOKENS, cell_tokens: int = CELL_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of ``df`` (doc_id, text).

    Rows where ``train`` holds teach the model. ``base_score`` is the log10 probability under add-one single words, ``score``
    that under the model of the given order. ``df`` is read once.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    spark = df.sparkSession
    blocks = materialize(_blocks(df.withColumn("train", F.coalesce(train, F.lit(False))), block_tokens), "lm-blocks")
    tokens = blocks.agg(F.sum("n")).first()[0] or 0
    cells = max(64, -(-tokens // cell_tokens))
    folder = scratch_path(spark, "lm-arrays")
    if "://" not in folder:
        folder = f"file://{folder}"
    sums = [_exchange(blocks, k, order, cells, folder) for k in range(order, 0, -1)][::-1]
    known, total = sums[0]["known"], sums[0]["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = _block_of(batch, row)
                number = batch["block"][row].as_py()
                chance, raw = _probabilities(block, [Stored(f"{folder}/{k}/{number}") for k in range(1, order + 1)], sums)
                starts = block.first - np.arange(len(block.first))
                n = np.diff(np.r_[starts, len(chance)])
                base = np.log10((raw + 1.0) / (total + known + 1.0))
                logs = [np.add.reduceat(x, starts) for x in (base, np.log10(chance))]
                held = ~batch["train"][row].values.to_numpy(zero_copy_only=False).astype(bool)
                hits = np.add.reduceat((raw > 0).astype(np.int64), starts)
                columns = [batch["ids"][row].values, pa.array(held), pa.array(n), pa.array(hits), pa.array(np.full(len(n), total, np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x) for x in logs)], names=list(RESULT))

    kinds = [blocks.schema["ids"].dataType.elementType, T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    scored = blocks.mapInArrow(run, T.StructType([T.StructField(name, kind) for name, kind in zip(RESULT, kinds)]))
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))

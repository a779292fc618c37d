"""N-gram Jaccard join: the components of texts whose shingle sets overlap by at least three quarters.

A size-aware heavy-light join. Shingles have one global order, by how often the corpus holds them (a count
sketch of fixed size, filled by all texts) and then by hash, so each text's first few shingles are its rare
ones. Two linked sets of sizes a and b share at least o = ceil(3 (a + b) / 7) elements, hence k of them among the
first n - o + k of each, for every k. Small sets are light: they enumerate the 2-subsets of those first elements
(k = 2). Large sets are heavy: their first elements enter inverted lists (k = 1), as do those of small sets that
a large one can reach. The boundary is where enumerating subsets costs more rows than the lists would cost pairs.

Texts with equal sets are one class, and only classes are compared. A member without a possible partner in its list, by sizes
and positions, leaves it where lists are made; a list of two is its one pair and goes no further. Longer lists are turned into pairs
in two rounds:

1. Each list yields a number of pairs linear in its length: each member with the list's centre, the class that
   shares most of its first elements with others. Verified pairs give components.
2. A list whose members all lie in one component is done, which is what happens to groups of copies however large
   they are. Any other list yields all its pairs across components that sizes, positions and parities allow, and they are
   verified too. So no link is lost, and no group of copies is expanded.

Candidates are verified in three steps, none of which loses a link: by parities, a quarter of a byte or less for an element, which
reject most; by the classes' sets with elements cut off to 16 bits; by the 64-bit hashes. Only the texts of classes that
parities leave are shuffled and hashed again.

Null and empty texts have empty sets and are linked with nothing. Texts of fewer than five words have their whole
word sequence as the only element. Null ids are allowed; rows that share an id are judged each. ``keep_one`` keeps
one row of each component, the one with the smallest id (null ids last), and of equal rows one; texts without words
all stay.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize
from .bitmap import bitmap, with_flag
from .common import free_name, map_slices, released
from .components import components
from .exchange import cells_for, gather, hashed, ship
from .shingles import shingle_sets

COUNTERS = 1 << 22
PIECES = 64
NO_ID = -(1 << 63)
ENTRY = np.dtype([("key", "<u8"), ("cls", "<i8"), ("n", "<u4"), ("pos", "<u4")])
SCORED = np.dtype([*ENTRY.descr, ("score", "<i8")])
PARITY = 512
# Pairs found in a cell before repeats among them are dropped.
PAIRS = 500_000
MEMBER = np.dtype([*ENTRY.descr, ("comp", "<i8"), ("parity", "<u8", (PARITY // 64,))])
BLOCK = 512
# Lists of up to so many members are searched for members without a partner.
SEARCHED = 64
# Sets of more elements than this keep 32 bits of each in the first check.
WIDE = 4096


def needed(a, b):
    """Elements that linked sets of sizes a and b share at least."""
    return -(-3 * (a + b) // 7)


def class_of(elements: np.ndarray) -> int:
    """64-bit name of a set: two different ones share a name once in 2 ** 64 pairs."""
    return int.from_bytes(hashlib.blake2b(elements.tobytes(), digest_size=8).digest(), "little", signed=True)


# -- one pass: sizes, classes, and the count sketch --


def _slot(elements: np.ndarray) -> np.ndarray:
    return (elements >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, n, cls, tag (hash of the text), parity for every row, and piece, counts for each task's part of the sketch (piece is null in the former)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int32)
        names = ["doc", "n", "cls", "tag", "piece", "counts", "parity"]
        seen = False
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = shingle_sets(part.column(1).to_pylist())
                seen = True
                if sum(map(len, sets)):
                    slots = _slot(np.concatenate(sets))
                    if len(slots) > COUNTERS // 8:
                        counts += np.bincount(slots, minlength=COUNTERS).astype(np.int32)
                    else:
                        np.add.at(counts, slots, 1)
                nothing = pa.nulls(len(sets))
                parities = pa.array([parity_of(s, parity_bits(len(s))) if len(s) > 1 else None for s in sets], pa.binary())
                columns = [part.column(0), pa.array(map(len, sets), pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), part.column(2), nothing.cast(pa.int32()), nothing.cast(pa.binary()), parities]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if seen:
            blobs = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, PIECES)]
            nothing = pa.nulls(PIECES, pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.array(range(PIECES), pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(PIECES, pa.binary())], names=names)

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("tag"))
    return materialize(rows.mapInArrow(lambda batches: released(run(batches)), "doc long, n long, cls long, tag long, piece int, counts binary, parity binary"), "scan")


def order_levels(scanned: DataFrame) -> tuple[np.ndarray, int]:
    """For each counter of the sketch how far it stands out (0: not), and the largest size of a light set."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(zlib.decompress(blob), np.int32).astype(np.int64)
                sums[piece] = sums[piece] + counts if piece in sums else counts
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["piece", "counts"])

    parts = scanned.where("piece IS NOT NULL").select("piece", "counts").repartition(PIECES, "piece").mapInArrow(add, "piece int, counts binary")
    total = np.zeros(COUNTERS, np.int64)
    size = COUNTERS // PIECES
    for row in parts.collect():  # ``COUNTERS`` numbers, whatever the data
        total[row["piece"] * size : (row["piece"] + 1) * size] = np.frombuffer(row["counts"], np.int64)
    mean = total.mean()
    noise = mean + 3 * np.sqrt(mean) + 1
    levels = np.log2(np.maximum(total / noise, 1)).astype(np.uint8)
    usual = total[levels == 0]
    partners = max(0.0, float((usual**2).sum()) / max(int(usual.sum()), 1) - usual.mean() - 1) if len(usual) else 0.0
    light = 3  # one subset each; beyond, p (p - 1) / 2 subsets against p - 1 list entries with so many partners
    while light < 64 and light + 1 - (-(-3 * (light + 1) // 4)) + 2 <= 2 * (1 + partners):
        light += 1
    return levels, light


# -- signatures --


def entries(elements: np.ndarray, cls: int, levels: np.ndarray, light: int) -> np.ndarray:
    """Subset keys of a light set, list keys of a heavy one; positions let a pair be judged by its sizes."""
    n = len(elements)
    if n < 2:  # links only with its own class
        return np.zeros(0, ENTRY)
    first = n - -(-3 * n // 4) + 2
    level = levels[_slot(elements)]
    ordered = elements[np.lexsort((elements, level))[:first]]
    keys, places = [], []
    if n <= light:
        i, j = np.triu_indices(len(ordered), 1)
        keys.append(hashed(ordered[i] * np.uint64(0x9E3779B97F4A7C15) + hashed(ordered[j])))
        places.append(j - 1)
    if 4 * n > 3 * light:
        keys.append(hashed(ordered[: first - 1]))  # the first by hash are small: mixed, they spread over all cells
        places.append(np.arange(min(first - 1, n)))
    out = np.empty(sum(map(len, keys)), ENTRY)
    out["key"], out["pos"], out["cls"], out["n"] = np.concatenate(keys), np.concatenate(places), cls, n
    return out


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys start, and the end."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])


def _possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = x["n"].astype(np.int64), y["n"].astype(np.int64)
    need = needed(a, b)
    return (x["cls"] != y["cls"]) & (4 * np.minimum(a, b) >= 3 * np.maximum(a, b)) & (x["pos"] <= a - need) & (y["pos"] <= b - need)


def _pair_codes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    pair = np.empty((len(x), 2), np.int64)
    pair[:, 0], pair[:, 1] = np.minimum(x["cls"], y["cls"]), np.maximum(x["cls"], y["cls"])
    return pair


def _unique_pairs(parts: list[np.ndarray]) -> np.ndarray:
    pairs = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def useful_lists(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The records of lists in which several pairs are possible, the lengths of their lists, and the pairs of lists with just one."""
    r = records[np.lexsort((records["pos"], records["cls"], records["n"], records["key"]))]
    if len(r) > 1:  # one record for a class in a list
        r = r[np.r_[True, (r["key"][1:] != r["key"][:-1]) | (r["cls"][1:] != r["cls"][:-1])]]
    edges = _runs(r["key"])
    size = np.repeat(np.diff(edges), np.diff(edges))
    first = np.repeat(edges[:-1], np.diff(edges))
    here = np.arange(len(r))
    # some two members may be linked only if two neighbours by size may, by size alone
    near = here[1:][(first[1:] == first[:-1]) & (4 * r["n"][:-1].astype(np.int64) >= 3 * r["n"][1:].astype(np.int64))]
    useful = np.isin(first, first[near])
    r, size = r[useful], size[useful]
    partner = np.ones(len(r), bool)
    for k in range(2, SEARCHED + 1):
        lists = np.flatnonzero(size == k).reshape(-1, k)
        step = max(1, PAIRS // k**2)
        for start in range(0, len(lists), step):
            part = lists[start : start + step]
            partner[part] = _possible(r[part][:, :, None], r[part][:, None, :]).any(axis=2)
    r = r[partner]
    if not len(r):
        return r, np.zeros(0, np.int64), _unique_pairs([])
    edges = _runs(r["key"])
    length = np.diff(edges)
    size, begin = np.repeat(length, length), edges[:-1][length == 2]
    pairs = _unique_pairs([_pair_codes(r[begin], r[begin + 1])])  # each the other's partner, or both had left
    r["key"] = np.where(size <= SEARCHED, np.repeat(_home(r, edges), length), r["key"])
    return r[size > 2], size[size > 2], pairs


def _home(r: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """New keys of lists: those of one least class lie in one cell, so a pair of several lists is found there once.

    A class is in as many lists as it has first elements; those of a large set are dealt over several cells. Lists
    that get one key by chance are one list, which only adds candidates.
    """
    key, least = r["key"][edges[:-1]], np.minimum.reduceat(r["cls"], edges[:-1])
    share = key % (r["n"][edges[1:] - 1].astype(np.uint64) // np.uint64(WIDE) + np.uint64(1))
    high = hashed(least.view(np.uint64) + share * np.uint64(0x9E3779B97F4A7C15))
    return high & np.uint64(0xFFFFFFFF << 32) | key & np.uint64(0xFFFFFFFF)


def star_pairs(records: np.ndarray) -> np.ndarray:
    """Possible pairs of each member with its list's centre, the class of the largest score."""
    r = records[np.lexsort((records["cls"], records["score"], records["key"]))]
    edges = _runs(r["key"])
    centre = r[np.repeat(edges[1:] - 1, np.diff(edges))] if len(r) else r
    good = _possible(r, centre)
    pairs = _pair_codes(r[good], centre[good])
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def parity_bits(n: int) -> int:
    """Classes of elements whose parities tell apart sets of about n elements, a power of two."""
    return max(PARITY, 1 << (n - 1).bit_length())


def parity_of(elements: np.ndarray, bits: int = PARITY) -> bytes:
    """For each of ``bits`` classes of elements, whether the set has an odd number of them."""
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(parity: bytes, bits: int = PARITY) -> np.ndarray:
    """The parity for fewer classes, as bytes."""
    out = np.frombuffer(parity, np.uint8)
    while len(out) > bits // 8:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def parity_allows(x: bytes, n: int, y: bytes, m: int) -> bool:
    """False only if the sets can't be linked, by the parities that both have."""
    bits = 8 * min(len(x), len(y))
    return int(np.bitwise_count(folded(x, bits) ^ folded(y, bits)).sum(dtype=np.int64)) <= n + m - 2 * needed(n, m)


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """False only if sets can't be linked: each class whose parity differs holds an element of just one of them."""
    a, b = x["n"].astype(np.int64), y["n"].astype(np.int64)
    differ = np.bitwise_count(x["parity"] ^ y["parity"]).sum(axis=1, dtype=np.int64)
    return differ <= a + b - 2 * needed(a, b)


def cross_pairs(records: np.ndarray) -> np.ndarray:
    """All possible pairs of a list across components, block by block."""
    r = records[np.lexsort((records["n"], records["key"]))]
    parts, held = [], 0
    edges = _runs(r["key"])
    for a, b in zip(edges, edges[1:]):
        own = r[a:b]
        if b - a < 2 or (own["comp"] == own["comp"][0]).all():
            continue
        sizes = own["n"].astype(np.int64)
        for i in range(0, b - a, BLOCK):
            x = own[i : i + BLOCK]
            last = np.searchsorted(sizes, sizes[min(i + BLOCK, b - a) - 1] * 4 // 3, side="right")  # larger ones are out of reach
            for j in range(i, last, BLOCK):
                y = own[j : min(j + BLOCK, last)]
                p, q = np.nonzero((x["comp"][:, None] != y["comp"][None, :]) & _possible(x[:, None], y[None, :]))
                near = _alike(x[p], y[q])
                p, q = p[near], q[near]
                if len(p):
                    parts.append(_pair_codes(x[p], y[q]))
                    held += len(p)
                    if held > PAIRS:
                        parts, held = [_unique_pairs(parts)], 0
    return _unique_pairs(parts)


# -- verification --


def pack_short(elements: np.ndarray) -> bytes:
    """The low 16 bits of every element, of large sets the low 32."""
    return elements.astype("<u2" if len(elements) <= WIDE else "<u4").tobytes()


def unpack_short(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if n <= WIDE else "<u4")


def _numbered(values: np.ndarray) -> np.ndarray:
    """Sorted codes in which the k-th repeat of a value differs from its others."""
    v = np.sort(values).astype(np.int64)
    here = np.arange(len(v))
    new = np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, bool)
    return v << 24 | (here - np.maximum.accumulate(np.where(new, here, 0)))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two arrays without repeats."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def enough(common: int, a: int, b: int) -> bool:
    return 100 * common >= 75 * (a + b - common)


def may_link(x: bytes, n: int, y: bytes, m: int) -> bool:
    """False only if the sets can't be linked: cut-off elements never have fewer in common."""
    a, b = unpack_short(x, n), unpack_short(y, m)
    if a.dtype != b.dtype:
        a, b = a.astype(np.uint16), b.astype(np.uint16)
    return enough(overlap(_numbered(a), _numbered(b)), n, m)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets overlap by at least three quarters."""
    return enough(overlap(a, b), len(a), len(b))


class Verifier:
    """Decides candidate pairs of classes: by parities, then by cut-off elements, the few that are left by the full sets."""

    def __init__(self, texts: DataFrame, classes: DataFrame):
        self.texts, self.classes = texts, classes  # doc, text; cls, doc of one document each, n, parity

    def elements(self, classes: DataFrame) -> DataFrame:
        """cls, n, elements of the classes, from the texts of their documents; other texts are not shuffled."""
        spark = classes.sparkSession
        chosen = materialize(self.classes.select("cls", "doc").join(classes, "cls", "left_semi"), "chosen")
        bits = spark.sparkContext.broadcast(bitmap(chosen.select("doc")))

        def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = shingle_sets(batch.column(1).to_pylist())
            keep = [class_of(s) == c for s, c in zip(found, batch.column(0).to_pylist())]  # rows may share an id
            columns = [batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["cls", "n", "elements"]).filter(pa.array(keep, pa.bool_()))

        rows = with_flag(self.texts, bits).join(chosen, "doc").select("cls", "text")
        return materialize(map_slices(rows, sets, "cls long, n long, elements binary"), "sets")

    def decide(self, pairs: DataFrame, held: DataFrame, may: Callable[[bytes, int, bytes, int], bool]) -> DataFrame:
        """The pairs that ``may`` accepts, from what is held (cls, n, value) of both classes."""
        left = pairs.join(held.toDF("a", "n", "x"), "a")
        both = left.join(held.toDF("b", "m", "y"), "b")

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = [may(x, n, y, m) for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in range(2, 6)))]
            return pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return materialize(map_slices(both.select("a", "b", "n", "m", "x", "y"), run, "a long, b long").distinct(), "pairs")

    def links(self, pairs: DataFrame) -> DataFrame:
        left = self.decide(pairs, self.classes.select("cls", "n", "parity"), parity_allows)
        sets = self.elements(left.select(F.explode(F.array("a", "b")).alias("cls")).distinct())

        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            short = [pack_short(np.frombuffer(s, np.uint64)) for s in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(short, pa.binary())], names=["cls", "n", "elements"])

        left = self.decide(left, map_slices(sets, cut, sets.schema), may_link)
        return self.decide(left, sets, lambda x, n, y, m: linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))


def _packed(batch: pa.RecordBatch, dtype: np.dtype) -> np.ndarray:
    """Records from the columns of a batch, in the order of the fields."""
    out = np.empty(batch.num_rows, dtype)
    for name, column in zip(dtype.names, batch.columns):
        if name == "parity":
            out[name] = np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(batch.num_rows, -1)
        else:
            values = column.to_numpy(zero_copy_only=False)
            out[name] = values.view(np.uint64) if name == "key" else values
    return out


def class_links(df: DataFrame, scanned: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """node, root of every class that is linked with another."""
    spark = df.sparkSession
    cells = cells_for(spark)
    levels, light = order_levels(scanned)
    shared = spark.sparkContext.broadcast(levels)  # ``COUNTERS`` bytes
    texts = df.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))

    def make(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([entries(s, class_of(s), shared.value, light) for s in shingle_sets(batch.column(0).to_pylist())])

    def combine(records: np.ndarray) -> np.ndarray:  # copies within a task ship once
        order = np.lexsort((records["key"], records["cls"]))
        r = records[order]
        return r[np.r_[True, (r["key"][1:] != r["key"][:-1]) | (r["cls"][1:] != r["cls"][:-1])]]

    def lists_of(records: np.ndarray) -> pa.RecordBatch:
        found, size, pair = useful_lists(records)
        none = pa.nulls(len(pair), pa.int64())
        columns = [pa.array(np.ascontiguousarray(c)) for c in (found["key"].view(np.int64), found["n"].astype(np.int64), found["pos"].astype(np.int64), size)]
        columns = [pa.array(np.r_[found["cls"], pair[:, 0]]), *(pa.concat_arrays([c, none]) for c in columns), pa.concat_arrays([pa.nulls(len(found), pa.int64()), pa.array(np.ascontiguousarray(pair[:, 1]))])]
        return pa.RecordBatch.from_arrays(columns, names=["cls", "key", "n", "pos", "size", "other"])

    shipped = ship(texts.select("text"), make, cells, combine)
    made = materialize(gather(shipped, ENTRY, lists_of, "cls long, key long, n long, pos long, size long, other long"), "lists")
    lists, sure = made.where("other IS NULL").drop("other"), made.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b"))

    def pack_scored(batch: pa.RecordBatch) -> np.ndarray:
        return _packed(batch, SCORED)

    def centres(records: np.ndarray) -> pa.RecordBatch:
        pair = star_pairs(records)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    # a class whose first elements many others share is what copies were made from: the best centre
    scores = lists.groupBy("cls").agg(F.sum("size").alias("score"))
    scored = lists.select("key", "cls", "n", "pos").join(scores, "cls").select("key", "cls", "n", "pos", "score")
    stars = gather(ship(scored, pack_scored, cells, rows=50_000), SCORED, centres, "a long, b long")
    pairs1 = materialize(stars.unionAll(sure).distinct(), "pairs")

    whole = scanned.where("piece IS NULL AND n > 1").groupBy("cls").agg(F.min(F.coalesce("doc", F.lit(NO_ID))).alias("doc"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    involved = made.select(F.explode(F.array("cls", "other")).alias("cls")).where("cls IS NOT NULL").distinct()
    classes = materialize(whole.join(involved, "cls", "left_semi"), "classes")  # all that any round compares
    verifier = Verifier(texts, classes)

    links1 = verifier.links(pairs1)
    found1 = materialize(components(links1), "components")

    def fold(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([folded(p).tobytes() for p in batch.column(1).to_pylist()], pa.binary())], names=["cls", "parity"])

    known = map_slices(classes.select("cls", "parity"), fold, "cls long, parity binary").join(found1.withColumnRenamed("node", "cls"), "cls", "left")
    member = lists.join(known, "cls").select("key", "cls", "n", "pos", F.coalesce("root", "cls").alias("comp"), "parity")

    def pack_members(batch: pa.RecordBatch) -> np.ndarray:
        return _packed(batch, MEMBER)

    def second_round(records: np.ndarray) -> pa.RecordBatch:
        pair = cross_pairs(records)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    round2 = gather(ship(member, pack_members, cells, rows=10_000), MEMBER, second_round, "a long, b long").distinct()
    pairs2 = materialize(round2.join(pairs1, ["a", "b"], "left_anti"), "pairs")
    links2 = verifier.links(pairs2)
    return materialize(components(links2.unionAll(found1.select(F.col("node").alias("a"), F.col("root").alias("b")))), "components")


def _placed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, n, cls, tag, root of its component for every row of ``df``."""
    scanned = scan(df, doc_id, text)
    roots = class_links(df, scanned, doc_id, text)
    docs = scanned.where("piece IS NULL").select("doc", "n", "cls", "tag")
    return docs.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("doc", "n", "cls", "tag", F.coalesce("root", "cls").alias("root"))


def join(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) for every row of ``df``."""
    placed = _placed(df, doc_id, text).select("doc", "n", "root")
    least = placed.where("n > 0").groupBy("root").agg(F.min("doc").alias("least"))
    out = placed.join(least, "root", "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of ``df``: of its smallest id (null ids last), and of equal ids and texts any one."""
    # a row is known by its id and text; equal ones have one class, so one component
    placed = _placed(df, doc_id, text).where("n > 0").groupBy("root", "doc", "cls", "tag").agg(F.count(F.lit(1)).alias("n"))
    row = F.struct(F.col("doc").isNull().alias("last"), "doc", "cls", "tag")
    first = placed.groupBy(F.col("root").alias("of")).agg(F.min(row).alias("first"))
    doc, tag = free_name(df.columns, "doc"), free_name(df.columns, "tag")
    judged = placed.join(first, F.col("root") == F.col("of")).select(F.col("doc").alias(doc), F.col("tag").alias(tag), "n", (row != F.col("first")).alias("gone"))
    judged = materialize(judged.where("gone OR n > 1"), "judged")

    def match(other: DataFrame):
        return df[doc_id].cast("long").eqNullSafe(other[doc]) & (F.xxhash64(df[text].cast("string")) == other[tag])

    kept = df.join(judged, match(judged), "left_anti")
    repeated = judged.where("NOT gone")
    if repeated.isEmpty():
        return kept
    several = df.join(repeated, match(repeated), "left_semi").withColumn(tag, F.xxhash64(F.col(f"`{text}`").cast("string")))
    return kept.unionAll(several.dropDuplicates([doc_id, tag]).drop(tag))

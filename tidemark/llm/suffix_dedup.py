"""Dedup of repeated 100-byte strings with suffix arrays.

A byte goes if it lies in a ``LENGTH``-byte string of its document that also starts earlier: in a document with a
smaller id, or earlier in the same one. Strings are judged on the input, and never cross documents.

Every string of ``LENGTH`` bytes has an anchor, the leftmost smallest hash of its ``GRAM``-byte grams, so equal
strings have equal anchors at equal places. Strings with one anchor are neighbours: a stretch of text with its run of
string starts. Three passes:

1. Anchors are counted over all texts; a bitmap of fixed size says which occur twice or more. Only they go on.
2. Stretches are named by a hash of their bytes and shipped by anchor, without the bytes. A map task ships one of
   several equal stretches, its earliest, and reports the others as repeats; the reduce task does the same over all.
   What is left are the earliest ones of anchors that have different stretches, and only their bytes are shipped.
   The stretches of a range of anchors are a shard: they get a suffix array (Larsson-Sadakane refinement: order by
   8 bytes, then by doubling, sorting only groups that are not yet single) and Kasai's common prefixes, capped at
   ``LENGTH``. Strings with that long a common prefix are equal; all but the earliest are repeats. A shard's text is
   bounded; where one anchor's stretches go over it, the next shard's strings are merged by binary search in the
   sorted strings of the ones before.
3. Repeats are gathered per document and removed; documents without any are not shuffled.

Null and empty texts hold nothing. A null id ranks first. Different texts under one id rank by a hash of the text;
equal rows count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize
from .bitmap import bitmap, with_flag
from .common import free_name, map_slices
from .exchange import cells_for, gather, hashed, ship
from .shingles import _BASE, Powers

LENGTH = 100
GRAM = 32
SPREAD = LENGTH - GRAM + 1  # grams in a string
STRETCH = LENGTH + SPREAD - 1
FLAGS = 1 << 27
# Stretches of one shard.
SHARD = 5_000
# Bytes of text that are hashed at a time.
CHUNK = 1 << 20
NO_ID = -(1 << 63)

KEY = np.dtype([("key", "<u8")])
NAMED = np.dtype([("key", "<u8"), ("whole", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("start", "<i4"), ("run", "<u4")])
RECORD = np.dtype([*NAMED.descr, ("text", f"V{STRETCH}")])
SPAN = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("start", "<i4"), ("end", "<i4")])
_PLACE = 30  # bits of a gram's place beside its hash


def _smallest(codes: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours."""
    n = len(codes)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = codes
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of strings with one anchor: key, place of the first start, number of starts, index of the text.

    Also the joined bytes and their running hash.
    """
    joined = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    up, down = Powers.take(len(joined) + 1)
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[: len(joined)], out=total[1:])
    if len(joined) < LENGTH:
        return none.astype(np.uint64), none, none, none, joined, total
    grams = hashed((total[GRAM:] - total[:-GRAM]) * down[: len(joined) - GRAM + 1])
    codes = (grams >> np.uint64(_PLACE)) << np.uint64(_PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_smallest(codes, SPREAD) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - LENGTH + 1, 0)  # starts in each text
    text = np.repeat(np.arange(len(texts)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[text]
    if not len(starts):
        return none.astype(np.uint64), none, none, none, joined, total
    own = anchor[starts]
    edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
    first = edges[:-1]
    # smallest hashes are small: mixed again, they spread over all cells and flags
    return hashed(grams[own[first]]), starts[first], np.diff(edges), text[first], joined, total


def _flag(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - FLAGS.bit_length() + 1)).astype(np.int64)


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Parts of texts of about ``CHUNK`` bytes in all: bytes, index of the text, offset in it.

    A longer text is cut so that each start of a string, with its whole string, is in one part.
    """
    parts: list[bytes] = []
    which: list[int] = []
    offsets: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or b"") - LENGTH + 1, CHUNK):
            parts.append(text[at : at + CHUNK + LENGTH - 1])
            which.append(i)
            offsets.append(at)
            size += len(parts[-1])
            if size >= CHUNK:
                yield parts, np.array(which), np.array(offsets)
                parts, which, offsets, size = [], [], [], 0
    if parts:
        yield parts, np.array(which), np.array(offsets)


def repeated_anchors(texts: DataFrame) -> np.ndarray:
    """Flags of the anchors that occur twice or more: ``FLAGS`` bits, whatever the data."""
    cells = cells_for(texts.sparkSession)

    def make(batch: pa.RecordBatch) -> np.ndarray:
        found = [anchors(parts)[0] for parts, _, _ in _chunks(batch.column(0).to_pylist())]
        return np.concatenate(found).astype(KEY) if found else None

    def combine(records: np.ndarray) -> np.ndarray:  # the lowest bit says that the task holds it twice
        keys, n = np.unique(records["key"] | np.uint64(1), return_counts=True)
        return np.where(n > 1, keys, keys - np.uint64(1)).astype(KEY)

    def reduce(records: np.ndarray) -> pa.RecordBatch:
        keys = np.sort(records["key"])
        plain = keys | np.uint64(1)
        twice = (keys & np.uint64(1)).astype(bool)
        twice[1:] |= plain[1:] == plain[:-1]
        at = _flag(keys[twice])
        low = int(_flag(keys[:1])[0]) // 8
        bits = np.zeros((int(_flag(keys[-1:])[0]) // 8 - low + 1) * 8, np.uint8)
        bits[at - low * 8] = 1
        return pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["low", "flags"])

    flags = np.zeros(FLAGS // 8, np.uint8)
    for row in gather(ship(texts.select("text"), make, cells, combine, rows=128), KEY, reduce, "low long, flags binary").collect():  # FLAGS bits
        part = np.frombuffer(row["flags"], np.uint8)
        flags[row["low"] : row["low"] + len(part)] |= part
    return flags


# -- suffix arrays --


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in order of at least their first ``depth`` bytes (the text's end counts as zeros)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : n + k].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    ranks, open_at = _ranked(key[order], order, n)
    step = 8
    while step < depth and len(open_at):
        # places in the order whose group is not single: sort each group by the rank of what follows
        who = order[open_at]
        after = np.where(who + step < n, ranks[np.minimum(who + step, n - 1)] + 1, 0)
        inner = np.lexsort((after, ranks[who]))
        who, after = who[inner], after[inner]
        order[open_at] = who
        group = ranks[who]
        new = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        head = np.maximum.accumulate(np.where(new, open_at, 0))
        ranks[who] = head
        last = np.r_[new[1:], True]
        open_at = open_at[~(new & last)]
        step *= 2
    return order


def _ranked(values: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each suffix (place of its group's head), and the places of groups that are not single."""
    new = np.r_[True, values[1:] != values[:-1]] if n else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    ranks = np.empty(n, np.int64)
    ranks[order] = head
    last = np.r_[new[1:], True] if n else new
    return ranks, np.flatnonzero(~(new & last))


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """Kasai's common prefix of each suffix in ``order`` with the one before, ``most`` at most.

    The text is cut into lanes that go through their places in step, each keeping its length less one.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(most + 1, np.uint8)])
    width = max(1, -(-n // lanes))
    out = np.zeros(n, np.int64)
    begin = np.arange(0, n, width)
    length = np.zeros(len(begin), np.int64)
    for k in range(width):
        i = begin + k
        live = np.flatnonzero(i < n)
        i = i[live]
        j = before[i]
        length[live] = np.where(j < 0, 0, length[live])
        room = np.minimum(most, n - np.maximum(i, j))
        going = np.flatnonzero((j >= 0) & (length[live] < room))
        while len(going):
            at = length[live[going]]
            equal = padded[i[going] + at] == padded[j[going] + at]
            going = going[equal]
            length[live[going]] += 1
            going = going[length[live[going]] < room[going]]
        length[live] = np.minimum(length[live], np.maximum(room, 0))
        out[i] = length[live]
        length[live] = np.maximum(length[live] - 1, 0)
    return out[order]


# -- shards --


def _earlier(doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places in order of rank."""
    return np.lexsort((start, tag, doc))


def shard_repeats(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of strings that a shard holds earlier; then its sorted distinct strings and the records of their first."""
    text = np.frombuffer(records["text"].tobytes(), np.uint8)
    order = suffix_order(text, len(text))  # a full order: common prefixes of neighbours rest on it
    prefix = common_prefixes(text, order, LENGTH)
    group = np.cumsum(prefix < LENGTH)
    which, inside = order // STRETCH, order % STRETCH
    wanted = inside < records["run"][which]
    group, which, inside = group[wanted], which[wanted], inside[wanted]
    place = np.empty(len(group), SPAN)
    place["doc"], place["tag"] = records["doc"][which], records["tag"][which]
    place["start"] = records["start"][which] + inside
    place["end"] = place["start"] + LENGTH
    ranked = np.lexsort((place["start"], place["tag"], place["doc"], group))
    place, group = place[ranked], group[ranked]
    new = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    kept_at = (which * STRETCH + inside)[ranked][new]
    strings = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[kept_at] if len(kept_at) else np.zeros((0, LENGTH), np.uint8)
    return place[~new], np.ascontiguousarray(strings).view(f"S{LENGTH}").reshape(-1), place[new]


def _before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a ranks before b, row by row."""
    return (a["doc"] < b["doc"]) | ((a["doc"] == b["doc"]) & ((a["tag"] < b["tag"]) | ((a["tag"] == b["tag"]) & (a["start"] < b["start"]))))


def merge_shards(strings: np.ndarray, places: np.ndarray, seen: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Spans of strings that another shard holds earlier, found by binary search in the sorted strings of ``seen``."""
    out = []
    for other, theirs in seen:
        at = np.minimum(np.searchsorted(other, strings), len(other) - 1)
        hit = np.flatnonzero(other[at] == strings)
        mine, they = places[hit], theirs[at[hit]]
        late = _before(they, mine)
        out += [mine[late], they[_before(mine, they)]]
    return np.concatenate(out) if out else np.zeros(0, SPAN)


def cell_firsts(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of stretches that are equal to an earlier one; the earliest of anchors that have different ones."""
    r = records[np.lexsort((records["start"], records["tag"], records["doc"], records["whole"], records["run"], records["key"]))]
    if not len(r):
        return np.zeros(0, SPAN), r
    same = (r["key"][1:] == r["key"][:-1]) & (r["whole"][1:] == r["whole"][:-1]) & (r["run"][1:] == r["run"][:-1])
    new = np.r_[True, ~same]
    first = r[np.flatnonzero(new)[np.cumsum(new) - 1]]
    again = ~new & ~((r["doc"] == first["doc"]) & (r["tag"] == first["tag"]) & (r["start"] == first["start"]))
    spans = _spans(r[again])
    r = r[new]
    several = np.zeros(len(r), bool)  # a stretch that is alone with its anchor has no partner left
    several[1:] = r["key"][1:] == r["key"][:-1]
    several[:-1] |= several[1:]
    return spans, r[several]


def cell_repeats(records: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """Spans of all strings in different stretches that are not the first of their kind."""
    r = records[np.argsort(records["key"], kind="stable")]
    found = [np.zeros(0, SPAN)]
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(r), shard):
        own = r[a : a + shard]
        spans, strings, places = shard_repeats(own)
        found.append(spans)
        if a and r["key"][a - 1] == r["key"][a]:
            found.append(merge_shards(strings, places, seen))
        else:
            seen = []
        if a + shard < len(r) and r["key"][a + shard] == own["key"][-1]:
            seen.append((strings, places))
    return np.concatenate(found)


def _spans(records: np.ndarray) -> np.ndarray:
    out = np.empty(len(records), SPAN)
    out["doc"], out["tag"], out["start"] = records["doc"], records["tag"], records["start"]
    out["end"] = records["start"] + records["run"].astype(np.int32) + LENGTH - 1
    return out


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """Spans of each document merged where they touch."""
    if not len(spans):
        return spans
    s = spans[np.lexsort((spans["end"], spans["start"], spans["tag"], spans["doc"]))]
    other = np.r_[True, (s["doc"][1:] != s["doc"][:-1]) | (s["tag"][1:] != s["tag"][:-1])]
    number = np.cumsum(other)
    reach = np.maximum.accumulate(s["end"] + number * np.int64(1 << 32)) - number * np.int64(1 << 32)
    new = other.copy()
    new[1:] |= s["start"][1:] > reach[:-1]
    at = np.flatnonzero(new)
    out = s[at]
    out["end"] = reach[np.r_[at[1:], len(s)] - 1]
    return out


# -- on Spark --


def stretches(parts: list[bytes], which: np.ndarray, offsets: np.ndarray, doc: np.ndarray, tag: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Names of the stretches whose anchors are flagged: the first of equal ones, marks for the others."""
    keys, starts, runs, part, joined, total = anchors(parts)
    on = _flag(keys)
    good = np.flatnonzero((flags[on >> 3] >> (7 - (on & 7)).astype(np.uint8)) & 1)
    keys, starts, runs, part = keys[good], starts[good], runs[good], part[good]
    begins = np.cumsum([0, *map(len, parts)])
    _, down = Powers.take(len(joined) + 1)
    out = np.zeros(len(keys), NAMED)
    out["key"], out["run"], out["start"] = keys, runs, starts - begins[part] + offsets[part]
    out["doc"], out["tag"] = doc[which[part]], tag[which[part]]
    out["whole"] = hashed((total[starts + runs + LENGTH - 1] - total[starts]) * down[starts] * np.uint64(_BASE))
    return _with_marks(out, _firsts(out))


def named_repeats(texts: DataFrame, flags: Broadcast) -> DataFrame:
    """doc, tag, start, end of repeated stretches (key is null), and of those to compare further (key, whole)."""

    def make(batch: pa.RecordBatch) -> np.ndarray | None:
        ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)]
        made = [stretches(*chunk, *ids, flags.value) for chunk in _chunks(batch.column(2).to_pylist())]
        return np.concatenate(made) if made else None

    def combine(records: np.ndarray) -> np.ndarray:
        marked = records["run"] == 0
        own = records[~marked]
        return np.concatenate([records[marked], _with_marks(own, _firsts(own))])

    def reduce(records: np.ndarray) -> pa.RecordBatch:
        marked = records["run"] == 0
        again, open_ones = cell_firsts(records[~marked])
        spans = joined_spans(np.concatenate([_unmarked(records[marked]), again]))
        rest = _spans(open_ones)
        nothing = pa.nulls(len(spans), pa.int64())
        columns = [pa.array(np.concatenate([spans[c], rest[c]])) for c in SPAN.names]
        names = [pa.concat_arrays([nothing, pa.array(np.ascontiguousarray(open_ones[c]).view(np.int64))]) for c in ("key", "whole")]
        return pa.RecordBatch.from_arrays([*columns, *names], names=[*SPAN.names, "key", "whole"])

    cells = cells_for(texts.sparkSession)
    shipped = ship(texts, make, cells, combine, rows=128)
    return gather(shipped, NAMED, reduce, "doc long, tag long, start int, end int, key long, whole long")


def string_repeats(texts: DataFrame, open_ones: DataFrame) -> DataFrame:
    """doc, tag, start, end of strings that some other of ``open_ones`` holds earlier."""
    spark = texts.sparkSession
    bits = spark.sparkContext.broadcast(bitmap(open_ones.select("doc")))
    per_doc = open_ones.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end", "key", "whole")).alias("places")).withColumnRenamed("tag", "mark")
    held = with_flag(texts, bits).withColumnRenamed("doc", "id").join(per_doc, (F.col("id") == F.col("doc")) & (F.col("tag") == F.col("mark")))
    # rows equal in id and text are one document
    rows = held.select("doc", "tag", "text", "places")

    def make(batch: pa.RecordBatch) -> np.ndarray | None:
        made = []
        for doc, tag, text, places in zip(*(batch.column(c) for c in range(4))):
            marks = places.values
            out = np.zeros(len(marks), RECORD)
            for name in ("start", "key", "whole"):
                values = marks.field(name).to_numpy(zero_copy_only=False)
                out[name] = values.view(np.uint64) if name != "start" else values
            ends = marks.field("end").to_numpy(zero_copy_only=False)
            out["doc"], out["tag"], out["run"] = doc.as_py(), tag.as_py(), ends - out["start"] - LENGTH + 1
            data = np.frombuffer(text.as_py() + bytes(STRETCH), np.uint8)
            window = data[out["start"].astype(np.int64)[:, None] + np.arange(STRETCH)[None, :]]
            window[np.arange(STRETCH)[None, :] >= (ends - out["start"])[:, None]] = 0
            out["text"] = np.ascontiguousarray(window).view(f"V{STRETCH}").reshape(-1)
            made.append(out)
        return np.concatenate(made) if made else None

    def combine(records: np.ndarray) -> np.ndarray:  # rows equal in id and text
        return records[_firsts(records)]

    def reduce(records: np.ndarray) -> pa.RecordBatch:
        spans = joined_spans(cell_repeats(records[_firsts(records)]))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(spans[c])) for c in SPAN.names], names=list(SPAN.names))

    shipped = ship(rows, make, cells_for(spark), combine, rows=64)
    return gather(shipped, RECORD, reduce, "doc long, tag long, start int, end int")


def _firsts(records: np.ndarray) -> np.ndarray:
    """Whether a stretch is the earliest of the equal ones."""
    order = np.lexsort((records["start"], records["tag"], records["doc"], records["whole"], records["run"], records["key"]))
    r = records[["key", "whole", "run"]][order]
    new = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
    out = np.zeros(len(records), bool)
    out[order] = new
    return out


def _with_marks(records: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The first stretches, and a mark (run 0, the end in ``whole``) for the joined spans of the others."""
    spans = joined_spans(_spans(records[~first]))
    marks = np.zeros(len(spans), NAMED)
    for name in ("doc", "tag", "start"):
        marks[name] = spans[name]
    marks["whole"] = spans["end"].astype(np.uint64)
    marks["key"] = hashed(spans["doc"].view(np.uint64) ^ hashed(spans["start"].astype(np.uint64)))
    return np.concatenate([records[first], marks])


def _unmarked(marks: np.ndarray) -> np.ndarray:
    out = np.empty(len(marks), SPAN)
    for name in ("doc", "tag", "start"):
        out[name] = marks[name]
    out["end"] = marks["whole"].astype(np.int32)
    return out


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without ``text``, with ``n_bytes``, ``kept`` (binary) and ``removed`` (start and end in bytes, in order).

    Those columns replace columns of the same name.
    """
    spark = df.sparkSession
    made = ("n_bytes", "kept", "removed")
    keep = [c for c in df.columns if c != text and c not in made]
    doc, tag, body, found = (free_name(keep, n) for n in ("doc", "tag", "text", "found"))
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias(doc), F.xxhash64(value).alias(tag), *[F.col(f"`{c}`") for c in keep], value.cast("binary").alias(body))
    texts = rows.select(F.col(doc).alias("doc"), F.col(tag).alias("tag"), F.col(body).alias("text"))
    flags = spark.sparkContext.broadcast(repeated_anchors(texts))
    named = materialize(named_repeats(texts, flags), "named")
    of_strings = materialize(string_repeats(texts, named.where("key IS NOT NULL")), "strings")
    spans = named.where("key IS NULL").select("doc", "tag", "start", "end").unionAll(of_strings)
    bits = spark.sparkContext.broadcast(bitmap(spans.select("doc")))
    per_doc = spans.groupBy(F.col("doc").alias(doc), F.col("tag").alias(tag)).agg(F.collect_list(F.struct("start", "end")).alias(found))
    touched = with_flag(rows, bits).join(per_doc, [doc, tag], "left").select(*rows.columns, found)
    names = [*keep, *made]
    of_spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, gone = [], []
        for data, marks in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            lost: list[dict] = []
            for m in sorted(marks or (), key=lambda m: m["start"]):
                if lost and m["start"] <= lost[-1]["end"]:
                    lost[-1]["end"] = max(lost[-1]["end"], m["end"])
                else:
                    lost.append(m)
            edges = [0, *(x for m in lost for x in (m["start"], m["end"])), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            gone.append(lost)
        sizes = [len(d) for d in batch.column(batch.num_columns - 2).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[2:-2], pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(gone, of_spans)], names=names)

    none = F.expr("CAST(array() AS array<struct<start:int,end:int>>)")
    clean = with_flag(rows, bits, False).select(*[F.col(f"`{c}`") for c in keep], F.octet_length(body).cast("long").alias("n_bytes"), F.col(body).alias("kept"), none.alias("removed"))
    return clean.unionAll(map_slices(touched, cut, clean.schema))

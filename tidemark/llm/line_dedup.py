"""Substring dedup by hashing of lines or sentences, and of passages across them.

Texts are cut into units without losing a character: lines, or sentences within lines. A unit is
normalised (lower case, runs of blanks as one, none at the ends) and, if it has at least ``min_words``
words, hashed to 128 bits. Digests are grouped over all documents; the occurrence that ranks first (by
document id, then offset) stays, every other one goes. A map task keeps the first occurrence of a digest
among its own and reports the others as repeats at once, so a unit that a third of the rows hold is one
record per task in the shuffle. Removed spans keep their offsets in the original text (code points, end
exclusive).

Passages that are made of short units, or begin and end inside units, are found by their words: every run of
``PASSAGE`` normalised words that also starts earlier (by document, then offset) goes, wherever units end. Runs have
an anchor each, the smallest hash of their ``GRAM``-word grams, so equal runs have equal anchors; neighbours with one
anchor are a stretch. Bitmaps of fixed size say which anchors occur twice, and which with different stretches. Of the
former whole stretches are hashed to 128 bits and grouped as units are, of the latter also their single runs. A run that
overlaps its own first occurrence loses only what lies behind that.

Null and empty texts have no units. A null id ranks before all others. Rows that share an id count as one
document: equal units at equal offsets are one occurrence, and every row loses its own units only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize
from .common import free_name, map_slices
from .exchange import cells_for, gather, hashed, ship
from .shingles import Powers, word_hashes
from .suffix_dedup import _PLACE, FLAGS, _flag, _smallest

# A unit ends behind a line break, or also behind a sentence's stop and the blank that follows.
CUTS = {"line": re.compile(r"[^\n]*\n|[^\n]+"), "sentence": re.compile(r"[^\n.!?]*(?:[.!?]+(?! )[^\n.!?]*)*(?:[.!?]+ +|[.!?]*\n|[.!?]*\Z)")}
MIN_WORDS = 8
PASSAGE = 50
GRAM = 16
# Words that are hashed at a time.
CHUNK = 200_000
WORD = re.compile(r"\S+")

RECORD = np.dtype([("key", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("length", "<i4")])
ANCHOR = np.dtype([("key", "<u8"), ("whole", "<u8")])
NO_ID = -(1 << 63)


def cut(text: str, unit: str) -> list[str]:
    """Units of ``text``; joined they are the text."""
    return [u for u in CUTS[unit].findall(text) if u]


def units(text: str, unit: str, min_words: int) -> list[tuple[int, int, bytes]]:
    """(start, length, digest) of the units of at least ``min_words`` words."""
    out, at = [], 0
    for part in cut(text, unit):
        words = part.split()
        if len(words) >= min_words:
            out.append((at, len(part), hashlib.blake2b(" ".join(words).lower().encode("utf-8", "surrogatepass"), digest_size=16).digest()))
        at += len(part)
    return out


def _chunks(texts: list[str | None], width: int) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """Parts of about ``CHUNK`` normalised words in all: words, index of the text, place of the first. A cut loses no run."""
    parts, which, places, size = [], [], [], 0
    for i, text in enumerate(texts):
        words = (text or "").lower().split()
        for at in range(0, len(words) - width + 1, CHUNK):
            part = words[at : at + CHUNK + width - 1]
            parts.append(" ".join(part))
            which.append(i)
            places.append(at)
            size += len(part)
            if size >= CHUNK:
                yield parts, which, places
                parts, which, places, size = [], [], [], 0
    if parts:
        yield parts, which, places


def runs_of_words(parts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of ``width`` words: anchor and its place, both halves of the digest, index of the part, place in it."""
    words, at = word_hashes(parts)
    up, down = Powers.take(len(words) + 1)

    def rolled(values: np.ndarray, n: int) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return hashed((total[n:] - total[:-n]) * down[: len(values) - n + 1])

    gram = min(GRAM, width)
    grams = rolled(words, gram)
    codes = (grams >> np.uint64(_PLACE)) << np.uint64(_PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (_smallest(codes, width - gram + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    counts = np.maximum(np.diff(at) - width + 1, 0)
    part = np.repeat(np.arange(len(parts)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = inside + at[:-1][part]
    return hashed(grams[place[start]]), place[start], rolled(words, width)[start], rolled(hashed(~words), width)[start], part, inside


def _named(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Digests of ``n`` neighbouring runs from those of the first and the last, which overlap and so hold every word."""
    return hashed(first * np.uint64(0x9E3779B97F4A7C15) + last + n.astype(np.uint64))


def _stretches(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first and the last run of each stretch."""
    edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
    return edges[:-1], edges[1:] - 1


def _two_per_anchor(records: np.ndarray) -> np.ndarray:
    """Up to two different stretches of each anchor; the lowest bit of a key says that this one occurs twice."""
    key, twice = records["key"] | np.uint64(1), records["key"] & np.uint64(1)
    order = np.lexsort((records["whole"], key))
    key, whole, twice = key[order], records["whole"][order], twice[order]
    new = np.r_[True, key[1:] != key[:-1]]
    pairs = np.flatnonzero(new | np.r_[True, whole[1:] != whole[:-1]])
    again = np.logical_or.reduceat(twice.astype(bool), pairs) | (np.diff(np.r_[pairs, len(key)]) > 1)
    rank = np.arange(len(pairs)) - np.maximum.accumulate(np.where(new[pairs], np.arange(len(pairs)), 0))
    out = np.empty(len(pairs), ANCHOR)
    out["key"], out["whole"] = key[pairs] - np.uint64(1) + again.astype(np.uint64), whole[pairs]
    return out[rank < 2]


def _flagged(flags: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    at = _flag(anchor)
    return (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def anchor_flags(rows: DataFrame, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the anchors that occur twice or more, and of those with different stretches: ``FLAGS`` bits each, whatever the data."""

    def make(batch: pa.RecordBatch) -> np.ndarray | None:
        found = []
        for parts, _, _ in _chunks(batch.column(0).to_pylist(), passage):
            anchor, place, key, _, _, _ = runs_of_words(parts, passage)
            first, last = _stretches(place)
            records = np.empty(len(first), ANCHOR)
            records["key"], records["whole"] = anchor[first] & ~np.uint64(1), _named(key[first], key[last], last - first + 1)
            found.append(records)
        return np.concatenate(found) if found else None

    def reduce(records: np.ndarray) -> pa.RecordBatch:
        r = _two_per_anchor(records)
        same = (r["key"][1:] | np.uint64(1)) == (r["key"][:-1] | np.uint64(1))
        several = r["key"][1:][same]
        low = int(_flag(r["key"][:1])[0]) // 8
        size = (int(_flag(r["key"][-1:])[0]) // 8 - low + 1) * 8
        blobs = []
        for keys in (np.concatenate([several, r["key"][(r["key"] & np.uint64(1)).astype(bool)]]), several):
            bits = np.zeros(size, np.uint8)
            bits[_flag(keys) - low * 8] = 1
            blobs.append(pa.array([np.packbits(bits).tobytes()], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), *blobs], names=["low", "twice", "several"])

    flags = np.zeros(FLAGS // 8, np.uint8), np.zeros(FLAGS // 8, np.uint8)
    shipped = ship(rows.select("text"), make, cells_for(rows.sparkSession), _two_per_anchor, rows=128)
    for row in gather(shipped, ANCHOR, reduce, "low long, twice binary, several binary").collect():  # FLAGS bits each
        for held, part in zip(flags, (row["twice"], row["several"])):
            held[row["low"] : row["low"] + len(part)] |= np.frombuffer(part, np.uint8)
    return flags


def _first_per_digest(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``records`` in order of digest and rank, and whether each is the first of its digest (or is that occurrence again)."""
    order = np.lexsort((records["start"], records["doc"], records["more"], records["key"]))
    r = records[order]
    new = np.r_[True, (r["key"][1:] != r["key"][:-1]) | (r["more"][1:] != r["more"][:-1])]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return r, (r["doc"] == r["doc"][first]) & (r["start"] == r["start"][first])


def _spans(records: np.ndarray) -> pa.RecordBatch:
    columns = [records["doc"], records["start"].astype(np.int32), records["length"].astype(np.int32), records["key"].view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["doc", "start", "length", "digest"])


def repeats(df: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, start, length and half of the digest of every occurrence but the first of each unit; a null id is ``NO_ID``."""

    def make(batch: pa.RecordBatch) -> np.ndarray:
        found = []
        for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found += [digest + doc.to_bytes(8, "little", signed=True) + start.to_bytes(4, "little") + length.to_bytes(4, "little") for start, length, digest in units(t or "", unit, min_words)]
        return np.frombuffer(b"".join(found), RECORD)

    return _later(_rows(df, doc_id, text), make)


def repeated_runs(df: DataFrame, passage: int = PASSAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, start (in words), length (in runs) and half of the digest of stretches and runs of ``passage`` words that occur earlier."""
    rows = _rows(df, doc_id, text)
    flags = df.sparkSession.sparkContext.broadcast(anchor_flags(rows, passage))

    def make(batch: pa.RecordBatch) -> np.ndarray | None:
        docs, found = batch.column(0).to_numpy(), []
        for parts, which, places in _chunks(batch.column(1).to_pylist(), passage):
            anchor, place, key, more, part, inside = runs_of_words(parts, passage)
            first, last = _stretches(place)
            twice, several = (_flagged(f, anchor[first] & ~np.uint64(1)) for f in flags.value)
            single = np.flatnonzero(np.repeat(several & (first < last), last - first + 1))
            first, last = np.r_[first[twice], single], np.r_[last[twice], single]
            records = np.empty(len(first), RECORD)
            records["length"] = n = last - first + 1
            records["key"], records["more"] = _named(key[first], key[last], n), _named(more[first], more[last], n)
            records["doc"], records["start"] = docs[np.array(which)[part[first]]], np.array(places)[part[first]] + inside[first]
            found.append(records)
        return np.concatenate(found) if found else None

    return _later(rows, make)


def _rows(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))


def _later(rows: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray | None]) -> DataFrame:
    """doc, start, length, digest of every record of ``make`` but the first of each digest."""
    cells = cells_for(rows.sparkSession)

    def combine(records: np.ndarray) -> np.ndarray:
        # what is not the first here is no first anywhere: it ships below a key of its own, with the mark length < 0
        r, first = _first_per_digest(records)
        again = r[~first].copy()
        again["more"] = again["key"]
        again["key"] = hashed(again["doc"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + again["start"].astype(np.uint64))
        again["length"] = -again["length"]
        return np.concatenate([r[first], again])

    def reduce(records: np.ndarray) -> pa.RecordBatch:
        marked = records["length"] < 0
        again = records[marked].copy()
        again["key"], again["length"] = again["more"], -again["length"]
        rest = records[~marked]
        if len(rest):
            r, first = _first_per_digest(rest)
            again = np.concatenate([again, r[~first]])
        return _spans(again)

    return gather(ship(rows, make, cells, combine), RECORD, reduce, "doc long, start int, length int, digest long")


def _covered(texts: list[str], marks: list[tuple[np.ndarray, ...]], width: int) -> list[list[tuple[int, int]]]:
    """Spans of each text that its marked runs (starts, numbers of runs, digests) cover."""
    digests: list[list[np.ndarray]] = [[] for _ in texts]
    for parts, which, _ in _chunks(texts, width):
        _, _, key, _, part, _ = runs_of_words(parts, width)
        for k, i in enumerate(which):
            digests[i].append(key[part == k])
    out = []
    for text, (starts, n, wanted), own in zip(texts, marks, digests):
        key = np.concatenate(own) if own else np.zeros(0, np.uint64)
        here = starts + n <= len(key)  # rows may share an id
        starts, n, wanted = starts[here], n[here], wanted[here]
        same = _named(key[starts], key[starts + n - 1], n) == wanted
        starts, n = starts[same], n[same]
        mine = np.unique(np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        _, first, name = np.unique(key, return_index=True, return_inverse=True)
        before = first[name[mine]]
        begin = np.where((before < mine) & (mine < before + width), before + width, mine)
        edges = np.zeros(len(key) + width, np.int64)  # one more than words
        np.add.at(edges, begin, 1)
        np.add.at(edges, mine + width, -1)
        turns = np.flatnonzero(np.diff(np.cumsum(edges) > 0, prepend=False))
        places = [m.start() for m in WORD.finditer(text)] + [len(text)] if len(turns) else []
        out.append([(places[a], places[b]) for a, b in turns.reshape(-1, 2).tolist()])
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def dedup(df: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", spans: str = "removed", passage: int = PASSAGE) -> DataFrame:
    """``df`` with ``text`` less its repeated units and passages and the column ``spans`` (start and end in the original), in order.

    A null text stays null.
    """
    doc, found, long = free_name(df.columns, "doc"), free_name(df.columns, "found"), free_name(df.columns, "long")
    per_doc = repeats(df, unit, min_words, doc_id, text).groupBy(F.col("doc").alias(doc)).agg(F.collect_list(F.struct("start", "length", "digest")).alias(found))
    runs = repeated_runs(df, passage, doc_id, text).groupBy(F.col("doc").alias(doc)).agg(F.collect_list(F.struct("start", "length", "digest")).alias(long))
    columns = [c for c in df.columns if c != spans]
    rows = df.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias(doc))
    marked = materialize(per_doc.join(runs, doc, "full"), "repeats")
    joined = rows.join(marked, doc, "left").select(*[F.col(f"`{c}`") for c in columns], found, long)
    at = columns.index(text)
    names = [*columns, spans]
    kind = df.schema[text].dataType.simpleString()
    if kind != "string":
        raise TypeError(f"{text} must be a string")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        before = batch.column(at).to_pylist()
        texts, gone = [], []
        lists = batch.column(batch.num_columns - 1)
        with_runs = [i for i, t in enumerate(before) if t and lists[i].is_valid]
        marks = [lists[i].values for i in with_runs]
        marks = [(*(m.field(c).to_numpy().astype(np.int64) for c in ("start", "length")), m.field("digest").to_numpy().view(np.uint64)) for m in marks]
        passages = dict(zip(with_runs, _covered([before[i] for i in with_runs], marks, passage)))
        for i, (t, own_marks) in enumerate(zip(before, batch.column(batch.num_columns - 2).to_pylist())):
            kept, place, lost = [], 0, []
            if t and own_marks:
                wanted = {(m["start"], m["length"], m["digest"]) for m in own_marks}
                lost = [(s, s + n) for s, n, d in units(t, unit, min_words) if (s, n, int.from_bytes(d[:8], "little", signed=True)) in wanted]
            lost = _merged([*lost, *passages.get(i, [])])
            if lost:
                for start, end in lost:
                    kept.append(t[place:start])
                    place = end
                t = "".join(kept) + t[place:]
            texts.append(t)
            gone.append([{"start": a, "end": b} for a, b in lost])
        columns_out = [*batch.columns[:-2], pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        columns_out[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns_out, names=names)

    schema = joined.drop(found, long).withColumn(spans, F.expr("CAST(array() AS array<struct<start:int,end:int>>)")).schema
    return map_slices(joined, run, schema)

"""Exact merge-type (BPE) encoding by backtracking, and decoding.

A text is cut before every run of spaces: no piece of such a model holds a space after another
character, so merges never cross that cut. Each distinct part is encoded once per worker (bounded
memo): one Aho-Corasick pass gives the longest piece at every position, the encoder takes the longest
piece whose pair with its left neighbour survives re-merging, shortens it or steps back where none
does, and marks positions that failed in a bitfield. Characters without a piece fall back to bytes.

Null and empty texts have no content ids (only the begin and end ids asked for) and decode to "".
"""

from __future__ import annotations

import codecs
import heapq
import re
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from .common import free_name, map_slices

SPACE = "▁"
# Entries of the memo of encoded parts and of the memo of checked pairs, in one worker.
MEMO = 400_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format
_PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _one_bad_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one_bad_byte", _one_bad_byte)


class PieceModel:
    """The vocabulary of a BPE model file, and the encoder."""

    def __init__(self, path: str):
        model = model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or normal.precompiled_charsmap or normal.remove_extra_whitespaces:
            raise ValueError(f"{path}: only BPE models that keep the text as it is")
        self.prefix = SPACE if normal.add_dummy_prefix else ""
        if any(p.type in (USER, UNUSED) or SPACE in p.piece.lstrip(SPACE) for p in model.pieces):
            raise ValueError(f"{path}: pieces with inner spaces or user-defined pieces are not supported")
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.score = {p: model.pieces[i].score for p, i in self.ids.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.unknown, self.begin, self.end = model.trainer_spec.unk_id, model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.unknown_surface = model.trainer_spec.unk_surface
        whole: dict[str, int] = {}  # merging never ends in the other pieces
        self.parts = [(-1, -1)] * len(self.pieces)  # what the last merge of a piece joined
        for piece, i in self.ids.items():
            steps: list[tuple[str, str]] = []
            if self.merge(piece, steps) == [piece]:
                whole[piece] = i
                if steps:
                    self.parts[i] = (self.ids[steps[-1][0]], self.ids[steps[-1][1]])
        self.rank = [-self.score[p] if len(p) > 1 and p in whole else -1.0 for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for piece, i in whole.items():
            self.automaton.add_word(piece, (len(piece) - 1, i))
        self.automaton.make_automaton()
        self.size = [len(p) for p in self.pieces]
        self.chars = frozenset(p for p in whole if len(p) == 1)
        self.shorter = [-1] * len(self.pieces)  # the next shorter piece that starts this one
        for piece, i in whole.items():
            self.shorter[i] = next((whole[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in whole), -1)
        self._parts: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._pairs: dict[int, dict[int, bool]] = {}
        self._checked = 0
        self.controls = frozenset(i for i, kind in enumerate(self.types) if kind == CONTROL)
        self.surface = [self._surface(i) for i in range(len(self.pieces))]

    # -- merging, the definition that the encoder must agree with --

    def merge(self, text: str, steps: list[tuple[str, str]] | None = None) -> list[str]:
        """Pieces of ``text`` by merging the best-scored neighbours, leftmost first; ``steps`` gets the merged pairs."""
        symbols: list[str | None] = list(text)
        left = list(range(-1, len(symbols) - 1))
        right = [*range(1, len(symbols)), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            joined = symbols[i] + symbols[j]
            if joined in self.score:
                heapq.heappush(heap, (-self.score[joined], i, joined))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = right[i] if symbols[i] is not None else -1
            if j < 0 or symbols[i] + symbols[j] != joined:
                continue
            if steps is not None:
                steps.append((symbols[i], symbols[j]))
            symbols[i], symbols[j] = joined, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        return [s for s in symbols if s is not None]

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging the text of two pieces again gives back just these two.

        Takes the merges along the boundary back, latest first: the pair breaks if at some time the two
        parts beside the boundary had a merge of their own that came before the one taken back.
        """
        if self._checked >= MEMO:
            for known_pairs in self._pairs.values():
                known_pairs.clear()
            self._checked = 0
        self._checked += 1
        first, second, rank, parts = a, b, self.rank, self.parts
        if self.pieces[a].endswith(SPACE) or self.pieces[b].startswith(SPACE * 2):  # equal scores: merge in full
            x, y = self.pieces[a], self.pieces[b]
            known = self._pairs[a][b] = self.merge(x + y) == [x, y]
            return known
        limit = float("inf")
        known = True
        while True:
            across = self.score.get(self.pieces[a] + self.pieces[b])
            if across is not None and -across < limit:
                known = False
                break
            if parts[a][0] < 0 and parts[b][0] < 0:
                break
            if rank[a] > rank[b]:
                limit, a = rank[a], parts[a][1]
            else:
                limit, b = rank[b] + 0.5, parts[b][0]  # an equal merge further left comes first
        self._pairs[first][second] = known
        return known

    def backtrack(self, text: str) -> list[int]:
        """Ids of the pieces of ``text``, in which every character has a piece."""
        n = len(text)
        size, shorter, pairs = self.size, self.shorter, self._pairs
        longest = [-1] * n
        for end, (before_end, i) in self.automaton.iter(text):
            longest[end - before_end] = i  # of the same start, the longer match ends later
        failed = 0  # bit p: nothing that starts at position p goes with the only encoding of what is before p
        taken: list[int] = []
        at, piece, row = 0, longest[0] if n else -1, None
        while at < n:
            while piece >= 0:
                if not failed or not failed >> at + size[piece] & 1:
                    if row is None:
                        break
                    fits = row.get(piece)
                    if self._fits(taken[-1], piece) if fits is None else fits:
                        break
                piece = shorter[piece]
            if piece >= 0:
                taken.append(piece)
                at += size[piece]
                if at < n:
                    row = pairs.get(piece)
                    if row is None:
                        row = pairs[piece] = {}
                    piece = longest[at]
            elif row is None:
                raise ValueError(f"no encoding of {text!r}")
            else:
                failed |= 1 << at
                last = taken.pop()
                at -= size[last]
                row = pairs[taken[-1]] if taken else None
                piece = shorter[last]
        return taken

    def encode_part(self, part: str) -> list[int]:
        if self.chars.issuperset(part):
            return self.backtrack(part)
        out: list[int] = []
        known: list[str] = []
        for char in part:
            if char in self.chars:
                known.append(char)
                continue
            if known:
                out += self.backtrack("".join(known))
                known.clear()
            out += [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]
        return out + self.backtrack("".join(known)) if known else out

    def encode(self, text: str, begin: bool = False, end: bool = False) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        ids = self._encode_text(text) if text else b""
        first = self.begin.to_bytes(4, "little") if begin else b""
        return first + ids + (self.end.to_bytes(4, "little") if end else b"")

    def _encode_text(self, text: str) -> bytes:
        text = self.prefix + text.replace(" ", SPACE)
        parts, head = text.split(SPACE), b""
        if parts[0] or "" in parts[1:]:  # several spaces in a row, or none at the start
            parts = _PARTS.findall(text)
            if not parts[0].startswith(SPACE):
                head = self._packed(parts.pop(0))
            parts = [p[1:] for p in parts]
        else:
            del parts[0]
        memo, older, large = self._parts, self._older, []  # keys lack the space before each part
        for part in [p for p in parts if p not in memo]:
            memo[part] = older.get(part) or self._packed(SPACE + part)
            if len(part) > 64:
                large.append(part)
        out = head + b"".join(map(memo.__getitem__, parts))
        for part in large:
            memo.pop(part, None)
        if len(memo) >= MEMO:  # what was not used since the last turn goes
            self._parts, self._older = {}, memo
        return out

    def _packed(self, part: str) -> bytes:
        ids = self.encode_part(part)
        return pack(f"<{len(ids)}I", *ids)

    # -- decoding --

    def _surface(self, i: int) -> bytes:
        kind = self.types[i]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return self.unknown_surface.encode()
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return self.pieces[i].replace(SPACE, " ").encode()

    def decode(self, ids: bytes) -> str:
        """Text of the ids: control ids vanish, the first piece loses the space that encoding put there."""
        seq = np.frombuffer(ids, "<u4").tolist()
        start = 0
        while start < len(seq) and self.types[seq[start]] == CONTROL:
            start += 1
        if not self.controls.isdisjoint(seq[1:-1]):  # bytes on both sides of a control id don't make one character
            cut = [-1, *(k for k, i in enumerate(seq) if i in self.controls), len(seq)]
            runs = [b"".join(map(self.surface.__getitem__, seq[a + 1 : b])) for a, b in zip(cut, cut[1:])]
        else:
            runs = [b"".join(map(self.surface.__getitem__, seq))]
        text = "".join(run.decode("utf-8", "one_bad_byte") for run in runs)
        if start < len(seq) and self.prefix and self.types[seq[start]] == NORMAL and text.startswith(" "):
            text = text[1:]
        return text


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """The model file, read once per worker process."""
    return PieceModel(path)


def encode(df: DataFrame, model: str, text: str = "text", out: str = "ids", begin: bool = True, end: bool = True) -> DataFrame:
    """``df`` without ``text``, with the binary column ``out`` (little-endian unsigned 32-bit ids)."""
    keep = [c for c in df.columns if c not in (text, out)]
    name = free_name(keep, out)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = load(model)
        ids = [m.encode(t or "", begin, end) for t in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())], names=[*keep, name])

    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string"))
    return map_slices(rows, run, df.select(*[F.col(f"`{c}`") for c in keep], F.lit(b"").alias(name)).schema)


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` in column ``out``; null ids give ""."""
    keep = [c for c in df.columns if c != out]
    at = keep.index(ids)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = load(model)
        texts = [m.decode(x or b"") for x in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*keep, out])

    rows = df.select(*[F.col(f"`{c}`") for c in keep])
    return map_slices(rows, run, rows.withColumn(out, F.lit("")).schema)


def library(path: str) -> sentencepiece.SentencePieceProcessor:
    """The library's own processor, for comparison in tests."""
    return sentencepiece.SentencePieceProcessor(model_file=path)

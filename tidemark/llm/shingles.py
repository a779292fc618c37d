"""Hashed word shingles of many texts at once, in numpy.

Words are runs of bytes other than blank, tab, line and page breaks; A-Z count as a-z. A text's set holds a
64-bit hash for each distinct run of ``SHINGLE`` words; a shorter text has its whole word sequence as its only
element, an empty one has none.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .common import at_task_end
from .exchange import hashed

SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the base and of its inverse, kept as long as they suffice and the task runs."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def take(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 20)
            up, down = _powers(_BASE, size), _powers(_INVERSE, size)
            if size > 1 << 23:  # a very long text: not kept
                return up[:n], down[:n]
            cls.up, cls.down = up, down
        return cls.up[:n], cls.down[:n]

    @classmethod
    def drop(cls) -> None:
        cls.up = cls.down = np.zeros(0, np.uint64)


at_task_end(Powers.drop)


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the index where each text's words start (one more than texts)."""
    data = [b"" if not t else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    joined = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    word = ~_BLANK[joined]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0))
    starts, ends = edge[0::2], edge[1::2]
    up, down = Powers.take(len(joined) + 1)
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    hashes = hashed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([0, *(len(d) + 1 for d in data)])
    return hashes, np.searchsorted(starts, begins)


def shingle_sets(texts: Sequence[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(texts)
    runs = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        runs = runs * np.uint64(_BASE) + words[k : len(words) - SHINGLE + 1 + k] if len(runs) else runs
    runs = hashed(runs)
    out = []
    for a, b in zip(at, at[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            whole = 0
            for w in words[a:b].tolist():
                whole = (whole * _BASE + w + 1) & ((1 << 64) - 1)
            out.append(hashed(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

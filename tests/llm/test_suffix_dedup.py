import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import suffix_dedup as sd


def random_bytes(rng, n, alphabet):
    return bytes(rng.choice(alphabet) for _ in range(n))


def test_suffix_order_and_common_prefixes():
    rng = random.Random(1)
    for k in range(120):
        data = random_bytes(rng, rng.randint(1, 250), b"ab\0" if k % 2 else b"ab")
        data = data * (1 + k % 3)
        order = sd.suffix_order(np.frombuffer(data, np.uint8), len(data))
        assert [(data[i:] + bytes(800))[:800] for i in order] == sorted((data[i:] + bytes(800))[:800] for i in range(len(data)))
        got = sd.common_prefixes(np.frombuffer(data, np.uint8), order, 50, lanes=rng.choice([1, 3, 50]))
        for place, length in enumerate(got):
            want = 0
            if place:
                x, y = data[order[place] :], data[order[place - 1] :]
                while want < min(len(x), len(y), 50) and x[want] == y[want]:
                    want += 1
            assert length == want


def brute(rows):
    """spans and kept bytes for (rank, data) rows in order of rank"""
    seen, out = set(), []
    for data in rows:
        covered = np.zeros(len(data), bool)
        for i in range(len(data) - sd.LENGTH + 1):
            s = data[i : i + sd.LENGTH]
            if s in seen:
                covered[i : i + sd.LENGTH] = True
            seen.add(s)
        edges = np.flatnonzero(np.diff(covered.view(np.int8), prepend=0, append=0))
        out.append((list(zip(edges[::2].tolist(), edges[1::2].tolist())), np.frombuffer(data, np.uint8)[~covered].tobytes()))
    return out


def texts(rng):
    pool = ["".join(rng.choice("abcdeé \n\0") for _ in range(rng.randint(60, 400))) for _ in range(25)]
    rows = []
    for _ in range(120):
        parts = [rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 80))) for _ in range(rng.randint(0, 4))]
        text = "".join(parts)
        if rng.random() < 0.3 and len(text) > 10:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        rows.append(text)
    return [*rows, "a" * 700, "ab" * 300, "a" * 400, "", None, "x" * 99, "x" * 100, "x" * 101, pool[0] * 6, "to " * 3_000]


@pytest.mark.parametrize(("seed", "chunk"), [(1, sd.CHUNK), (2, 150)])
def test_equals_brute_force(spark, seed, chunk, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", chunk)  # in this process: see the next test for the cutting itself
    rng = random.Random(seed)
    rows = list(enumerate(texts(rng), start=-30))
    want = brute([(t or "").encode() for _, t in rows])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).withColumns({"tag": F.lit("x"), "kept": F.lit(0), "doc": F.lit(1)})
    got = {r.doc_id: r for r in sd.dedup(df).collect()}
    assert len(got) == len(rows)
    for (doc, text), (spans, kept) in zip(rows, want):
        assert ([(s["start"], s["end"]) for s in got[doc].removed], bytes(got[doc].kept), got[doc].n_bytes) == (spans, kept, len((text or "").encode())), doc
    assert sd.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [100, 137, 1000])
def test_long_texts_are_cut_without_losing_a_string(monkeypatch, chunk):
    monkeypatch.setattr(sd, "CHUNK", chunk)
    rng = random.Random(chunk)
    data = [(t or "").encode() for t in texts(rng)]
    seen = []
    for parts, which, offsets in sd._chunks(data):
        _, starts, runs, part, _, _ = sd.anchors(parts)
        begins = np.cumsum([0, *map(len, parts)])
        for s, r, p in zip(starts, runs, part):
            seen += [(int(which[p]), int(s - begins[p] + offsets[p] + k)) for k in range(r)]
    assert sorted(seen) == [(i, k) for i, d in enumerate(data) for k in range(len(d) - sd.LENGTH + 1)]


@pytest.mark.parametrize("shard", [1, 2, 5, 10_000])
def test_shards_merge_by_binary_search(shard):
    """Cells cut into shards of any size give the spans of one shard."""
    rng = random.Random(3)
    data = [(t or "").encode() for t in texts(rng)]
    keys, starts, runs, text, joined, total = sd.anchors(data)
    records = np.zeros(len(keys), sd.RECORD)
    begins = np.cumsum([0, *map(len, data)])
    wide = joined.tobytes() + bytes(sd.STRETCH)
    records["key"] = keys % 3  # few anchors, so that one's stretches fill many shards
    records["doc"], records["start"], records["run"] = text, starts - begins[text], runs
    for i, (s, r) in enumerate(zip(starts, runs)):
        own = wide[s : s + r + sd.LENGTH - 1]
        records["text"][i] = np.frombuffer(own + bytes(sd.STRETCH - len(own)), f"V{sd.STRETCH}")[0]
        records["whole"][i] = hash(own) & 0xFFFFFFFF
    again, open_ones = sd.cell_firsts(records)
    spans = sd.joined_spans(np.concatenate([again, sd.cell_repeats(open_ones, shard)]))
    got = {}
    for s in spans:
        got.setdefault(int(s["doc"]), []).append((int(s["start"]), int(s["end"])))
    assert [got.get(i, []) for i in range(len(data))] == [spans for spans, _ in brute(data)]


def test_ids_that_are_null_or_shared(spark):
    same = "s" * 50 + "t" * 70
    rows = [(1, same), (1, same), (1, same + "u"), (None, "v" + same), (0, "w" * 10)]
    got = sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.kept)) for r in sd.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 0, ("v" + same).encode()), (True, 0, b"w" * 10), (True, 1, b""), (True, 1, b""), (True, 1, b"u")]

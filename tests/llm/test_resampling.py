"""Position-table CRC and importance resampling against plain Python."""

import hashlib
import math
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import resampling
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_features(text, longest=1):
    words = WORD.findall(lowered(text))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, longest=1, least=20, buckets=10_000, seed=2024):
    def counts(texts):
        out = [0] * buckets
        for text in texts:
            for f in brute_features(text, longest):
                out[crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    total_s, total_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        found = [gain[crc32(f.encode()) % buckets] for f in brute_features(text, longest)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, len(WORD.findall(lowered(text))) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for n, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = n + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=900), st.lists(st.tuples(st.integers(0, 900), st.integers(0, 900)), max_size=12))
def test_span_crcs(data, pairs):
    spans = np.array([sorted((min(a, len(data)), min(b, len(data)))) for a, b in pairs], np.int64).reshape(-1, 2)
    got = resampling.span_crcs(np.frombuffer(data, np.uint8), spans[:, 0], spans[:, 1])
    assert got.tolist() == [crc32(data[a:b]) for a, b in spans]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ09 é\u0080\t.-\x7f~世_", max_size=60)), max_size=6), st.integers(1, 3))
def test_features(texts, longest):
    got, n, words = resampling.features(texts, longest)
    want = [[crc32(f.encode()) % 10_000 for f in brute_features(t, longest)] for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert [sorted(x.tolist()) for x in np.split(got, np.cumsum(n)[:-1])] == [sorted(w) for w in want] if texts else not len(got)
    assert words.tolist() == [len(brute_features(t)) for t in texts]


def test_very_long_word():
    text = "x" * 100_000 + " y"
    assert resampling.features([text])[0].tolist() == [crc32(b"x" * 100_000) % 10_000, crc32(b"y") % 10_000]


@pytest.mark.parametrize("longest", [1, 2])
def test_resample(spark, longest):
    docs = [(i, f"Alpha beta {i} gamma " * (i % 9)) for i in range(300)]
    docs += [(7, "Alpha beta " * 12), (7, "Alpha beta " * 12), (None, "delta " * 30), (None, None), (900, ""), (901, None), (902, "z" * 5000 + " w" * 40)]
    target = ["alpha gamma delta", None, "", "Übung macht den Meister"]
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, score int, weight int, part string")
    got = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), 30, longest)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target, 30, longest)


def test_query_and_empty(spark, tmp_path):
    docs = [(i, f"one two three {i} four " * (i % 11)) for i in range(200)]
    for name, rows in (("full", docs), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "three four")] * bool(rows), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = QUERIES["op12_resampling"][0](spark, folder)
        assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, ["three four"] * bool(rows))

"""Code intervals and hard negatives against plain Python."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives
from tidemark.llm.queries import QUERIES


def brute(rows, every=100, k=5):
    """rows: (id, label, vector of integers); rows that share an id never meet."""
    out = []
    anchors = {(i, label, tuple(v)) for i, label, v in rows if i % every == 0}
    for i, label, v in anchors:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in rows if j != i)
        near = [(j, -s) for s, j, other in scored if other == label][:k]
        for j, p in near:
            far = [(n, -s) for s, n, other in scored if other != label and 80 * p <= -100 * s <= 100 * p][:k]
            out += [(i, j, rank + 1, n, p, s) for rank, (n, s) in enumerate(far)]
    return sorted(out)


def usable(rows):
    out = []
    for i, v, label in rows:
        if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 70), st.integers(1, 40), st.integers(0, 10_000), st.sampled_from([1, 300, 10**7]))
def test_intervals_hold_the_scores(dim, n, seed, size):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-size, size + 1, (n, dim))
    codes = hard_negatives.Codes(np.arange(n), np.zeros(n, np.int64), rows)
    query = rng.integers(-size, size + 1, dim)
    scores = rows @ query
    for lower, upper in codes.narrowing(query, np.arange(n)):
        assert (lower <= scores).all() and (scores <= upper).all()


def test_intervals_narrow_the_search():
    rng = np.random.default_rng(5)
    rows = rng.integers(-100, 100, (4000, 64))
    *_, (lower, upper) = hard_negatives.Codes(np.arange(4000), np.zeros(4000, np.int64), rows).narrowing(rows[0], np.arange(4000))
    assert (upper >= np.sort(lower)[-5]).mean() < 0.1


def data(n, dim, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = [math.sin(c * (i % 12 + 1)) for c in range(dim)]
        rows.append((i, [round(x + rng.gauss(0, 0.4), 3) for x in base], i % 12 % 10))
    return rows


@pytest.mark.parametrize("dim,group_rows,block_rows", [(16, 70, 3), (70, 5000, 512)])
def test_mine(spark, dim, group_rows, block_rows):
    rows = data(600, dim, dim)
    rows += [(600 + i, rows[3][1], 3) for i in range(40)] + [(700 + i, rows[3][1], 4) for i in range(40)]  # many equal vectors
    rows += [(900, [0.0] * dim, 1), (1000, [-5.0] * dim, 1)]
    ints = usable(rows)
    frame = spark.createDataFrame(ints, "id long, label long, vector array<long>").withColumns({"request": F.lit(1), "asked": F.lit(2), "anchor": F.lit(3)})
    got = hard_negatives.mine(frame.select("*"), F.col("id") % 100 == 0, group_rows=group_rows, block_rows=block_rows)
    assert sorted(tuple(r) for r in got.collect()) == brute(ints)


def test_query_with_faults(spark, tmp_path):
    rows = data(450, 16, 1)
    rows += [(500, None, 1), (600, [1.0, None] * 8, 2), (700, [float("nan")] * 16, 2), (800, [float("inf")] * 16, 3), (900, [0.1] * 16, None), (1000, [0.2] * 3, 1), (1100, [], 1)]
    good = [r for r in rows if r[1] is None or len(r[1]) == 16]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit(9)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op13_hard_negatives"][0](spark, str(tmp_path))
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in good]
    assert sorted(tuple(r) for r in got.collect()) == brute(usable(floats))


@pytest.mark.parametrize("rows", [[], [(100, [1.0, 2.0], 1)], [(100, [], 1), (101, None, 1)]])
def test_empty(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["op13_hard_negatives"][0](spark, str(tmp_path)).collect() == []

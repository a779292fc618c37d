"""The language model against a dictionary of counts."""

import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import lm_scoring
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + ["</s>"]


class Model:
    """Interpolated modified Kneser-Ney by the book."""

    def __init__(self, texts, order):
        self.order = order
        counts = Counter()
        self.raw = Counter()
        for text in texts:
            words = ["<s>"] * (order - 1) + tokens(text)
            self.raw.update(words[order - 1 :])
            counts.update(tuple(words[i - order + 1 : i + 1]) for i in range(order - 1, len(words)))
        self.counts = {order: counts}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.context = {}
        self.discount = {}
        for k, table in self.counts.items():
            of = Counter(table.values())
            self.discount[k] = lm_scoring.discounts(of[1], of[2], of[3], of[4])
            after = defaultdict(list)
            for g, c in table.items():
                after[g[:-1]].append(c)
            self.context[k] = after

    def chance(self, gram):
        if not gram:
            return 1 / (len(self.raw) + 1)
        k = len(gram)
        lower = self.chance(gram[1:])
        after = self.context[k].get(gram[:-1])
        if not after:
            return lower
        d = (0, *self.discount[k])
        c = self.counts[k].get(gram, 0)
        return (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in after) * lower) / sum(after)

    def score(self, text):
        words = ["<s>"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.chance(tuple(words[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(words)))


def brute(rows, order):
    trains = [crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in rows]
    model = Model([t for (_, t), yes in zip(rows, trains) if yes], order)
    n, v = sum(model.raw.values()), len(model.raw)
    out = []
    for (i, text), yes in zip(rows, trains):
        words = tokens(text)
        base = sum(math.log10((model.raw[w] + 1) / (n + v + 1)) for w in words)
        out.append((i, not yes, len(words), sum(model.raw[w] > 0 for w in words), n, base, model.score(text)))
    return out


def same(got, want):
    def key(r):
        return (str(r[0]), r[2], round(r[5], 6), round(r[6], 6))

    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:7] for r in got], [r[5:7] for r in want], rtol=1e-9, atol=1e-9)


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = ["the", "The", "of", "cat", "dog", "Übung", "x" * 300, "1,2"] + [f"w{i}" for i in range(60)]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    rows = [(i, " \n".join(rng.choice(vocabulary, rng.integers(0, 40), p=weights / weights.sum()))) for i in range(150)]
    return rows + [(7, "the cat"), (7, "the cat"), (None, "the dog of"), (None, None), (900, ""), (901, None), (902, "the of " * 3000)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=30), st.integers(1, 64))
def test_pack(values, bits):
    column = np.array(values, np.uint64) >> np.uint64(64 - bits)
    assert [c.tolist() for c in lm_scoring.unpack(lm_scoring.pack(column, column[::-1]))] == [column.tolist(), column[::-1].tolist()]


@pytest.mark.parametrize("order,block_tokens,cell_tokens", [(1, 500, 100), (2, 300, 50), (2, 10**6, 10**6), (3, 300, 50), (4, 2000, 200)])
def test_score(spark, order, block_tokens, cell_tokens):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"train": F.lit(1), "block": F.lit(2), "n": F.lit("x")})
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    got = lm_scoring.score(frame.repartition(3).drop("train"), train, order, block_tokens, cell_tokens)
    same(got.drop("perplexity").collect(), brute(rows, order))


def test_chances_sum_to_one():
    model = Model(["a b a c", "b a", "c c a b d"], 3)
    known = list(model.raw) + ["never"]
    for context in (("<s>", "<s>"), ("a", "b"), ("d", "d"), ("never", "a")):
        assert math.isclose(sum(model.chance((*context, w)) for w in known), 1)


@pytest.mark.parametrize("rows", [corpus(), [], [(2, "only held out")], [(None, None)]])
def test_query(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_lm_scoring"][0](spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "boolean", "bigint", "bigint", "bigint", "double", "double"]
    same(got.collect(), brute(rows, 2))

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import importance as im


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    good, bad = [f"word{i}" for i in range(40)], [f"junk{i}" for i in range(40)]
    return [(i, " ".join(rng.choice(good if i % 4 else bad) for _ in range(rng.randint(15, 60))), int(i % 4 != 0)) for i in range(n)]


def test_weights_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 3 == 0], "doc_id long, quality int")
    ratio = im.fit(df, im.target_ids(labels), 64)
    raw, target = Counter(), Counter()
    for i, text, q in rows:
        c = Counter(im.grams(text, 64).tolist())
        raw += c
        if q and i % 3 == 0:
            target += c
    t, r = sum(target.values()) + 64, sum(raw.values()) + 64
    want = [math.log((target[b] + 1) / t) - math.log((raw[b] + 1) / r) for b in range(64)]
    assert ratio == pytest.approx(want)
    got = {x.doc_id: x for x in im.weigh(df, ratio).collect()}
    for i, text, _ in rows:
        n = len(text.split())
        assert got[i].n_grams == 2 * n - 1
        assert got[i].log_weight == pytest.approx(sum(want[b] for b in im.grams(text, 64)))


def test_selection_takes_the_largest_keys_and_the_good_texts(spark):
    rows = corpus(2)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 120], "doc_id long, quality int")
    out = im.select(df, labels, share=0.75).collect()
    ordered = sorted(out, key=lambda x: (-x.gumbel_key, x.doc_id))
    assert [x["rank"] for x in ordered] == list(range(1, 241)) and [x.selected for x in ordered] == [k < 180 for k in range(240)]
    quality = {i: q for i, _, q in rows if i >= 120}  # held out
    right = [x.selected == bool(quality[x.doc_id]) for x in out if x.doc_id in quality]
    assert np.mean(right) > 0.95


def test_noise_is_gumbel(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    keys = [x.gumbel_key for x in im.select(df, spark.createDataFrame([], "doc_id long, quality int"), 0.5).collect()]
    assert np.mean(keys) == pytest.approx(0.5772, abs=0.08) and np.std(keys) == pytest.approx(math.pi / math.sqrt(6), abs=0.08)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "two words"), (4, "long " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rank": F.lit(1), "quality": F.lit(0)})
    labels = spark.createDataFrame([(3, 1), (3, 1), (None, 1), (9, None)], "doc_id long, quality int")
    out = im.select(df, labels, 0.5).collect()
    assert sorted(x["rank"] for x in out) == [1, 2, 3, 4, 5, 6] and sum(x.selected for x in out) == 3
    assert {x.doc_id: x.n_grams for x in out} == {1: 0, 2: 0, 3: 1, None: 3, 4: 99_999}
    assert im.select(df.limit(0), labels).count() == 0

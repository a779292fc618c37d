from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from helpers import hours, to_spark
from pyspark.sql import functions as F

from tidemark.operators import explain, models

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = 2 * x[:, 0] + np.where(x[:, 1] > 0, 3, -1) * x[:, 2] + rng.normal(0, 0.1, 400)
    return to_spark(spark, pd.DataFrame(x, columns=NAMES).assign(y=y, ts=hours(400))).cache()


def brute_force(nodes, row):
    """Average over coalitions; unknown features follow the training cover."""

    def value(known):
        total = 0.0
        for _, tree in nodes.groupby("tree"):
            rows = {int(r.id): r for r in tree.itertuples()}

            def walk(i):
                n = rows[i]
                if n.left < 0:
                    return n.prediction
                f, left, right = int(n.feature), int(n.left), int(n.right)
                if f in known:
                    return walk(left if row[f] <= n.cut else right)
                return (rows[left].cover * walk(left) + rows[right].cover * walk(right)) / n.cover

            total += walk(0) * tree["weight"].iloc[0]
        return total

    phi = []
    for f in range(3):
        others = [g for g in range(3) if g != f]
        phi.append(sum(
            factorial(k) * factorial(2 - k) / 6 * (value({*s, f}) - value(set(s)))
            for k in range(3) for s in combinations(others, k)
        ))
    return value(set()), phi


def test_histogram_boosting_adds_up_and_equals_brute_force(table):
    model = models.train_histogram_boosting(table, NAMES, "y", rounds=4, depth=3, rate=0.3)
    rows = table.orderBy("ts").limit(5)
    told = explain.explain_trees(model, rows, NAMES).join(models.score(model, rows, "y"), "ts").orderBy("ts").collect()
    nodes = pd.concat(
        pd.DataFrame({"tree": n, "id": range(len(t.left)), "prediction": t.value[:, 0], "cover": t.cover, "left": t.left, "right": t.right,
                      "feature": t.feature, "cut": t.cut, "weight": 1.0}) for n, t in enumerate(model.model.trees)
    )
    for r, x in zip(told, rows.orderBy("ts").select(*NAMES).collect()):
        base, phi = brute_force(nodes, list(x))
        np.testing.assert_allclose(r["base"], base + model.model.start[0], rtol=1e-9)
        np.testing.assert_allclose(r["phi"], phi, atol=1e-9)
        np.testing.assert_allclose(r["base"] + sum(r["phi"]), r["predicted"], atol=1e-9)


def test_long_paths_equal_sums_over_coalitions():
    """Nine features on a path; the closed form over coalition sizes is the definition."""
    rng = np.random.default_rng(1)
    d = 9
    group = explain.LeafGroup(rng.normal(size=3), np.tile(np.arange(d), (3, 1)), rng.normal(-1, 1, (3, d)), rng.normal(1, 1, (3, d)), rng.uniform(0.05, 0.9, (3, d)))
    x = rng.normal(size=(6, d))
    want = np.zeros_like(x)
    for r in range(6):
        for leaf in range(3):
            one = (x[r] > group.low[leaf]) & (x[r] <= group.high[leaf])
            for i in range(d):
                others = [j for j in range(d) if j != i]
                for k in range(d):
                    for s in combinations(others, k):
                        rest = np.prod([one[j] if j in s else group.cover[leaf, j] for j in others])
                        want[r, i] += factorial(k) * factorial(d - 1 - k) / factorial(d) * rest * (one[i] - group.cover[leaf, i]) * group.value[leaf]
    np.testing.assert_allclose(explain.group_attribution(group, x), want, atol=1e-9)


def test_any_model_equals_the_definition(table):
    """A model with interactions: three features have six subsets, so the values are exact."""
    predict = lambda df: df.withColumn("predicted", F.col("a") * F.col("b") + F.col("c") ** 2)
    rows, back = table.orderBy("ts").limit(3), table.orderBy(F.col("ts").desc()).limit(10)
    long = explain.explain_any(predict, rows, back, NAMES, background_size=10).toPandas()
    b = back.select(*NAMES).toPandas().to_numpy()
    for r in rows.collect():
        x = np.array([r[n] for n in NAMES])

        def value(known, x=x):
            mixed = np.where(np.isin(np.arange(3), list(known)), x, b)
            return (mixed[:, 0] * mixed[:, 1] + mixed[:, 2] ** 2).mean()

        for i, name in enumerate(NAMES):
            others = [j for j in range(3) if j != i]
            want = sum(factorial(k) * factorial(2 - k) / 6 * (value({*s, i}) - value(s)) for k in range(3) for s in combinations(others, k))
            got = long[(long["ts"] == r["ts"]) & (long["feature"] == name)]["phi"].iloc[0]
            np.testing.assert_allclose(got, want, atol=1e-8)


def test_coalitions_are_distinct_and_bounded():
    for p, most in ((1, 98), (2, 98), (5, 98), (38, 98), (38, 400)):
        subsets, weights = explain.coalition_table(p, most, 0)
        assert len({tuple(s) for s in subsets}) == len(subsets) <= most and (weights > 0).all()
        assert p < 3 or len(subsets) >= min(2**p - 2, most - 1)
        coefficients = np.arange(p, dtype=float)  # a linear model gets its own effects back
        means = subsets @ coefficients
        phi = coefficients.sum() / p + explain.coalition_solver(subsets, weights) @ (means - coefficients.sum() * subsets.mean(axis=1))
        np.testing.assert_allclose(phi, coefficients if p > 1 else [0.0], atol=1e-9)


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_trees_equal_brute_force(table, kind):
    if kind == "forest":
        model = models.train_random_forest(table, NAMES, "y", numTrees=4, maxDepth=4)
    else:
        model = models.train_boosted_trees(table, NAMES, "y", maxIter=4, maxDepth=3, stepSize=0.3)
    nodes = explain.tree_nodes(model.stages[-1])
    rows = table.orderBy("ts").limit(5)
    told = explain.explain_trees(model, rows, NAMES).join(models.score(model, rows, "y"), "ts").orderBy("ts").collect()
    xs = rows.orderBy("ts").select(*NAMES).collect()
    for r, x in zip(told, xs):
        base, phi = brute_force(nodes, list(x))
        np.testing.assert_allclose(r["base"], base, rtol=1e-9)
        np.testing.assert_allclose(r["phi"], phi, atol=1e-9)
        np.testing.assert_allclose(r["base"] + sum(r["phi"]), r["predicted"], atol=1e-9)


def test_any_model_is_additive_and_exact_for_lines(table):
    predict = lambda df: df.withColumn("predicted", 3 * F.col("a") - 2 * F.col("b"))
    rows = table.orderBy("ts").limit(4)
    back = table.orderBy(F.col("ts").desc()).limit(30)
    long = explain.explain_any(predict, rows, back, NAMES, background_size=30).toPandas()
    means = back.agg(*[F.avg(c).alias(c) for c in NAMES]).first()
    for r in rows.collect():
        phi = long[long["ts"] == r["ts"]].set_index("feature")["phi"]
        np.testing.assert_allclose(phi["a"], 3 * (r["a"] - means["a"]), atol=1e-9)
        np.testing.assert_allclose(phi["b"], -2 * (r["b"] - means["b"]), atol=1e-9)
        np.testing.assert_allclose(phi["c"], 0, atol=1e-9)

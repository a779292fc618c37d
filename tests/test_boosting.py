import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting


def frame(spark, x, y):
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, np.asarray(y).reshape(len(x), -1)))]
    return spark.createDataFrame(rows, "id long, x array<double>, y array<double>").repartition(3)


def data(n=300, p=4, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, p)), 2)
    y = np.column_stack([3 * (x[:, 0] > 0.2) + x[:, 1], x[:, 2] ** 2, -x[:, 0]]) + rng.normal(0, 0.05, (n, 3))
    return x, y


def brute_tree(x, residual, depth, rate, penalty=1.0):
    """Every cut between two values of every column, by the definition of the gain."""

    def score(r):
        return (r.sum(axis=0) ** 2).sum() / (len(r) + penalty)

    out = np.empty_like(residual)

    def walk(rows, left):
        best = None
        for f in range(x.shape[1]) if left else ():
            for cut in np.unique(x[rows, f])[:-1]:
                goes = x[rows, f] <= cut
                gain = score(residual[rows[goes]]) + score(residual[rows[~goes]]) - score(residual[rows])
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                    best = gain, f, cut
        if best is None:
            out[rows] = rate * residual[rows].sum(axis=0) / (len(rows) + penalty)
            return
        goes = x[rows, best[1]] <= best[2]
        walk(rows[goes], left - 1)
        walk(rows[~goes], left - 1)

    walk(np.arange(len(x)), depth)
    return out


@pytest.mark.parametrize("node_rows", [10**6, 40, 0])
@pytest.mark.parametrize("outputs", [1, 3])
def test_trees_equal_brute_force(spark, outputs, node_rows):
    x, y = data()
    x, y = np.round(x, 1), y[:, :outputs]
    model = boosting.train(frame(spark, x, y), rounds=3, depth=3, rate=0.3, row_share=1.0, column_share=1.0, node_rows=node_rows)
    want = np.tile(y.mean(axis=0), (len(y), 1))
    for _ in range(3):
        want = want + brute_tree(x, y - want, 3, 0.3)
    np.testing.assert_allclose(model.guess(x), want, atol=1e-9)


def test_samples_and_node_sizes_do_not_depend_on_layout(spark):
    x, y = data(500)
    df = frame(spark, x, y)
    options = {"ids": ["id"], "rounds": 4, "depth": 4, "rate": 0.2, "row_share": 0.7, "column_share": 0.5}
    one = boosting.train(df, **options)
    two = boosting.train(df.repartition(7), node_rows=60, **options)
    np.testing.assert_allclose(one.guess(x), two.guess(x), atol=1e-9)
    assert len({tuple(t.feature[t.feature >= 0]) for t in one.trees}) > 1
    assert all(len(set(t.feature[t.feature >= 0])) <= 2 for t in one.trees)


def test_it_learns_all_outputs_and_survives_checkpoints(spark, monkeypatch):
    monkeypatch.setattr(boosting, "CHECKPOINT", 5)
    x, y = data(800, seed=2)
    model = boosting.train(frame(spark, x[:600], y[:600]), rounds=30, depth=4, rate=0.2)
    error = ((model.guess(x[600:]) - y[600:]) ** 2).mean(axis=0)
    assert (error < 0.25 * y[600:].var(axis=0)).all()
    got = model.predict(frame(spark, x[600:], y[600:])).orderBy("id").select("y_hat").toPandas()["y_hat"]
    np.testing.assert_allclose(np.stack(got), model.guess(x[600:]), atol=1e-12)


def test_faulty_rows(spark):
    rows = [(1, [1.0, None], [2.0]), (2, [float("nan"), 3.0], [1.0]), (3, [2.0, 1.0], None), (4, [2.0, 1.0], [None]), (5, [4.0, 2.0], [9.0])] * 4
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<double>")
    model = boosting.train(df, rounds=10, depth=2, rate=0.5, row_share=1.0, column_share=1.0)
    got = model.guess(np.array([[1.0, np.nan], [np.nan, 3.0], [4.0, 2.0]]))[:, 0]
    assert np.abs(got - [2, 1, 9]).max() < 1
    with pytest.raises(ValueError):
        boosting.train(df.where("id = 3"), rounds=1)

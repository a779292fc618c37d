import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import topk_search as tk


def brute(ids, rows, wanted, k):
    out = set()
    for i in wanted:
        score = rows @ rows[ids.index(i)]
        order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-score[j], ids[j]))[:k]
        out |= {(i, r + 1, ids[j], int(score[j])) for r, j in enumerate(order)}
    return out


def search(spark, ids, rows, wanted, k=3, **sizes):
    df = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in zip(ids, rows)], "id long, vector array<long>")
    asked = df.where(F.col("id").isin(wanted))
    return {tuple(r) for r in tk.top_k(df, asked, k, **sizes).collect()}


def test_shards_and_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = rng.integers(-300, 300, (400, 6))
    rows[50:170] = rows[0]  # many ties, also at the k-th place
    ids = [int(x) for x in rng.permutation(4000)[:400]]
    wanted = ids[::9]
    assert search(spark, ids, rows, wanted, k=7, shard_rows=90, block_rows=10) == brute(ids, rows, wanted, 7)


def test_large_values_and_few_candidates(spark):
    rows = np.array([[1 << 30, -(1 << 30)], [(1 << 30) + 1, 5], [7, 1]])
    assert search(spark, [5, 1, 9], rows, [5, 9], k=5) == brute([5, 1, 9], rows, [5, 9], 5)


def test_unusable_and_repeated_rows(spark):
    data = [
        (0, [1.0, 0.5]), (50, [0.5, 0.25]), (50, [0.5, 0.25]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]), (7, [1.0]), (8, []), (100, [-1.0, -0.001]),
    ]
    df = spark.createDataFrame(data, "id long, embedding array<float>").select("id", tk.scaled(F.col("embedding")).alias("vector"))
    assert df.where("id = 100").first().vector == [-256, -1]
    got = sorted(tuple(r) for r in tk.top_k(df, df.where("id % 50 = 0"), 5).collect())
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 50), (0, 2, 50), (0, 3, 100), (50, 1, 0), (50, 2, 100), (100, 1, 50), (100, 2, 50), (100, 3, 0)]
    assert tk.top_k(df.limit(0), df.limit(0), 5).count() == 0
    assert tk.top_k(df.where("id = 0"), df.where("id = 0"), 5).count() == 0


def test_blocks_times_shards_are_never_broadcast(spark):
    # 20 blocks of some 2.6 kB are far below the limit (a broadcast is 1 MiB at least); 40 copies of them, one a shard, are not
    rng = np.random.default_rng(2)
    rows = rng.integers(-200, 200, (800, 8))
    ids = list(range(800))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1500000")
    try:
        assert search(spark, ids, rows, ids[::2], k=3, shard_rows=20, block_rows=20) == brute(ids, rows, ids[::2], 3)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_plan_has_no_join_and_no_broadcast(spark):
    df = spark.createDataFrame([(i, [i, 1 - i]) for i in range(60)], "id long, vector array<long>")
    plan = tk.top_k(df, df.where("id % 5 = 0"), 2, shard_rows=10, block_rows=4)._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "Join" not in plan and "Generate" not in plan


def test_grid_of_several_lines_and_columns(spark, monkeypatch):
    monkeypatch.setattr(tk, "HELD", 4 * 6 * 100)  # 100 vectors a cell
    rng = np.random.default_rng(3)
    rows = rng.integers(-300, 300, (500, 6))
    ids = [int(x) for x in rng.permutation(4000)[:500]]
    assert search(spark, ids, rows, ids[::2], k=4, shard_rows=50, block_rows=25) == brute(ids, rows, ids[::2], 4)


def test_trees_equal_brute_force_in_every_precision():
    rng = np.random.default_rng(4)
    for high, repeated in ((1, 1), (200, 1), (200, 40), (1 << 20, 3), (1 << 29, 1)):
        rows = np.repeat(rng.integers(-high, high + 1, (1500 // repeated, 5)), repeated, axis=0)
        ids = rng.permutation(5000)[: len(rows)]
        places = np.arange(0, len(rows), 31)
        best = tk.Best(len(places), 4)
        for part in np.array_split(np.arange(len(rows)), 3):
            part = part[tk.needed(ids[part], rows[part], 4)]
            tree = tk.BallTree.load(tk.BallTree.build(ids[part], tk._small(rows[part])).dump())
            tree.search(ids[places], tk._small(rows[places]), best)
        got = {(int(ids[p]), r + 1, int(best.ids[q, r]), int(best.scores[q, r])) for q, p in enumerate(places) for r in range(4)}
        assert got == brute(ids.tolist(), rows, [int(ids[p]) for p in places], 4)


def test_what_equal_vectors_need():
    ids = np.array([7, 3, 3, 3, 9, 8, 1, 3])
    rows = np.array([[1, 2]] * 6 + [[2, 1], [1, 2]], np.int16)
    # of the vector (1, 2): two rows of each of the three smallest ids, and the other vector's row
    kept = tk.needed(ids, rows, 2)
    assert sorted(zip(ids[kept].tolist(), rows[kept, 0].tolist())) == [(1, 2), (3, 1), (3, 1), (7, 1), (8, 1)]

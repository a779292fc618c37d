import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding


@pytest.mark.parametrize("seed", range(5))
def test_plans_place_every_group_once(seed):
    rng = random.Random(seed)
    runs = list({rng.randint(1, 90): rng.randint(1, 40) for _ in range(30)}.items())
    for made, capacity in ((sharding.pack_into(runs, 100), 100), (sharding.near_equal(runs, 5), None)):
        placed, load = collections.Counter(), collections.Counter()
        for size, number, which in made:
            placed[size] += number
            load[which] += size * number
        assert placed == dict(runs)
        if capacity:
            assert max(load.values()) <= capacity and len(load) <= -(-sum(s * n for s, n in runs) // 60)
        else:
            assert len(load) <= 5 and max(load.values()) - min(load.values()) <= 90


def test_documents(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(500)] + [(1000 + i, "copy") for i in range(150)]
    rows += [(2000, None), (2001, ""), (2002, "é" * 20_000), (2003, "same id"), (2003, "same id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"size": F.lit(1), "shard": F.lit(2), "bucket": F.lit("b")})
    out = sharding.shard(df, 4).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(i for i, _ in rows)
    of = {r.doc_id: r for r in out}
    for i, text in rows:
        data = (text or "").encode()
        assert (of[i].size, of[i].text_crc32) == (len(data) + 1, zlib.crc32(data))
    assert len({of[1000 + i].shard for i in range(150)}) == 1 and of[2000].shard == of[2001].shard
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in out:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(load) == [0, 1, 2, 3] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    rest = sorted(load.values())[:3]
    assert rest[2] - rest[0] <= 0.02 * rest[2]  # the long text has a shard of its own
    assert sharding.shard(df.limit(0), 4).count() == 0

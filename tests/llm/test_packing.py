import collections
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("text_of", ["abcdeT'sre. ,", "éàüΣσİ́İ. \n\t\v\x1c\x85 ", "0129 a-b!!_", "ſßŸŉ DžKÅ.,"])
def test_ids_equal_the_tokenizer(text_of):
    own = packing.WordTokenizer(PATH)
    rng = random.Random(text_of)
    for n in range(1500):
        text = "".join(rng.choice(text_of) for _ in range(rng.randrange(25)))
        text += rng.choice(["", "", "<|endoftext|>", " <|startoftext|>x", "<|endoftext"]) if n % 5 == 0 else ""
        want = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert own.ids(text) == np.array(want, "<u4").tobytes(), repr(text)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_length_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 64])
    histogram = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(0, 25))}
    made = packing.plan(dict(histogram), capacity)
    used = collections.Counter()
    for lengths, times in made:
        assert 0 < sum(lengths) <= capacity and times > 0
        for x in lengths:
            used[x] += times
    assert used == histogram


def test_exact_complements_are_found():
    made = packing.plan({10: 3, 7: 2, 3: 1, 2: 1, 1: 1, 5: 1, 4: 1}, 10)
    assert sum(n for _, n in made) == 6 and sum(n for x, n in made if sum(x) == 10) == 5
    assert packing.plan({6: 1, 2: 1, 1: 2}, 10) == [((6, 2, 1, 1), 1)]


def test_documents_are_packed_whole(spark):
    rows = [(i, " ".join(["word"] * n)) for i, n in enumerate([1, 5, 30, 0, 64, 200, 7, 7, 7] + [9] * 60)]
    rows += [(100, None), (100, None), (None, "a b c"), (7, "word " * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit("x"), "rank": F.lit(1), "bucket": F.lit(None)})
    out = packing.pack_documents(df, PATH, capacity=32).collect()
    assert collections.Counter(r.doc_id for r in out if r.piece == 0) == collections.Counter(i for i, _ in rows)
    tokenizer = packing.WordTokenizer(PATH).tokenizer
    sequences = collections.defaultdict(list)
    for r in out:
        assert len(r.ids) == 4 * r.length and (r.length <= 32)
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 32
    pieces = {(r.doc_id, r.piece): bytes(r.ids) for r in out}
    long_one = b"".join(pieces[5, p] for p in range(7))
    assert long_one == np.array([*tokenizer.encode("word " * 200).ids, 0], "<u4").tobytes()
    joined = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packing.pack_documents(df, PATH, capacity=32)).collect()}
    assert sum(map(len, joined.values())) == sum(4 * r.length for r in out)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_bad_lengths_raise(spark):
    df = spark.createDataFrame([(1, 3), (2, None)], "id long, length long")
    with pytest.raises(ValueError):
        packing.pack(df, ["id"], capacity=8)

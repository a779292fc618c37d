import random

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import sentencepiece_bpe as bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return bpe.PieceModel(PATH)


@pytest.fixture(scope="module")
def library():
    return bpe.library(PATH)


def by_library(library, text):
    ids = library.encode(text, add_bos=True, add_eos=True)
    return np.array(ids, "<u4").tobytes(), library.decode(ids)


@pytest.mark.parametrize("alphabet", [" ▁ab", "  \n\tthe THE.,", "abcdefghinorst ", "éàü€ł𝄞\0�<0xA>s/", "aaaa  ", "0189 .-+()"])
def test_random_texts_equal_the_library(model, library, alphabet):
    rng = random.Random(alphabet)
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 21, 60])))
        ids = model.encode(text, True, True)
        assert (ids, model.decode(ids)) == by_library(library, text), repr(text)


def test_runs_of_spaces_and_long_texts(model, library):
    texts = [f(n) for n in range(1, 40) for f in (lambda n: " " * n, lambda n: "a" + " " * n + "b", lambda n: "▁" * n + "\n")]
    for text in [*texts, "x" * 3_000, "ab " * 20_000, "1234567890" * 500]:
        assert model.encode(text, True, True) == by_library(library, text)[0], repr(text[:40])


def test_bytes_that_are_no_text_decode_like_the_library(model, library):
    rng = random.Random(2)
    for _ in range(400):
        ids = [rng.choice([0, 1, 2, 3 + 0xE2, 3 + 0x82, 3 + 0xAC, 3 + 0xFF, 300, 29871]) for _ in range(rng.randrange(8))]
        assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_frames(spark, library):
    rows = [(1, None, "a"), (2, "", "b"), (3, "Hello  world", None), (3, "Hello  world", "x"), (None, "é" * 5_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a column called like the result
    out = bpe.decode(bpe.encode(df.drop("ids"), PATH), PATH).collect()
    got = sorted((r.doc_id or 0, bytes(r.ids), r.decoded) for r in out)
    assert got == sorted((r[0] or 0, *by_library(library, r[1] or "")) for r in rows)
    assert bpe.encode(df, PATH).count() == 5 and bpe.encode(df.limit(0), PATH).count() == 0

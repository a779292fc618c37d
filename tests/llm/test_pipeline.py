import random
import re

import corpus_pipeline as cp
import public_tokenizers
from pyspark.sql import functions as F
from test_jaccard_join import brute as components
from test_line_dedup import brute as repeated
from test_pii import brute as personal
from test_quality_rules import brute_kept

from tidemark.llm import line_dedup
from tidemark.llm.packing import WordTokenizer


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(600)]

    def sentence(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."

    shared = [sentence(14) for _ in range(4)]
    texts = [" ".join(sentence(rng.randint(9, 14)) for _ in range(rng.randint(4, 9))) for _ in range(60)]
    texts = [t + " " + rng.choice(shared) if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts += [texts[i] for i in range(5)] + [texts[i].replace(" a", " b", 1) + " extra" for i in range(5, 12)]
    texts += [t + f" write to user{i}@mail.example.com or 10.0.0.{i} now" for i, t in enumerate(texts[20:26])]
    texts += ["too short", "", None, " ".join(w + "###" for w in sentence(40).split()), sentence(9) * 30]
    rng.shuffle(texts)
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def test_stages_equal_plain_python(spark):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    texts = {r[0]: r[1] for r in rows}
    want = dict(texts)
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), schema)
        got = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == list(cp.DOCUMENT_COLUMNS)
        if name == "quality_rules":
            verdicts = brute_kept([(r[1], r[2], r[3]) for r in rows])
            want = {r[0]: r[1] for r, kept in zip(rows, verdicts) if kept}
            assert 0.9 * len(rows) < len(want) < len(rows) - 3
        elif name == "ngram_jaccard_join":
            first = {c for _, c in components(list(want.items())).values()}
            assert len(first) < len(want)
            want = {d: t for d, t in want.items() if d in first}
        elif name == "substring_dedup":
            spans = dict(repeated(sorted(want.items()), "sentence", line_dedup.MIN_WORDS))
            assert any(spans.values())
            want = {d: "".join(c for i, c in enumerate(t) if not any(a <= i < b for a, b in spans[d])) for d, t in want.items()}
        else:
            kinds = ("email", "ip", "card", "phone")
            for d, t in want.items():
                for start, k, end in reversed(personal(t)):
                    t = t[:start] + f"<{kinds[k]}>" + t[end:]
                want[d] = t
            assert any(re.search("<email>.*<ip>", t) for t in want.values())
        assert got == want, name
    tokenizer = WordTokenizer(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    placed = cp.STAGES[-1][1](spark, docs, "").collect()
    total = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    assert {d: sum(r.length for r in placed if r.doc_id == d) for d in want} == total
    assert len({r.sequence_id for r in placed}) == -(-sum(total.values()) // 2048)


def test_run_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(corpus(), schema).write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert out.count() > 0 and out.agg(F.max("length")).first()[0] <= 2048
    empty = spark.createDataFrame([], schema)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, "").count() == 0

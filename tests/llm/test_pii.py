import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii
from tidemark.llm.queries import QUERIES

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    spans = [(m.start(), k, m.end()) for k, name in enumerate(BASE) for m in re.finditer(BASE[name], text or "") if holds(name, m.group())]
    return sorted(spans)


def base(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: [tuple(s) for s in r.base] for r in pii.find(df, rounds=0).collect()}


ALPHABETS = ["ab.@-_ ", "012. ", "0123456789 - ", "+0123 ().-x", "a1@.+é𝄞 -\n", "5.255+@0a "]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_random_texts_equal_the_base_patterns(spark, alphabet):
    rng = random.Random(alphabet)
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(1200)]
    got = base(spark, rows)
    for i, text in rows:
        assert got[i] == brute(text), repr(text)


def test_cards_and_odd_rows(spark):
    rng = random.Random(9)
    rows = [(0, None), (1, ""), (2, "x" * 200_000 + "@"), (3, "1" * 100_000), (4, "a.b" * 50_000), (5, "+1" * 50_000), (6, "1.1.1.1 " * 500), (7, "mail a@b.c_x@d.e.@f.g ")]
    rows += [(8, "4111 1111 1111 1111"), (9, "𝄞𝄞 4111-1111-1111-1111 +1 (017) 555-7713, 0010.2.3.4 1.2.3.4.5.6.7.256")]
    for i in range(10, 400):
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(12, 21)))
        digits = next(d for d in (digits[:-1] + str(c) for c in range(10)) if luhn(d)) if i % 2 else digits
        rows.append((i, "n " + "".join(d + rng.choice(["", "", "", " ", "-"]) for d in digits) + rng.choice(["", " 1", "  1", "x"])))
    got = base(spark, rows)
    for i, text in rows:
        assert got[i] == brute(text), repr((text or "")[:80])
    assert sum(map(len, got.values())) > 150


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [f"please call me at +1 (20{i}) 555-{1000 + i} thanks" for i in range(8)] + [f"the card number 4111 1111 1111 1111 was" for _ in range(3)]
    unseen = ["please call me at 0171/55512345 thanks", "ask and call me at 0171/55512345 or", "items in stock 4455667 left", "items in stock 7788990 left"]
    others = [f"they paid in total {10_000 + i} euros" for i in range(30)]
    rows = list(enumerate([*seeds, *unseen, *others, None, "", "please call me at"]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "base": F.lit("x"), "found": F.lit(2), "tokens": F.lit(0)})
    found = {r.doc_id: [tuple(s) for s in r.found] for r in pii.find(df).collect() if r.found}
    assert found == {11: [(18, 3, 31)], 12: [(19, 3, 32)]}
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert masked[0] == "please call me at <phone> thanks" and masked[8] == "the card number <card> was" and masked[11] == "please call me at <phone> thanks"
    assert masked[13] == unseen[2] and masked[len(rows) - 3] is None and len(masked) == len(rows)
    assert pii.mask(df).columns == df.columns


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "x@y.z"), (1, "x@y.z"), (1, "none"), (None, "1.2.3.4")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n) for r in pii.find(df).select("doc_id", F.size("base").alias("n")).collect())
    assert got == [(0, 1), (1, 0), (1, 1), (1, 1)]
    assert sorted(r.text for r in pii.mask(df).collect()) == ["<email>", "<email>", "<ip>", "none"]
    assert pii.find(df.limit(0)).count() == 0 and pii.mask(df.limit(0)).count() == 0


def test_contexts_across_identifiers(spark):
    seeds = [f"please call me at +1 (20{i}) 555-{1000 + i} or +1 (21{i}) 555-{1000 + i} thanks" for i in range(20)]
    lists = [f"please call me at 0171/5551{i}34 or 0171/5559{i}99" for i in range(4)]
    df = spark.createDataFrame(list(enumerate(seeds + lists)), "doc_id long, text string")
    found = {r.doc_id: [tuple(s) for s in r.found] for r in pii.find(df).collect() if r.found}
    assert found == {20 + i: [(18, 3, 30), (34, 3, 46)] for i in range(4)}


def test_rounds_go_on_while_they_find(spark):
    """Instances of one kind, each pattern shared with the next only through instances found before."""
    edges = [(f"p{n}", f"i{n}-{j}") for n in range(7) for j in range(8)]
    edges += [(f"p{n + 1}", f"i{n}-{j}") for n in range(6) for j in range(8)]
    seeds = [(3, f"i0-{j}") for j in range(8)]
    edges += [("p0", f"s{j}") for j in range(8)]
    graph = spark.createDataFrame(edges, "pattern string, instance string"), spark.createDataFrame(seeds, "kind int, instance string")
    patterns, known = pii.bootstrap(*graph, min_share=0.5, min_score=0.4)
    assert known.count() == 7 * 8 + 8 and patterns.count() == 7


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "x@y.z", "a", "b", "c"), (2, "none", "d", "e", "f")], "doc_id long, text string, key string, spans string, __key string")
    assert sorted(map(tuple, pii.mask(df).collect())) == [(1, "<email>", "a", "b", "c"), (2, "none", "d", "e", "f")]


def test_query(spark, tmp_path):
    """All contract columns of the registered query."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("a1@.+ 0123456789-()") for _ in range(rng.randrange(80)))) for i in range(800)]
    rows += [(3, "x@y.z 1.2.3.4 4111 1111 1111 1111 +1 (201) 555-1000"), (3, "x@y.z 1.2.3.4 4111 1111 1111 1111 +1 (201) 555-1000"), (None, "a@b.c"), (None, None), (900, None), (901, "")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_email": F.lit(9), "base": F.lit("x"), "key": F.lit(1)}).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_pii"][0](spark, str(tmp_path))
    want = []
    for i, text in rows:
        spans = brute(text)
        joined = ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in spans)
        want.append((i, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(joined.encode()).hexdigest()))
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    assert [got.schema[c].dataType.simpleString() for c in columns] == ["bigint"] * 5 + ["string"]
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want))
    for i, spans in got.select("doc_id", "spans").collect():
        if i is not None and i != 3 and i < 800:
            assert {f"{list(BASE)[k]}:{a}:{b}" for a, k, b in brute(rows[i][1])} <= set(spans.split(","))


def test_digest_format(spark):
    df = spark.createDataFrame([(1, "x@y.z 1.2.3.4")], "doc_id long, text string")
    row = pii.find(df).select(F.sha2(pii.joined(F.col("base")), 256).alias("h")).first()
    assert row.h == hashlib.sha256(b"email:0:5,ip:6:13").hexdigest()


def test_overlapping_spans_are_masked_to_the_last_end(spark):
    rows = [(1, "at 10.0.0.4111 1111 1111 1111 and"), (2, "at 10.0.0.4 4111 1111 1111 1111 and"), (3, "call +1 (201) 555-1000@b.cd now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {d: brute(t) for d, t in rows}
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    overlaps = 0
    for d, text in rows:
        want, at = "", 0
        for start, k, end in spans[d]:
            overlaps += start < at < end
            want, at = (want + text[at:start] + f"<{list(BASE)[k]}>", end) if start >= at else (want, max(at, end))
        assert masked[d] == want + text[at:], (spans[d], masked[d])
    assert overlaps and masked[3] == "call <phone> now"

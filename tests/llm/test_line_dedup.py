import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup as ld


@pytest.mark.parametrize("unit", ["line", "sentence"])
def test_cutting_loses_nothing(unit):
    rng = random.Random(unit)
    for _ in range(3000):
        text = "".join(rng.choice("ab .!?\n  \t") for _ in range(rng.randrange(30)))
        assert "".join(ld.cut(text, unit)) == text
    for text in ("!" * 50_000 + "a", "! " * 30_000, "a" * 100_000, "\n" * 50_000, "?!" * 20_000 + " x"):
        assert "".join(ld.cut(text, unit)) == text
    assert ld.cut("A b. C d!! E.f g. \nH... I.  J", "sentence") == ["A b. ", "C d!! ", "E.f g. ", "\n", "H... ", "I.  ", "J"]


def brute(rows, unit, least):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        doc, text = rows[i]
        at, spans = 0, []
        for part in ld.cut(text or "", unit):
            words = part.lower().split()
            if len(words) >= least and seen.setdefault(" ".join(words), (doc, at)) != (doc, at):
                spans.append((at, at + len(part)))
            at += len(part)
        out.append((doc, spans))
    return out


@pytest.mark.parametrize("unit", ["line", "sentence"])
def test_equals_brute_force(spark, unit):
    rng = random.Random(7)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4))) + rng.choice([". ", "\n", "! "]) for _ in range(60)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in rng.sample(range(-50, 500), 200)]
    rows += [(900 + i, "A a  a a. ") for i in range(80)] + [(None, "a A a a."), (1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"doc": F.lit("x"), "found": F.lit(0), "removed": F.lit("old")})
    got = ld.dedup(df, unit, min_words=2).collect()
    want = dict(brute(rows, unit, 2))
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        spans = [(s["start"], s["end"]) for s in r.removed]
        assert spans == want[r.doc_id], r
        text = texts[r.doc_id]
        left = "".join(c for i, c in enumerate(text or "") if not any(a <= i < b for a, b in spans))
        assert r.text == (None if text is None else left)
    assert ld.dedup(df.limit(0), unit).count() == 0


def test_rows_that_share_an_id(spark):
    rows = [(1, "one two three.\nfour five six."), (1, "one two three.\nfour five six."), (1, "seven eight nine.\nfour five six."), (2, "four five six.")]
    got = ld.dedup(spark.createDataFrame(rows, "doc_id long, text string"), "line", min_words=2).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, rows[0][1]), (1, rows[0][1]), (1, "seven eight nine.\n"), (2, "")])


def test_first_of_each_digest():
    records = np.zeros(9, ld.RECORD)
    records["key"], records["doc"], records["start"] = [5, 5, 5, 9, 9, 5, 7, 7, 7], [3, 1, 2, 1, 1, 1, 4, 4, 3], [0, 4, 0, 2, 8, 4, 1, 1, 0]
    ordered, first = ld._first_per_digest(records)
    assert [(int(r["key"]), int(r["doc"]), int(r["start"])) for r in ordered[first]] == [(5, 1, 4), (5, 1, 4), (7, 3, 0), (9, 1, 2)]


def brute_runs(rows, width):
    """Words that lie in a run of ``width`` words that starts earlier, less the first occurrence that the run overlaps."""
    seen, out = {}, {}
    for doc, text in sorted(rows):
        words = text.lower().split()
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            first = seen.setdefault(tuple(words[i : i + width]), (doc, i))
            own = min(k for k in range(i + 1) if words[k : k + width] == words[i : i + width])
            if first != (doc, i):
                for j in range(own + width if own < i < own + width else i, i + width):
                    gone[j] = True
        out[doc] = gone
    return out


def test_passages_go_whatever_the_units(spark):
    rng = random.Random(12)

    def fresh(n):
        return [rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n)]

    def short(words):  # sentences of three words, none of which is hashed as a unit
        return " ".join(w + ("." if i % 3 == 2 else "") for i, w in enumerate(words))

    passages = [short(fresh(n)) for n in (50, 60, 75, 140)] + [" ".join(fresh(n)) for n in (50, 55, 90)]  # and inside a sentence
    rows = []
    for i in range(80):
        text = " ".join(fresh(rng.randint(5, 30)))
        if i % 4:
            text += rng.choice([" ", "  ", "\n"]) + rng.choice([str.upper, str])(rng.choice(passages)) + rng.choice([" ", "\n"]) + " ".join(fresh(rng.randint(5, 30)))
        rows.append((i, text))
    rows += [(100, "la " * 200), (101, "la " * 70), (102, "x y z " * 40 + "end"), (103, rows[3][1]), (104, " ".join(passages[4].split()[:49]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, texts = brute_runs(rows, 50), dict(rows)
    got = {r.doc_id: r for r in ld.dedup(df, min_words=10**6).collect()}
    for d, gone in want.items():
        assert got[d].text.split() == [w for w, g in zip(texts[d].split(), gone) if not g], d
    whole = {r.doc_id: r.text for r in ld.dedup(df).collect()}
    for p in passages:  # the earliest copy stays, no other one
        held = [d for d, t in sorted(texts.items()) if p.lower().split()[0] in t.lower().split() and d < 100]
        assert len(held) > 1 and [d for d in held if p.lower().split()[20] in whole[d].lower().split()] == held[:1]

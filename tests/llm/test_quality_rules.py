import collections
import functools
import math
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import quality_rules as qr

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    words = re.findall(WORD, text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_counts_equal_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "\t", "\v", "\x1c", "\x85", "#", "|", "　"]) for _ in range(rng.randrange(120)))
        assert qr.count_text(text) == brute(text), repr(text)
    text = "one two three four five six seven eight nine " * 4_000
    assert qr.count_text(text) == brute(text)


def long_words(rng, least, most, n=60):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(least, most))) for _ in range(n))


def good(rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(60))


def bucketed(v):
    """What a sketch knows of a value."""
    if v <= qr.SMALLEST:
        return 0.0
    return qr.SMALLEST * 2 * qr.GAMMA ** math.ceil(math.log(v / qr.SMALLEST) / math.log(qr.GAMMA)) / (qr.GAMMA + 1)


def brute_kept(rows, m=qr.SHRINK, reach=qr.REACH):
    """Verdicts of (text, lang, source) rows from sorted lists."""
    counts = [brute(text or "") for text, _, _ in rows]
    failed = [n < 20 or 100 * r > 30 * n for n, _, _, _, r, _ in counts]
    values = [(s / max(c, 1), c / max(n, 1), d / max(k, 1), r / max(n, 1)) for n, c, s, d, r, k in counts]
    groups = collections.defaultdict(list)
    for (_, lang, source), bad, v in zip(rows, failed, values):
        for key in () if bad else ((lang, source), (lang,), ()):
            groups[key].append(v)

    def quantile(key, k, level):
        column = sorted(v[k] for v in groups[key])
        return bucketed(next(x for i, x in enumerate(column, 1) if i >= len(column) * level))

    def shrunk(lang, source, k, level):
        target = quantile((), k, level)
        for key in (lang,), (lang, source):
            n = len(groups[key])
            target = (n * quantile(key, k, level) + m * target) / (n + m)
        return target

    @functools.cache
    def fences(lang, source, k, measure):
        inner, outer = (shrunk(lang, source, k, level) for level in qr.LEVELS[measure])
        low = shrunk(lang, source, k, 1 - qr.LEVELS[measure][1])
        return low - reach * (inner - low) if measure == "mean_word" else 0, outer + reach * (outer - inner)

    out = []
    for (_, lang, source), bad, v in zip(rows, failed, values):
        limits = [] if bad else [fences(lang, source, k, measure) for k, measure in enumerate(qr.LEVELS)]
        out.append(not bad and all(low * (1 - qr.ACCURACY) <= x <= high * (1 + qr.ACCURACY) for x, (low, high) in zip(v, limits)))
    return out


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(900):
        words = long_words(rng, 2 + i % 3, rng.choice([6, 7, 14]), rng.randrange(10, 80)).split()
        words += rng.choice([[], [], ["##"] * (i % 7), words[:9] * (i % 3)])
        rows.append((rng.choice([" ", "\n", " "]).join(words), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", None])))
    rows += [(None, "en", "a"), ("", None, None), ("x " * 90, "only", "failed")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in qr.judge(qr.text_counts(df), reach=0.5).collect()}
    expected = brute_kept(rows, reach=0.5)
    assert kept == dict(enumerate(expected)) and 0.2 < sum(expected) / len(rows) < 0.98


def test_columns_nulls_and_repeats(spark):
    rng = random.Random(5)
    rows = [(i, good(rng), "en", "a") for i in range(300)]
    rows += [(3000, good(rng), None, None), (3001, None, "en", "a"), (3002, "", "en", None), (3003, "x " * 100, "en", "a"), (3003, "x " * 100, "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n_words": F.lit("old"), "digest": F.lit(1)})
    kept = {r.doc_id: r.kept for r in qr.judge(qr.text_counts(df)).collect()}
    assert sum(kept[i] for i in range(300)) >= 294 and kept[3000]
    assert not any(kept[i] for i in (3001, 3002, 3003))
    left = qr.filter_documents(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, k in kept.items() if k}
    assert qr.filter_documents(df.limit(0)).count() == 0


def test_sketches_merge_and_keep_their_accuracy(spark):
    values = [0.0, 0.00005, 0.001, 0.5, 1.0, 3.0, 77.7]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", qr.value_of(qr.bucket_of(F.col("v"))).alias("back")).collect():
        assert abs(r.back - r.v) <= max(qr.ACCURACY * r.v * 1.0001, qr.SMALLEST)
    counts = qr.text_counts(spark.createDataFrame([(i, "a b " * (i % 5), "en", "s") for i in range(40)], "doc_id long, text string, lang string, source string"))
    halves = qr.sketch(counts.where("doc_id < 20")).unionAll(qr.sketch(counts.where("doc_id >= 20")))
    keys = ["lang", "source", "measure", "bucket"]
    assert sorted(halves.groupBy(*keys).agg(F.sum("n")).collect()) == sorted(qr.sketch(counts).select(*keys, "n").collect())


def test_what_is_usual_in_one_group_goes_in_another(spark):
    """Symbols, repeated lines and repeated words at one level in texts of one length, and word lengths."""
    rng = random.Random(8)

    def shaped(kind, amount):
        words = long_words(rng, 3, 7, 96).split()
        if kind == "symbols":
            words[:amount] = [w + "#" for w in words[:amount]]
        if kind == "words":  # runs of eight words twice
            words[48 : 48 + amount] = words[:amount]
        lines = [" ".join(words[i : i + 6]) for i in range(0, 96, 6)]
        if kind == "lines":
            lines[8 : 8 + amount] = lines[:1] * amount
        return "\n".join(lines)

    usual = {"symbols": 60, "words": 12, "lines": 3}
    for kind, amount in usual.items():
        rows = [(i, shaped("none", 0), "en", "plain") for i in range(2_000)]
        rows += [(10_000 + i, shaped(kind, amount - i % 2), "xx", "marked") for i in range(600)]
        rows += [(20_000 + i, shaped(kind, amount), "en", "plain") for i in range(5)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        kept = {r.doc_id: r.kept for r in qr.judge(qr.text_counts(df)).collect()}
        assert sum(kept[10_000 + i] for i in range(600)) >= 590, kind
        assert not any(kept[20_000 + i] for i in range(5)), kind
        assert sum(kept[i] for i in range(2_000)) >= 1_960, kind

    rows = [(i, good(rng), "en", "a") for i in range(1_500)] + [(10_000 + i, long_words(rng, 9, 13), "de", "b") for i in range(1_500)]
    rows += [(20_000, long_words(rng, 9, 13), "en", "a"), (20_001, long_words(rng, 3, 7), "de", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in qr.judge(qr.text_counts(df)).collect()}
    assert not kept[20_000] and not kept[20_001] and sum(kept.values()) >= 2_970

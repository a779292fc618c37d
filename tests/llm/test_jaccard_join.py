import collections
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join as jj
from tidemark.llm.components import components
from tidemark.llm.exchange import cell_of
from tidemark.llm.shingles import shingle_sets

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


class Forest(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def brute(rows):
    sets, forest = {d: shingles(t) for d, t in rows}, Forest()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                forest.join(a, b)
    return {d: (len(s), forest.find(d)) for d, s in sets.items()}


def test_sets_equal_plain_shingles():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbÉé \t\n\v\x1c\x85 ") for _ in range(rng.randrange(40))) for _ in range(800)] + [None, "", "x", "A b c d", "w " * 30_000]
    names = {}
    for text, hashes in zip(texts, shingle_sets(texts)):
        want = shingles(text)
        assert len(hashes) == len(want)
        assert names.setdefault(want, hashes.tobytes()) == hashes.tobytes()
    assert len(set(names.values())) == len(names)


def variants(rng, words, n, edits):
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice("klmnop") + str(rng.randrange(50))
        yield " ".join(w[: rng.randint(int(len(w) * 0.8), len(w))])


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    shared = [f"s{i}" for i in range(40)]  # a passage in many texts
    for length in (2, 3, 4, 6, 7, 8, 9, 12, 20, 60, 150):
        for _ in range(4):
            base = [f"w{rng.randrange(2000)}" for _ in range(length)]
            rows += list(variants(rng, base, 6, max(1, length // 25)))
    rows += [" ".join(shared + [f"x{rng.randrange(10**6)}" for _ in range(rng.randint(3, 30))]) for _ in range(70)]
    rows += ["a b c d e", "A B C d e", "a b c d", "a b c", None, "", " ", None]
    rng.shuffle(rows)
    rows = list(enumerate(rows, start=-20))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumns({"n": F.lit("x"), "cls": F.lit(1), "root": F.lit(None)})
    out = jj.join(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows) and len(out) == len(rows)
    kept = jj.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {c for _, c in brute(rows).values()}


def test_empty_table_and_shared_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (1, "q r s t u v w"), (2, "q r s t u v w"), (None, "q r s t u v w"), (3, None)], "doc_id long, text string")
    assert jj.join(df.limit(0)).count() == 0
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jj.join(df).collect())
    assert got == [(0, 3, 1), (1, 3, 1), (1, 4, 1), (2, 3, 1), (3, 0, 3)]


def test_light_and_heavy_keys_find_all_pairs():
    """Any boundary gives the same possible pairs or more than are linked."""
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 63, 30).astype(np.uint64)
    sets = [np.unique(np.r_[base[: rng.integers(2, 30)], rng.integers(1, 1 << 63, rng.integers(0, 4)).astype(np.uint64)]) for _ in range(60)]
    levels = (rng.random(jj.COUNTERS) < 0.3).astype(np.uint8)
    for light in (3, 8, 14, 40):
        records = np.concatenate([jj.entries(s, i, levels, light) for i, s in enumerate(sets)])
        members = np.empty(len(records), jj.MEMBER)
        for name in jj.ENTRY.names:
            members[name] = records[name]
        members["comp"] = members["cls"]
        members["parity"] = [np.frombuffer(jj.parity_of(sets[i]), "<u8") for i in members["cls"]]
        found = {tuple(p) for p in jj.cross_pairs(members).tolist()}
        for i in range(60):
            for j in range(i):
                equal = len(sets[i]) == len(sets[j]) and (sets[i] == sets[j]).all()
                if not equal and jj.linked(sets[j], sets[i]):
                    assert (j, i) in found


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 120)] + [(500, 500 + i) for i in range(1, 90)] + [(900, 900), (1000, 999)]
    forest = Forest()
    for a, b in links:
        forest.join(a, b)
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: forest.find(n) for n in {x for e in links for x in e if e[0] != e[1]}}
    sizes = collections.Counter(got.values())
    assert sizes[0] == 121 and sizes[500] == 90


def test_cut_off_elements_never_lose_a_link(monkeypatch):
    monkeypatch.setattr(jj, "WIDE", 90)
    rng = np.random.default_rng(5)
    for _ in range(400):
        base = rng.integers(0, 1 << 63, 100).astype(np.uint64) & np.uint64(0xFFFF0000000007FF)  # low bits repeat
        a, b = np.unique(base[: rng.integers(60, 100)]), np.unique(base[rng.integers(0, 20) :])
        likely = jj.may_link(jj.pack_short(a), len(a), jj.pack_short(b), len(b))
        assert likely or not jj.linked(a, b)


def test_keep_one_judges_rows(spark):
    a, b, c = "a b c d e f g h", "q r s t u v w x", "k l m n o p q r"
    rows = [(1, a), (5, a), (5, b), (6, b), (7, c), (7, c), (7, c), (None, c), (None, a), (None, "z y x w v u"), (None, "z y x w v u"), (None, "Z y x w v u"), (9, None), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"n": F.lit("x"), "root": F.lit(1), "gone": F.lit(True), "__tag": F.lit(1), "tag": F.lit(2), "doc": F.lit(3)})
    kept = jj.keep_one(df)
    assert kept.columns == df.columns
    got = collections.Counter((r.doc_id, (r.text or "").lower()) for r in kept.collect())
    assert got == {(1, a): 1, (5, b): 1, (7, c): 1, (None, "z y x w v u"): 1, (9, ""): 3}


def test_parities_never_lose_a_link():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(2, 1500))
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        a, b = np.unique(base[: rng.integers(n // 2, n) + 1]), np.unique(np.r_[base[rng.integers(0, n // 5 + 1) :], rng.integers(0, 1 << 63, n // 8).astype(np.uint64)])
        x, y = (jj.parity_of(s, jj.parity_bits(len(s))) for s in (a, b))
        assert jj.folded(x).tobytes() == jj.parity_of(a)
        assert jj.parity_allows(x, len(a), y, len(b)) or not jj.linked(a, b)
    far = [np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64)) for _ in range(2)]
    assert not jj.parity_allows(*[v for s in far for v in (jj.parity_of(s, jj.parity_bits(len(s))), len(s))])


def test_lists_keep_every_possible_pair():
    """Members leave only without a partner, a list of two is a pair, and a pair of many lists is found in few cells."""
    rng = np.random.default_rng(7)
    records = np.empty(3000, jj.ENTRY)
    records["key"] = rng.integers(0, 1 << 63, 400).astype(np.uint64)[rng.integers(0, 400, 3000) * rng.integers(0, 2, 3000)]
    records["cls"] = rng.integers(0, 90, 3000)
    records["n"] = 40 + records["cls"] // 2
    records["pos"] = rng.integers(0, 14, 3000)

    def possible(r):
        order = r[np.lexsort((r["pos"], r["cls"], r["n"], r["key"]))]
        order = order[np.r_[True, (order["key"][1:] != order["key"][:-1]) | (order["cls"][1:] != order["cls"][:-1])]]
        found = set()
        for key in np.unique(order["key"]):
            own = order[order["key"] == key]
            i, j = np.nonzero(jj._possible(own[:, None], own[None, :]))
            found |= {tuple(p) for p in jj._pair_codes(own[i], own[j]).tolist()}
        return found

    rest, size, pairs = jj.useful_lists(records)
    assert possible(rest) | {tuple(p) for p in pairs.tolist()} == possible(records) and len(pairs) and (size > 2).all()
    family = np.empty(60 * 5, jj.ENTRY)  # five sets that share sixty elements
    family["key"], family["cls"] = np.repeat(rng.integers(0, 1 << 63, 60).astype(np.uint64), 5), np.tile(np.arange(5), 60)
    family["n"], family["pos"] = 400, 7
    rest, _, _ = jj.useful_lists(family)
    assert len(np.unique(rest["key"])) == 60 and len(np.unique(cell_of(rest["key"], 256))) == 1


def test_sets_that_share_little_are_not_written(spark, monkeypatch):
    """Texts with some shingles in common, but no links: parities settle them, no set is shuffled or written."""
    rng = random.Random(8)
    passages = [" ".join(f"p{k}_{i}" for i in range(9)) for k in range(12)]
    rows = [(i, " ".join([*(f"x{rng.randrange(10**9)}" for _ in range(60)), passages[i % 12], *(f"y{rng.randrange(10**9)}" for _ in range(20))])) for i in range(90)]
    rows += [(1000, " ".join(f"z{i}" for i in range(80))), (1001, " ".join(f"z{i}" for i in range(81)))]
    written, write = [], jj.materialize

    def counted(df, name):
        out = write(df, name)
        if name == "sets":
            written.append(out.select("cls").distinct().count())
        return out

    monkeypatch.setattr(jj, "materialize", counted)
    out = {r.doc_id: r.component_id for r in jj.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert out == {i: i for i, _ in rows} | {1001: 1000}
    assert sum(written) <= 10  # those of the one link, and few that parities can't tell

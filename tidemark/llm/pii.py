"""Personal data in texts: fixed patterns, and identifiers that bootstrapped contexts point to.

DataFrame functions only. One pass over the texts finds the base spans (email, ip, card, phone) and every token
that looks like an identifier, each with the two words before it; all later work is on that small table.

Bootstrapping: base spans are seed entities. The words before an entity are a lexical pattern. Patterns and the
instances that follow them form a bipartite graph. In each round a pattern is scored for a kind by how many of
its instances are known to be of that kind, and by which share of all its instances they are; instances that
trusted patterns introduce are scored by those patterns together, and those that score high enough become known.
After the last round, each unseen instance that is known and stands behind a trusted pattern of its kind is a span,
unless it touches a base span. Rounds go on until one finds no new instance. The two words may lie beyond another match: a
word that holds an @ or three digits in a row is the same placeholder in every pattern. Patterns and instances are counted with map-side partial aggregates, so a context
in a third of the rows is one row per task.

Offsets count code points, ends are exclusive. Null and empty texts hold nothing. Null ids are kept; rows that
share id and text have the same spans.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize
from .common import free_name, text_or_empty

KINDS = ("email", "ip", "card", "phone")

# Each matches where the base pattern does, without going over a run of characters twice.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Texts without this character have no match.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
# A token with an @ or three digits in a row; quotes, equals signs, bars and the like end it.
TOKEN = r"""(?<![^\s"'<>=,;:|])[^\s"'<>=,;|]*?(?:@|[0-9]{3})[^\s"'<>=,;|]*+"""
CONTEXT = r"""(\S+\s+\S+)[\s"'(<]*$"""
# How far back the two words before an instance may reach.
REACH = 80

PLACEHOLDER = "<id>"
MIN_KNOWN = 3
MIN_SHARE = 0.6
MIN_SCORE = 0.75


def _matches(text: Column, pattern: str, hint: str | None) -> Column:
    """start, end, instance and pattern (the context) of every match, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)  # one more than matches

    def place(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["gap"])
        end = start + F.length(pair["own"])
        before = F.right(F.concat(done["tail"], F.right(pair["gap"], F.lit(REACH))), F.lit(REACH))
        context = F.regexp_replace(F.regexp_extract(before, CONTEXT, 1), r"\S*(?:@|[0-9]{3})\S*", PLACEHOLDER)
        words = F.lower(F.regexp_replace(context, r"\s+", " "))
        span = F.struct(start.alias("start"), end.alias("end"), pair["own"].alias("instance"), words.alias("pattern"))
        tail = F.concat(before, F.lit(PLACEHOLDER))
        return F.struct(end.alias("at"), tail.alias("tail"), F.array_append(done["out"], span).alias("out"))

    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("own"))
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,instance:string,pattern:string>>)")
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), empty.alias("out")), place, lambda done: done["out"])
    some = F.contains(text, F.lit(hint)) if hint else F.lit(True)
    return F.when(some & F.regexp_like(text, F.lit(pattern)), spans).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(value))
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)

    def add(total: Column, place: Column) -> Column:
        digit = F.substr(value, place, F.lit(1)).cast("int")
        return total + F.when((F.length(value) - place) % 2 == 1, double(digit)).otherwise(digit)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern is a base span."""
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _of_kind(kind: str, text: Column) -> Column:
    spans = F.filter(_matches(text, PATTERNS[kind], HINTS.get(kind)), lambda s: _holds(kind, s["instance"]))
    order = F.lit(KINDS.index(kind))
    return F.transform(spans, lambda s: F.struct(s["start"], order.alias("kind"), s["end"], s["instance"], s["pattern"]))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, base (spans by start and kind) and tokens (identifier-like, apart from base spans), written."""
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(text).alias("text"))
    columns = {k: _of_kind(k, F.col("text")) for k in KINDS} | {"tokens": _matches(F.col("text"), TOKEN, None)}
    found = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), *[c.alias(k) for k, c in columns.items()])
    base = F.array_sort(F.concat(*[F.col(k) for k in KINDS]))
    apart = F.filter("tokens", lambda t: ~F.exists(F.col("base"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return materialize(found.select("doc_id", "key", base.alias("base"), "tokens").select("doc_id", "key", "base", apart.alias("tokens")), "spans")


def graph(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (pattern, instance), and the seeds (kind, instance)."""
    seeds = scanned.select(F.explode("base").alias("s")).select("s.kind", "s.instance", "s.pattern")
    tokens = scanned.select(F.explode("tokens").alias("t")).select("t.pattern", "t.instance")
    edges = seeds.select("pattern", "instance").unionAll(tokens).where("pattern <> ''").distinct()
    return materialize(edges, "edges"), materialize(seeds.select("kind", "instance").distinct(), "known")


def trusted(edges: DataFrame, known: DataFrame, min_known: int = MIN_KNOWN, min_share: float = MIN_SHARE) -> DataFrame:
    """pattern, kind, n (known instances), share of the patterns that introduce mostly known instances of a kind."""
    marked = edges.join(known, "instance", "left")
    per_kind = marked.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"))
    per_pattern = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= min_known)
    both = per_kind.where(F.col("kind").isNotNull() & (F.col("n") >= min_known)).join(per_pattern, "pattern")
    return both.select("pattern", "kind", "n", (F.col("n") / F.col("all")).alias("share")).where(F.col("share") >= min_share)


def bootstrap(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, min_known: int = MIN_KNOWN, min_share: float = MIN_SHARE, min_score: float = MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns, and all known instances (kind, instance), after ``rounds`` or once a round finds no new instance."""
    known = seeds
    patterns = trusted(edges, known, min_known, min_share)
    for _ in count() if rounds is None else range(rounds):
        patterns = materialize(trusted(edges, known, min_known, min_share), "patterns")
        unseen = edges.join(known.select("instance").distinct(), "instance", "left_anti")
        # a pattern is right as often as its share says, less so if it rests on few instances; doubts multiply
        doubt = F.sum(F.log(1 - F.col("share") * F.col("n") / (F.col("n") + 1)))
        score = unseen.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score"))
        best = score.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("minus"))).alias("best"))
        new = materialize(best.where(F.col("best.score") >= min_score).select((-F.col("best.minus")).alias("kind"), "instance"), "new")
        if new.isEmpty():
            break
        known = known.unionAll(new)
    return patterns, known


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int | None = None) -> DataFrame:
    """doc_id, key (of id and text), base and found (spans of start, kind, end; by start and kind) for every row of ``df``."""
    scanned = scan(df, doc_id, text)
    edges, seeds = graph(scanned)
    patterns, known = bootstrap(edges, seeds, rounds)
    tokens = scanned.where(F.size("tokens") > 0).select("key", F.explode("tokens").alias("t")).select("key", "t.*")
    hits = tokens.join(patterns.select("pattern", "kind"), "pattern").join(known, ["kind", "instance"])
    per_row = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("found"))
    plain = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")
    return scanned.join(per_row, "key", "left").select("doc_id", "key", plain.alias("base"), F.coalesce("found", none).alias("found"))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def mask(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int | None = None) -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in angle brackets; spans that overlap are one, of the first's kind."""
    key, spans_of = free_name(df.columns, "key"), free_name(df.columns, "spans")
    spans = find(df, doc_id, text, rounds).select(F.col("key").alias(key), F.array_sort(F.concat("base", "found")).alias(spans_of))
    spans = spans.where(F.size(spans_of) > 0).dropDuplicates([key])
    rows = df.withColumn(key, F.xxhash64(F.col(f"`{doc_id}`"), text_or_empty(text)))
    both = rows.join(spans, key, "left")
    own = F.col(f"`{text}`")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def step(done: Column, s: Column) -> Column:
        gap = F.substr(own, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        out = F.concat(done["out"], gap, names[s["kind"]])
        taken = F.struct(s["end"].alias("at"), out.alias("out"))
        longer = F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out"))
        return F.when(s["start"] >= done["at"], taken).otherwise(longer)

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(spans_of, begin, step, lambda done: F.concat(done["out"], F.substr(own, done["at"] + 1, F.length(own))))
    return both.select(*[(F.when(F.col(spans_of).isNull(), own).otherwise(masked).alias(c) if c == text else F.col(f"`{c}`")) for c in df.columns])

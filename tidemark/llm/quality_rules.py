"""Quality rules: fixed base rules, and thresholds from quantile sketches of each language and source.

One pass over the texts counts what the rules need (``text_counts``). Each rule's measure then goes into
a mergeable quantile sketch per (lang, source), filled by the texts that pass the base rules: counts of
logarithmic buckets with a relative error of ``ACCURACY``, so sketches add up in map-side partial aggregates
and a source that holds most rows is no burden. A fence lies beyond an outer quantile of the group by
``reach`` times the distance from an inner one (``LEVELS``), so it is set by the group's own tail alone: a
share's tail from its 0.9 to its 0.99 quantile, and for the mean word length the outer tenths, seen from the
median. Each quantile is shrunk, with the weight of ``min_rows`` rows, to that of the language, and this to
that of all rows. A join on (lang, source) applies the fences. No text passes or fails by a fixed value.

Null and empty texts have no words and fail the base rules. Null languages and sources form groups.
Repeated rows are judged each. Other columns pass through ``filter_documents`` unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import null_safe_join
from ..plans.session import materialize
from .common import free_name, map_slices

ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
SMALLEST = 1e-4
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
WINDOW = 8

# measure -> inner and outer levels of its upper tail; shares have no lowest value
LEVELS: Mapping[str, tuple[float, float]] = {
    "symbol_share": (0.9, 0.99),
    "mean_word": (0.5, 0.9),
    "dup_line_share": (0.9, 0.99),
    "repeat_share": (0.9, 0.99),
}
TWO_SIDED = ("mean_word",)
# A fence lies this many times the distance between the two quantiles beyond the outer one.
REACH = 2.0
# Rows that the shrinking target of a group's quantiles counts for.
SHRINK = 200
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_MULTIPLIERS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)]


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of ``WINDOW`` words that the text holds twice or more."""
    n = len(words)
    if n <= WINDOW or len(set(words)) == n:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    windows = np.zeros(n - WINDOW + 1, np.uint64)
    for k, m in enumerate(_MULTIPLIERS):
        windows += hashes[k : n - WINDOW + 1 + k] * np.uint64(m)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not twice.size:
        return 0
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(np.isin(windows, twice))
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def count_text(text: str) -> tuple[int, int, int, int, int, int]:
    """The counts of ``COUNTS``, and the lines with a word."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``df``, the counts and ``n_lines``. Counts win over columns of the same name."""
    names = [*COUNTS, "n_lines"]
    keep = [c for c in df.columns if c != text and c not in names]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(text))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.array([count_text(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()], np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(counts[:, k]) for k in range(len(names)))], names=[*keep, *names])

    schema = rows.drop(text).withColumns({n: F.lit(0).cast("long") for n in names}).schema
    return map_slices(rows, run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """Measure -> its value, 0 for texts without words."""
    words, lines, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "word_chars"))
    return {
        "symbol_share": F.col("n_symbols") / chars,
        "mean_word": F.col("word_chars") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
    }


# -- sketches --


def bucket_of(value: Column) -> Column:
    """Sketch bucket of a value that is not negative; bucket k holds (GAMMA ** (k-1), GAMMA ** k] * SMALLEST."""
    return F.when(value <= SMALLEST, F.lit(0)).otherwise(F.ceil(F.log(value / SMALLEST) / math.log(GAMMA)).cast("int"))


def value_of(bucket: Column) -> Column:
    return F.when(bucket <= 0, F.lit(0.0)).otherwise(SMALLEST * 2 * F.pow(F.lit(GAMMA), bucket) / (GAMMA + 1))


def sketch(counts: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: one row per bucket in use. Sketches of two tables merge by adding n."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket_of(v).alias("bucket")) for m, v in measures().items()])
    passing = counts.where(~base_failed())
    flat = passing.select("lang", "source", F.explode(pairs).alias("m")).select("lang", "source", "m.measure", "m.bucket")
    return flat.groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sketches: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """keys, measure, ``prefix`` rows, and quantiles: upper inner and outer, lower outer; a group has as many rows as buckets in use."""
    merged = sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*keys, "measure").orderBy("bucket")
    group = Window.partitionBy(*keys, "measure")
    run = merged.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(group)})
    inner, outer = (F.element_at(F.create_map(*[F.lit(x) for m, q in LEVELS.items() for x in (m, q[k])]), F.col("measure")) for k in (0, 1))
    at = {q: F.min(F.when(F.col("upto") >= F.col("all") * level, F.col("bucket"))) for q, level in (("in", inner), ("out", outer), ("low", 1 - outer))}
    return run.groupBy(*keys, "measure").agg(F.max("all").alias(f"{prefix}n"), *[value_of(c).alias(prefix + q) for q, c in at.items()])


def thresholds(sketches: DataFrame, min_rows: int = SHRINK, reach: float = REACH) -> DataFrame:
    """lang, source, and a lowest and highest value for each measure (``low_``, ``high_``)."""
    own = _quantiles(sketches, ["lang", "source"], "s_")
    of_lang = _quantiles(sketches, ["lang"], "l_")
    of_all = _quantiles(sketches, [], "a_")
    both = null_safe_join(null_safe_join(own, of_lang, ["lang", "measure"]), of_all, ["measure"])

    def shrunk(q: str) -> Column:
        lang = (F.col("l_n") * F.col(f"l_{q}") + min_rows * F.col(f"a_{q}")) / (F.col("l_n") + min_rows)
        return (F.col("s_n") * F.col(f"s_{q}") + min_rows * lang) / (F.col("s_n") + min_rows)

    inner, outer, low = shrunk("in"), shrunk("out"), shrunk("low")
    fences = both.select("lang", "source", "measure", (low - reach * (inner - low)).alias("low"), (outer + reach * (outer - inner)).alias("high"))
    columns = [F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}") for m in measures() for c in ("low", "high")]
    return fences.groupBy("lang", "source").agg(*columns)


def within(measure: str, value: Column) -> Column:
    """Whether a row's value lies inside its fences, as far as the sketch resolves values."""
    below = value <= F.col(f"high_{measure}") * (1 + ACCURACY)
    return below & (value >= F.col(f"low_{measure}") * (1 - ACCURACY)) if measure in TWO_SIDED else below


def judge(counts: DataFrame, min_rows: int = SHRINK, reach: float = REACH) -> DataFrame:
    """``counts`` (a written table of ``text_counts`` with lang and source) with ``base_failed`` and ``kept``."""
    limits = thresholds(sketch(counts), min_rows, reach)
    joined = null_safe_join(counts, limits, ["lang", "source"])  # no text of a group passes the base rules: no fences
    inside = F.lit(True)
    for m, value in measures().items():
        inside = inside & within(m, value)
    kept = ~base_failed() & F.coalesce(inside, F.lit(False))
    return joined.select(*[F.col(f"`{c}`") for c in counts.columns], base_failed().alias("base_failed"), kept.alias("kept"))


def filter_documents(df: DataFrame, ids: tuple[str, ...] = ("doc_id",), min_rows: int = SHRINK, reach: float = REACH) -> DataFrame:
    """The rows of ``df`` whose text passes; rows of equal ``ids``, lang, source and text have equal verdicts.

    The verdicts of rejected documents are joined to the texts by ``ids`` and the text's digest.
    """
    digest = free_name(df.columns, "digest")
    keys = [*ids, digest]
    rows = df.withColumn(digest, F.xxhash64("lang", "source", "text"))
    counts = materialize(text_counts(rows.select(*keys, "lang", "source", "text")), "counts")
    rejected = judge(counts, min_rows, reach).where(~F.col("kept")).select(*keys).distinct()
    renamed = rejected.withColumnsRenamed({k: f"{digest}_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & rows[k].eqNullSafe(renamed[f"{digest}_{k}"])
    return rows.join(renamed, match, "left_anti").drop(digest)

"""Registered queries of the corpus operators: name -> (query, sql or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import hard_negatives, importance, jaccard_join, line_dedup, lm_scoring, packing, pii, quality_rules, resampling, sentencepiece_bpe, sharding, suffix_dedup, topk_search
from ..plans.session import materialize
from .common import documents


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{n}") for k, n in enumerate(pii.KINDS)]
    every = F.array_sort(F.concat("base", "found"))
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(every).alias("spans"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of every 50th vector with all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = rows.select(F.col("vec_id").cast("long").alias("id"), topk_search.scaled(F.col("embedding")).alias("vector"))
    return topk_search.top_k(vectors, vectors.where("id % 50 = 0"), 5)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Ids of every document with begin and end ids, and what they decode to, as digests."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    ids = sentencepiece_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), model)
    both = sentencepiece_bpe.decode(ids, model)
    return both.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses as a repeat of an earlier sentence, and the digest of what stays."""
    cleaned = line_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select(
        "doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        F.coalesce(F.aggregate("removed", F.lit(0), lambda n, s: n + s["end"] - s["start"]), F.lit(0)).cast("long").alias("chars_removed"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op5_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token pieces of every document and their places in sequences of at most 2048 tokens."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack_documents(documents(spark, sf_dir), tokenizer, digest=F.crc32("ids").alias("ids_crc32"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    counts = quality_rules.text_counts(documents(spark, sf_dir).select("doc_id", "lang", "source", "text"))
    judged = quality_rules.judge(materialize(counts, "counts"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document against the labelled good ones, and whether the sample takes it."""
    return importance.select(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes; equal texts stay together."""
    placed = sharding.shard(documents(spark, sf_dir), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard_join.join(documents(spark, sf_dir))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE [array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)] END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n m ON m.doc_id = x JOIN n o ON o.doc_id = y WHERE 100 * common >= 75 * (m.n + o.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT a, y FROM reach JOIN e ON b = x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that every document keeps when repeated 100-byte strings go."""
    cut = suffix_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of those whose id's CRC-32 leaves another rest than 2 by 7."""
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    return lm_scoring.score(documents(spark, sf_dir), train).select(*lm_scoring.RESULT)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn by how much their words are like those of the benchmark."""
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
steps AS (SELECT i, c FROM bits WHERE k = 8),
f AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
g AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
w AS (SELECT DISTINCT word FROM (SELECT unnest(words) AS word FROM f UNION ALL SELECT word FROM g)),
longest AS (SELECT max(octet_length(encode(word))) AS most FROM w),
positions(back, i, v) AS (
  SELECT 0, i, c FROM steps
  UNION ALL SELECT back + 1, p.i, xor(s.c, v >> 8) FROM positions p JOIN steps s ON s.i = v % 256, longest WHERE back + 1 < most),
zeros(n, v) AS (
  SELECT 0, 4294967295
  UNION ALL SELECT n + 1, xor(c, v >> 8) FROM zeros JOIN steps ON i = v % 256, longest WHERE n < most),
bytes AS (SELECT word, hex(encode(word)) AS h, octet_length(encode(word)) AS n, unnest(range(CAST(octet_length(encode(word)) AS BIGINT))) AS place FROM w),
codes AS (
  SELECT word, n, n - 1 - place AS back,
    16 * (instr('0123456789ABCDEF', substr(h, 2 * place + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * place + 2, 1)) - 1 AS i
  FROM bytes),
linear AS (SELECT word, any_value(n) AS n, bit_xor(v) AS v FROM codes JOIN positions USING (back, i) GROUP BY word),
b AS (SELECT word, xor(xor(linear.v, zeros.v), 4294967295) % 10000 AS bucket FROM linear JOIN zeros USING (n)),
d AS (SELECT doc_id, unnest(words) AS word FROM f),
s AS (SELECT bucket, count(*) AS s FROM d JOIN b USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM g JOIN b USING (word) GROUP BY bucket),
n AS (SELECT (SELECT sum(s) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket), n),
m AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM d JOIN b USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
h AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM documents LEFT JOIN m USING (doc_id)),
v AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM h),
r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM v WHERE n_features >= 20
  QUALIFY rank <= (SELECT 10 * count(*) // 100 FROM v WHERE n_features >= 20))
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, rank FROM v LEFT JOIN r USING (doc_id)"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of the five nearest rows of the same label, for every 100th vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), topk_search.scaled(F.col("embedding")).alias("vector"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5"""


QUERIES = {
    "op1_pii": (op1_pii, None),
    "op2_topk_search": (op2_topk_search, OP2_SQL),
    "op3_sentencepiece": (op3_sentencepiece, None),
    "op4_line_dedup": (op4_line_dedup, None),
    "op5_packing": (op5_packing, None),
    "op6_quality_rules": (op6_quality_rules, None),
    "op7_importance": (op7_importance, None),
    "op8_sharding": (op8_sharding, None),
    "op9_jaccard_join": (op9_jaccard_join, OP9_SQL),
    "op10_suffix_dedup": (op10_suffix_dedup, None),
    "op11_lm_scoring": (op11_lm_scoring, None),
    "op12_resampling": (op12_resampling, OP12_SQL),
    "op13_hard_negatives": (op13_hard_negatives, OP13_SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}

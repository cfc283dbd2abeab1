"""One query per operator of this subpackage, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlake.llm import bpe_tree, compression_bands, conversation_repair, katz, language_ftrl, ngram_jaccard, packing_gga, quality_cnn, reversed_search, suffix_dedup, token_spans, topk_segments, toxicity_fm
from contentlake.llm.common import documents, fold, labels, small_batches

MULTI, BYTES, WORDS = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = toxicity_fm.fit(docs, labels(spark, sf_dir).filter(fold("doc_id", 5) != 0))
    scored = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), machine.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_copies(documents(spark, sf_dir))


def op3_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans.section_tokens(documents(spark, sf_dir), public_tokenizers.path(BYTES), public_tokenizers.PATTERN)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = quality_cnn.fit(docs, labels(spark, sf_dir).filter(fold("doc_id", 4) != 2))
    scored = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), net.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_ftrl.fit(docs.filter(fold("doc_id", 3) != 1))
    return docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), model.column().alias("l")).select("doc_id", "held_out", "l.*")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    digest = bpe_tree.digest_column(public_tokenizers.path(MULTI), public_tokenizers.PATTERN)
    return documents(spark, sf_dir).select("doc_id", digest.alias("d")).select("doc_id", "d.*")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_gga.pack(documents(spark, sf_dir), public_tokenizers.path(WORDS))


def op8_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return documents(spark, sf_dir).select("doc_id", compression_bands.judge_column().alias("j")).select("doc_id", "j.*")


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(documents(spark, sf_dir), fold("doc_id", 7) != 2)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_segments.topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damaged_and_reported(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search.ranked(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s
  FROM words
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS root, doc_id FROM documents
  UNION
  SELECT r.root, l.b FROM reach r JOIN links l ON r.doc_id = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id
FROM sets s JOIN (SELECT doc_id, min(root) AS c FROM reach GROUP BY doc_id) r ON s.doc_id = r.doc_id
"""


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400
), h AS (
  SELECT r, i, md5(b[i:i + 399]) AS k FROM w
), twice AS (
  SELECT h.r, h.i FROM h JOIN (SELECT k FROM h GROUP BY k HAVING count(*) > 1) t ON h.k = t.k
), steps AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM twice
), spans AS (
  SELECT r, min(i) AS a, max(i) + 400 AS z FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM steps) x GROUP BY r, g
), cuts AS (
  SELECT r, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM spans GROUP BY r
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(z) - list_sum(a), 0) AS BIGINT) AS n_removed,
  CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN a IS NULL THEN b ELSE list_reduce(list_transform(range(1, len(a) + 2), lambda k:
    b[CASE WHEN k = 1 THEN 1 ELSE z[k - 1] END : CASE WHEN k > len(a) THEN octet_length(b) ELSE a[k] - 1 END]), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN cuts ON d.r = cuts.r
"""


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), asked AS (
  SELECT item_id, term, count(*) AS times FROM i GROUP BY item_id, term
), z AS (
  SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0
), tf AS (
  SELECT r, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) x GROUP BY r, doc_id, len(w), w, term
), df AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(z.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf CROSS JOIN z GROUP BY term
), scores AS (
  SELECT a.item_id, t.r, t.doc_id, CAST(sum(a.times * df.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (75 + (25 * t.n * z.n) // z.l)))) AS BIGINT) AS score
  FROM asked a JOIN tf t ON a.term = t.term JOIN df ON a.term = df.term CROSS JOIN z GROUP BY a.item_id, t.r, t.doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_ngram_jaccard, op3_token_spans, op4_quality, op5_language, op6_bpe, op7_packing, op8_compression, op9_katz, op10_topk, op11_suffix_dedup, op12_conversation_repair, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": OP2_SQL, "op10_topk": OP10_SQL, "op11_suffix_dedup": OP11_SQL, "op13_ranked_search": OP13_SQL}

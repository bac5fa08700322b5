"""The operators as named queries over the given tables, with production parameters and whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm import (
    decontaminate, exact_dedup, hard_negatives, line_dedup, mixing, order_minhash, prefix_trie, quality, secrets, simhash,
    suffix_array, token_counts, toxicity,
)
from loglathe.llm.base import documents, fresh_path
from loglathe.llm.linear import held_out
from loglathe.plans.catalog import query


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the given labels: 0 poor, 1 good but toxic, 2 good and clean."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    return labels.select("doc_id", grade.alias("grade"))


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.grade(docs, model).select(
        "doc_id", held_out().alias("held_out"), "expected_grade", "tail_probability",
        F.col("tail_probability").alias("score"), F.when(F.col("tail_probability") >= 0.5, 1).otherwise(0).alias("predicted"),
        (F.col("tail_probability") >= 0.5).alias("keep"))


@query("op4_document_fingerprints")
def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.against_next(documents(spark, sf_dir))


@query("op6_mixing", mixing.MIX_SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


CONTAINED_SQL = r"""
WITH texts AS (
  SELECT 0 AS side, row_number() OVER () AS row_no, doc_id AS id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), item_id, text
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
worded AS (
  SELECT side, row_no, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM texts),
widths AS (SELECT DISTINCT least(5, len(w)) AS k FROM worded WHERE side = 1 AND len(w) > 0),
cut AS (
  SELECT DISTINCT side, row_no, id, k,
         unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM worded JOIN widths ON k <= len(w) AND (side = 0 OR k = least(5, len(w)))),
sizes AS (SELECT row_no, count(*) AS n FROM cut WHERE side = 1 GROUP BY row_no),
shared AS (
  SELECT d.id AS doc_id, d.row_no, b.id AS item_id, b.row_no AS item_no, count(*) AS c
  FROM cut d JOIN cut b ON d.side = 0 AND b.side = 1 AND d.k = b.k AND d.s = b.s GROUP BY ALL)
SELECT doc_id, item_id, c AS n_shared, n AS n_shingles, c / n AS containment
FROM shared JOIN sizes ON sizes.row_no = item_no WHERE c >= 0.8 * n - 1e-9
"""


@query("op7_benchmark_decontamination", CONTAINED_SQL)
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is a new one for each run, so a run never leans on what another one encoded."""
    counts = token_counts.count_tokens(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(documents(spark, sf_dir))


@query("op10_secret_scans")
def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


@query("op1_suffix_array_dedup")
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.removals(documents(spark, sf_dir)).drop("runs")


@query("op11_conversation_prefix_trie")
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie over all conversations as ``prefix_trie.rebuilt`` rebuilds them."""
    return prefix_trie.trie(prefix_trie.rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


NEGATIVES_SQL = r"""
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
         CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM valid a JOIN valid r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
   AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10
"""


@query("op12_hard_negative_mining", NEGATIVES_SQL)
def op12_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are rows whose id is divisible by 100; where it is divisible by 7, the label is the next of ten."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


EXACT_SQL = r"""
WITH plain AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM plain WINDOW w AS (PARTITION BY t)
"""


@query("op13_exact_dedup", EXACT_SQL)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for its text."""
    return exact_dedup.classes(documents(spark, sf_dir))

"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunking import repeated_passages
from .common import scratch, setting, table
from .cross_entropy import cross_entropy_difference
from .decontaminate import contamination_report, find_contamination
from .language_id import language_report
from .mixture import mixture_report
from .nearest import nearest
from .ngram_join import ngram_groups
from .pii import span_report
from .quality import quality_report
from .token_counts import section_tokens
from .token_store import token_report, write_tokens
from .turn_repair import repair_report
from .whitening import whiten


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is every document labelled as good."""
    target = table(spark, sf_dir, "labels").where("quality = 1")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), target)


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_report(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contamination_report(find_contamination(docs.select("doc_id", "text"), items))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary's place is the setting `spark.tideline.wordVocabulary`, or that of the installed package of vocabularies."""
    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, setting(spark, "spark.tideline.wordVocabulary", "word_bpe_49k.json"))
    return token_report(spark, path)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "component", "n", F.col("deviation").try_cast("bigint").alias("deviation"), "whitened", "explained", "identity_error")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


_OP9_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS key
  FROM item, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS key
  FROM low, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, key)),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(0, n)) AS t(j) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_nearest": op1_nearest, "op2_cross_entropy": op2_cross_entropy, "op3_mixture": op3_mixture, "op4_quality": op4_quality, "op5_ngram_join": op5_ngram_join, "op6_token_counts": op6_token_counts, "op7_pii": op7_pii, "op8_substring_dedup": op8_substring_dedup, "op9_decontaminate": op9_decontaminate, "op10_language": op10_language, "op11_token_store": op11_token_store, "op12_whitening": op12_whitening, "op13_turn_repair": op13_turn_repair}


def oracle_sql() -> dict[str, str]:
    return {"op9_decontaminate": _OP9_SQL}

"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again as the next one's
docs. All but the last keep the columns of their input. Learnt values that SQL cannot express run through the first
stage, so there is no ORACLE_SQL; tests hold every stage against a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import ensure_checkpoint_dir, table
from tideline.llm.decontaminate import find_contamination
from tideline.llm.mixture import mixture_report
from tideline.llm.ngram_join import keep_one
from tideline.llm.pii import redact
from tideline.llm.quality import score_quality, train_quality

ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """The rows as one column beside the text, so that no column can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))


def _field(name: str) -> Column:
    return F.col("row").getField(name).alias(name)


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[_field(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of documents that are not held out."""
    labels = table(spark, sf_dir, "labels")
    forest = train_quality(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    return _unpacked(score_quality(_packed(docs), forest, carry=["row"]).where("predicted = 1"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at a similarity of 0.8 or more, the smallest id stays."""
    return keep_one(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    found = find_contamination(_packed(docs), table(spark, sf_dir, "benchmark"), carry=["row"])
    return _unpacked(found.where(F.size("hit_words") == 0), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in the text; n_chars follows the text."""
    clean = redact(_packed(docs))
    own = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in docs.columns else {})
    return clean.select(*[own.get(c, _field(c)) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix of sources takes the words of each document."""
    return mixture_report(docs.select("doc_id", "source", "text"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

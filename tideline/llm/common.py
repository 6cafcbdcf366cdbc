"""Small helpers that the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names. Only where driver and executors are one process (tests) may a local one take its place."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tideline-checkpoint-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


def setting(spark: SparkSession, key: str, vocabulary: str) -> str:
    """The path that a session's setting names, or the file of that name in the installed package of vocabularies."""
    if named := spark.conf.get(key, None):
        return named
    import public_tokenizers

    return f"file://{public_tokenizers.path(vocabulary)}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and return a frame that reads it. A written table, since a checkpoint of a
    checkpoint carries estimates of size along that grow with each join of a loop."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_mod3(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string")) % 3


def held_out(doc_id: str | Column) -> Column:
    """True where the row must not be learnt from. A null id is never held out (it has no label either)."""
    return F.coalesce(id_mod3(doc_id) == 1, F.lit(False))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

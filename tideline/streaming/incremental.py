"""Incremental placement with Structured Streaming: sequences are placed when their files arrive, each only once.

The store is a folder of Parquet with a part per micro-batch. A batch looks at the parts before its own and replaces
its own part, so a batch that is run again after a failure leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.placement import best_places
from ..operators.trees import shared_folder  # noqa: F401


def placements(spark: SparkSession, store: str) -> DataFrame:
    """(seq, label, lh, batch) of all sequences placed so far."""
    return spark.read.parquet(f"{store}/placed")


def place_stream(rows: DataFrame, to_sites: Callable[[DataFrame], DataFrame], profiles: DataFrame, matrix: DataFrame, store: str, step: float) -> StreamingQuery:
    """Place the sequences of a stream on `profiles` (see operators.placement) and keep the results in `store`.

    `to_sites` turns a micro-batch into (seq, pos, ch). Sequences that the store has already are left alone. Everything that
    is there is read, then the query ends; started again with the same store, it goes on with what is new.
    """
    spark = rows.sparkSession
    label = profiles.schema["label"].dataType.simpleString()

    def place(batch: DataFrame, batch_id: int) -> None:
        sites = to_sites(batch)
        before = placements(batch.sparkSession, store).where(F.col("batch") < batch_id).select("seq")
        fresh = sites.join(before.hint("merge"), "seq", "left_anti")
        placed = best_places(fresh, profiles, matrix, step)
        placed.write.mode("overwrite").parquet(f"{store}/placed/batch={batch_id}")

    # an empty part, so that the store can be read before anything is placed
    spark.createDataFrame([], f"seq bigint, label {label}, lh double").write.mode("ignore").parquet(f"{store}/placed/batch=-1")
    return rows.writeStream.foreachBatch(place).option("checkpointLocation", f"{store}/state").trigger(availableNow=True).start()

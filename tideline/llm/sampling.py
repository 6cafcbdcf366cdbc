"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids that a task ranks before the sample is put together.
_SPREAD = 64


def sample_ids(rows: DataFrame, label: str, bound: int, key: str = "doc_id", weight: str | None = None) -> DataFrame:
    """About `bound` distinct rows (key, label), the same number of each label, but at least one of every label, chosen by a hash of the
    key. A column `weight`, if wanted, says how many distinct rows of its label each one stands for.

    Every label is counted. Only a hash range that holds a few times the wanted number is ranked, in parts first, so no task gets
    more than _SPREAD times what it passes on.
    """
    rows = rows.select(key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull()).distinct()
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_total"))
    labels = counts.agg(F.count(F.lit(1))).first()[0]
    if not labels:
        return rows.limit(0).select("*", *([F.lit(1.0).alias(weight)] if weight else []))
    each = max(1, bound // labels)
    place = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    near = rows.join(counts, label).withColumn("_place", place).where(F.col("_place") < (3.0 * each + 100) / F.col("_total"))
    part = F.pmod(F.xxhash64(key, F.lit(18)), F.lit(_SPREAD))
    for keys in ((label, "_part"), (label,)):
        order = Window.partitionBy(*keys).orderBy("_place", key)
        near = near.withColumn("_part", part).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each).drop("_part", "_rank")
    if not weight:
        return near.select(key, label)
    return near.select(key, label, (F.col("_total") / F.count(F.lit(1)).over(Window.partitionBy(label))).alias(weight))

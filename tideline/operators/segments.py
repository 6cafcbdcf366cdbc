"""Operators on run-length lists: overlay, comparison, coalescing, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlay(left: DataFrame, right: DataFrame, key: list[str], value: str = "type") -> DataFrame:
    """(key, start, stop, a, b): maximal shared segments of two run lists (key, start, stop, value) that each cover one length.

    The borders of both lists are cut together and the values carried forward: one sort by key and position, linear in
    the number of runs, with no join of intervals.
    """
    none = F.lit(None).cast(left.schema[value].dataType)
    both = left.select(*key, "start", "stop", F.col(value).alias("a"), none.alias("b")).unionByName(right.select(*key, "start", "stop", none.alias("a"), F.col(value).alias("b")))
    borders = both.groupBy(*key, "start").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("stop").alias("stop"))
    order = Window.partitionBy(*key).orderBy("start")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = borders.select(
        *key,
        "start",
        F.coalesce(F.lead("start").over(order) - 1, F.max("stop").over(Window.partitionBy(*key))).alias("stop"),
        F.last("a", ignorenulls=True).over(upto).alias("a"),
        F.last("b", ignorenulls=True).over(upto).alias("b"),
    )
    return cut


def informativeness(segments: DataFrame, key: list[str], identical: bool = False) -> DataFrame:
    """(key, code): 1 if `a` says at least as much as `b` everywhere, -1 if it says less, 0 if neither or they contradict. `a` and `b` are
    bit sets of possible states; 15 is unknown. With `identical` only equal sets count as 1, and anything else as 0."""
    a, b = F.col("a"), F.col("b")
    if identical:
        return segments.groupBy(*key).agg(F.when(F.bool_and(a == b), 1).otherwise(0).alias("code"))
    clash = F.bool_or((a.bitwiseAND(b) != a) & (a.bitwiseAND(b) != b))
    more, less = F.bool_or((a != b) & (a.bitwiseAND(b) == a)), F.bool_or((a != b) & (a.bitwiseAND(b) == b))
    flags = segments.groupBy(*key).agg(clash.alias("clash"), more.alias("more"), less.alias("less"))
    code = F.when(F.col("clash") | (F.col("more") & F.col("less")), 0).when(F.col("less"), -1).otherwise(1)
    return flags.select(*key, code.alias("code"))


def coalesce_runs(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """(key, run, value, first, last, n): maximal runs of equal neighbouring values."""
    w = Window.partitionBy(*key).orderBy(order)
    flagged = rows.withColumn("new", F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1)))
    runs = flagged.withColumn("run", F.sum("new").over(w))
    return runs.groupBy(*key, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def _near(a: Column, b: Column, limit: float) -> Column:
    """Are two numbers at most `limit` apart? A missing one is near a missing one only."""
    return F.coalesce(F.abs(a - b) <= limit, a.isNull() & b.isNull())


def _pairs_of(a: Column, b: Column) -> Column:
    return F.arrays_zip(a.alias("a"), b.alias("b"))


def equal_runs(a: Column, b: Column, limit: float = 1e-50) -> Column:
    """Are two runs (type, n, r, v) the same: their types, and both lengths and each value of the vector within `limit`?"""
    values = F.when(a["v"].isNull() | b["v"].isNull(), a["v"].isNull() & b["v"].isNull()).otherwise((F.size(a["v"]) == F.size(b["v"])) & F.forall(_pairs_of(a["v"], b["v"]), lambda x: _near(x["a"], x["b"], limit)))
    return a["type"].eqNullSafe(b["type"]) & _near(a["n"], b["n"], limit) & _near(a["r"], b["r"], limit) & values


def changed_runs(a: Column, b: Column, limit: float = 1e-8, update: float = 1e-7, fold: float = 1.001) -> Column:
    """Do two runs over one segment differ so much that what hangs on them has to be found anew? Types differ; or a length does by more than
    `limit` (that beyond the root only where a state is known, none at an unknown run); or a value of the vector is zero on one
    side only, or differs by more than `update`, or by more than `limit` and by more than `fold` times one of both."""

    def moved(x: Column) -> Column:
        d = F.abs(x["a"] - x["b"])
        return (d > 0) & ((x["a"] == 0) | (x["b"] == 0) | (d > update) | ((d > limit) & ((d > fold * x["a"]) | (d > fold * x["b"]))))

    lengths = ~_near(a["n"], b["n"], limit)
    vector = F.coalesce(F.exists(_pairs_of(a["v"], b["v"]), moved), ~(a["v"].isNull() & b["v"].isNull()))
    same = F.when(a["type"] == "N", False).when(a["type"] == "O", lengths | vector).otherwise(lengths | ~_near(a["r"], b["r"], limit))
    return F.when(a["type"] == b["type"], same).otherwise(True)


def equal_lists(left: DataFrame, right: DataFrame, key: list[str], limit: float = 1e-50) -> DataFrame:
    """(key, equal): do lists of runs (key, start, stop, run) have the same borders and equal runs? A list that only one side has is not equal."""
    a, b = (x.select(*key, "start", "stop", F.col("run").alias(n)) for x, n in ((left, "a"), (right, "b")))
    both = a.join(b, [*key, "start", "stop"], "full_outer")
    same = F.col("a").isNotNull() & F.col("b").isNotNull() & equal_runs(F.col("a"), F.col("b"), limit)
    return both.groupBy(*key).agg(F.bool_and(same).alias("equal"))


def changed_lists(left: DataFrame, right: DataFrame, key: list[str], **limits: float) -> DataFrame:
    """(key, n_changed, changed): shared segments whose runs have changed, and whether the lists have: they are of unequal number of runs, or
    a segment has changed. Lists that each cover one length; one that only one side has is changed in every run."""
    cut = overlay(left, right, key, "run").withColumn("moved", changed_runs(F.col("a"), F.col("b"), **limits))
    found = cut.groupBy(*key).agg(F.count(F.when(F.col("moved"), 1)).alias("n_changed"))
    runs = left.select(*key, F.lit(1).alias("one")).unionByName(right.select(*key, F.lit(-1).alias("one"))).groupBy(*key).agg(F.sum("one").alias("more"))
    return found.join(runs, key).select(*key, "n_changed", ((F.col("n_changed") > 0) | (F.col("more") != 0)).alias("changed"))


def coalesce_within(runs: DataFrame, key: list[str], limit: float, type_: str = "R") -> DataFrame:
    """(key, start, stop, run): neighbouring runs of one type whose lengths are less than `limit` from those of the run before become one, which has
    the lengths of the last. Other runs stay as they are."""
    order = Window.partitionBy(*key).orderBy("start")
    run, before = F.col("run"), F.col("before")
    within = lambda c: F.coalesce(F.abs(run[c] - before[c]) < limit, run[c].isNull() & before[c].isNull())
    joined = F.coalesce((run["type"] == type_) & (before["type"] == type_) & within("n") & within("r"), F.lit(False))
    flagged = runs.withColumn("before", F.lag("run").over(order)).withColumn("new", (~joined).cast("int"))
    islands = flagged.withColumn("island", F.sum("new").over(order))
    return islands.groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max_by("run", "start").alias("run")).drop("island")


def prefix_sums(rows: DataFrame, key: list[str], order: str, values: dict[str, Column], block: int = 65_536) -> DataFrame:
    """(key, order, one column per value): inclusive running sums in two levels, so no task orders more than a block."""
    rows = rows.select(*key, order, F.floor(F.col(order) / block).alias("block"), *[v.alias(k) for k, v in values.items()])
    inside = Window.partitionBy(*key, "block").orderBy(order)
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*key, "block").agg(*[F.sum(k).alias(k) for k in values])
    bases = totals.select(*key, "block", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in values])
    local = rows.select(*key, order, "block", *[F.sum(k).over(inside).alias(k) for k in values])
    return local.join(bases, [*key, "block"]).select(*key, order, *[(F.col(k) + F.col(f"{k}_before")).alias(k) for k in values])

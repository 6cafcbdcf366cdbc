"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import checkpoint

#: Tables of pointers that are followed in one query at the end.
_FOLLOWED = 4


def _counted(df: DataFrame, what: Column) -> tuple[DataFrame, int]:
    """The written frame, and how many of its rows meet a condition, counted while they are written."""
    seen = Observation()
    out = checkpoint(df.observe(seen, F.count(F.when(what, 1)).alias("n")))
    return out, seen.get["n"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that can be reached.

    Each round points a node at the smallest of its neighbours and itself (partly aggregated before the shuffle, so a hub costs
    one row per task), follows pointers to their ends by doubling, and puts those in place of the nodes. Edges that have become
    loops or equal go, so a round leaves at most half of the nodes of a component that is not done. Pointers lead to smaller
    nodes only, so what is left of it at last is its smallest node. What is left is counted while it is written, so a round has
    no job but those that write its tables.
    """
    ends = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    left = checkpoint(edges.select(ends(F.col(a), F.col(b)).alias("e")).select("e.a", "e.b").where("a < b").distinct())
    pointers: list[DataFrame] = []
    rest = 1
    while rest or not pointers:
        ways = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("w"))
        up = checkpoint(ways.groupBy("w.node").agg(F.min("w.other").alias("least")).select("node", F.least("node", "least").alias("up")))
        moving = 1
        while moving:
            above = lambda table: table.select(F.col("node").alias("up"), F.col("up").alias("top"))
            once = up.join(above(up), "up").select("node", F.col("top").alias("up"))
            # where a second step over the same pointers leads no further, all pointers are at their ends
            twice = once.join(above(up), "up").select("node", F.col("top").alias("up"), (F.col("up") != F.col("top")).alias("moved"))
            up, moving = _counted(twice, F.col("moved"))
            up = up.drop("moved")
        at = lambda x, table=up: table.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}"))
        moved = left.join(at("a"), "a").join(at("b"), "b").select(ends(F.col("up_a"), F.col("up_b")).alias("e")).select("e.a", "e.b")
        left, rest = _counted(moved.where("a < b").distinct(), F.lit(True))
        pointers.append(up.withColumnRenamed("up", "component"))
        if len(pointers) > _FOLLOWED:
            pointers = [checkpoint(_followed(pointers))]
    return checkpoint(_followed(pointers)) if len(pointers) > 1 else pointers[0]


def _followed(pointers: list[DataFrame]) -> DataFrame:
    """(node, component) of the first table, its components followed through the later ones, which hold what was left."""
    labels, *more = pointers
    for table in more:
        above = table.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = labels.join(above, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return labels

"""Operators on trees as node tables (node, parent), in rounds of joins whose number grows with the logarithm of the depth.

Pointers to ancestors are doubled: after k rounds every node knows its ancestor 2**k above. So trees of any shape cost a few joins of
node tables, and nothing follows one level after the other.

A node whose parent is not in the table is the root of a tree of its own; parents that form a cycle are an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names for checkpoints. Only where driver and executors are one process (tests) may a
    local one take its place."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{named or tempfile.mkdtemp(prefix='tideline-')}/{name}-{uuid.uuid4()}"


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder, which cuts its lineage and gives its true size to the next plan."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, what: Column) -> tuple[DataFrame, int]:
    """The frame as such a table, and how many of its rows meet a condition, counted while it is written."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.when(what, 1)).alias("n")))
    return out, seen.get["n"]


def rooted(nodes: DataFrame) -> DataFrame:
    """The nodes with null for a parent that is not in the table: such a node is a root."""
    known = nodes.select(F.col("node").alias("_known")).where("_known is not null").distinct()
    joined = nodes.join(known, F.col("parent") == F.col("_known"), "left")
    return joined.select(*[F.col("_known").alias("parent") if c == "parent" else F.col(c) for c in nodes.columns])


def _rounds(open_nodes: int) -> Iterator[None]:
    """As many rounds as pointers need to be doubled until none of so many nodes has one; more mean that parents form a cycle."""
    for _ in range(max(1, open_nodes).bit_length() + 2):
        yield
    raise ValueError("parents form a cycle")


def climbed(nodes: DataFrame, values: dict[str, str], kind: str = "bigint") -> DataFrame:
    """(node, top, steps, the columns of `values`): the root above each node, how many ancestors it has, and the sums of columns over itself
    and its ancestors. A parent that is not in the table counts as none; a cycle is an error."""
    start = rooted(nodes).select("node", F.col("parent").alias("up"), F.coalesce("parent", "node").alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("steps"), *[F.col(v).cast(kind).alias(k) for k, v in values.items()])
    ways, left = counted(start, F.col("up").isNotNull())
    rounds = _rounds(left)
    while left:
        next(rounds)
        above = ways.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("top").alias("next_top"), F.col("steps").alias("more"), *[F.col(k).alias(f"more_{k}") for k in values])
        moved = ways.where("up is not null").join(above, "up").select("node", F.col("next").alias("up"), F.col("next_top").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), *[(F.col(k) + F.col(f"more_{k}")).alias(k) for k in values])
        ways, left = counted(moved.unionByName(ways.where("up is null")), F.col("up").isNotNull())
    return ways.drop("up")


def _climb(nodes: DataFrame, values: dict[str, str]) -> DataFrame:
    """(node, steps, the columns of `values`), see `climbed`."""
    return climbed(nodes, values).drop("top")


def depths(nodes: DataFrame) -> DataFrame:
    """(node, parent, depth), the root at 0."""
    return nodes.select("node", "parent").join(_climb(nodes, {}).select("node", F.col("steps").cast("int").alias("depth")), "node")


def _below(nodes: DataFrame, own: DataFrame) -> DataFrame:
    """(node, n): the sum of `own` (node, n) over a node and all below it.

    Each round adds what has been gathered by nodes 2**k below, then doubles the pointers."""
    total, left = counted(rooted(nodes).select("node", F.col("parent").alias("up")).join(own, "node", "left").fillna(0, ["n"]), F.col("up").isNotNull())
    rounds = _rounds(left)
    while left:
        next(rounds)
        gained = total.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("n").alias("more"))
        above = total.select(F.col("node").alias("up"), F.col("up").alias("next"))
        summed = total.join(gained, "node", "left").join(above, "up", "left")
        total, left = counted(summed.select("node", F.col("next").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), F.col("up").isNotNull())
    return total.select("node", "n")


def subtree_counts(nodes: DataFrame, weight: str | None = None) -> DataFrame:
    """(node, n): number (or sum of `weight`) of the leaves below a node, itself included if it is one."""
    inner = nodes.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    leaves = nodes.join(inner, "node", "left_anti").select("node", (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("n"))
    return _below(nodes, leaves)


def pre_order(nodes: DataFrame, order: str = "node") -> DataFrame:
    """(node, depth, place): position in pre-order with siblings by `order`: a node adds one and the sizes of its siblings before to its
    parent's place."""
    return toured(nodes, order).select("node", "depth", "place")


def toured(nodes: DataFrame, order: str = "node") -> DataFrame:
    """(node, depth, place, size, nth, enter, leave): pre-order with siblings by `order`, the nodes below (itself included), the number among its
    siblings (from 1), and when a walk around the tree enters a node and leaves it: numbers from 0 without a gap, two for each node."""
    nodes = rooted(nodes)
    sizes = _below(nodes, nodes.select("node", F.lit(1).cast("bigint").alias("n"))).withColumnRenamed("n", "size")
    siblings = Window.partitionBy("parent").orderBy(order)
    shift = F.when(F.col("parent").isNull(), 0).otherwise(1 + F.coalesce(F.sum("size").over(siblings.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.when(F.col("parent").isNull(), 1).otherwise(F.row_number().over(siblings))
    known = written(nodes.join(sizes, "node").select("node", "parent", "size", shift.alias("shift"), nth.cast("int").alias("nth")))
    placed = climbed(known.select("node", "parent", "shift"), {"place": "shift"}).select("node", F.col("steps").cast("int").alias("depth"), "place")
    # of the nodes before a node all have been left but those above it
    enter = 2 * F.col("place") - F.col("depth")
    return placed.join(known.select("node", "size", "nth"), "node").select("node", "depth", "place", "size", "nth", enter.alias("enter"), (enter + 2 * F.col("size") - 1).alias("leave"))


def ancestors(nodes: DataFrame, node: object) -> DataFrame:
    """(node, parent) of a node and all nodes above it: pointers are doubled, and what is marked marks what it points at."""
    going = F.col("up").isNotNull() & F.col("marked")
    start = rooted(nodes).select("node", "parent", F.col("parent").alias("up"), (F.col("node") == F.lit(node)).alias("marked"))
    ways, left = counted(start, going)
    rounds = _rounds(nodes.count())
    while left:
        next(rounds)
        hit = ways.where("marked and up is not null").select(F.col("up").alias("node")).distinct().withColumn("hit", F.lit(True))
        above = ways.select(F.col("node").alias("up"), F.col("up").alias("next"))
        ways = ways.join(hit, "node", "left").join(above, "up", "left").select("node", "parent", F.col("next").alias("up"), (F.col("marked") | F.coalesce("hit", F.lit(False))).alias("marked"))
        ways, left = counted(ways, going)
    return ways.where("marked").select("node", "parent")


def reroot(nodes: DataFrame, new_root: object) -> DataFrame:
    """(node, parent) with `new_root` as the root: parents on the path to the old root are turned around."""
    turned = ancestors(nodes, new_root).where("parent is not null").select(F.col("parent").alias("node"), F.col("node").alias("below"))
    return nodes.join(turned, "node", "left").select("node", F.when(F.col("node") == F.lit(new_root), F.lit(None)).otherwise(F.coalesce("below", "parent")).alias("parent"))


def reroot_branch(nodes: DataFrame, below: object, share: float = 0.5, new_root: object = None, notes: tuple[str, ...] = ()) -> DataFrame:
    """The tree (node, parent, length, other columns) with its root on the branch above the node `below`, `share` of it towards that node.

    On the way to the old root parents turn around, and lengths and `notes`, columns that say something of a branch, go with the branches
    to the nodes that are below them now; both halves of the split branch keep its notes. An old root with two children
    goes, since it would be left between two branches: they become one, as long as both, with the notes of the branch that the new
    root is not on, and the old root's row is the new root. An old root with other numbers of children stays, and `new_root`
    names the new one. If `below` is a root, or hangs on one with two children, the root is on its branch already and nothing is changed."""
    up = ancestors(nodes, below)
    ends = up.where("parent is null").select("node").take(1)
    if not ends:
        raise ValueError(f"no node {below}")
    root = ends[0].node
    children = nodes.where(F.col("parent") == F.lit(root)).select("node").take(3)
    pair = len(children) == 2
    if root == below or (pair and below in [c.node for c in children]):
        return nodes
    if not pair and new_root is None:
        raise ValueError(f"the root {root} has not two children and stays; name the new one")
    top = F.lit(root if pair else new_root).cast(nodes.schema["node"].dataType)
    branch = ["length", *notes]
    path = up.where("parent is not null").select(F.col("parent").alias("_turned"), F.col("node").alias("_child"))
    path = written(path.join(nodes.select(F.col("node").alias("_child"), *[F.col(c).alias(f"_{c}") for c in branch]), "_child"))
    node, child = F.col("node"), F.col("_child")
    part = lambda c, w: F.when(c > 0, c * w).when(c.isNotNull(), 0.0)
    own = {"parent": F.when((node == F.lit(below)) | (child == F.lit(below)), top).otherwise(F.coalesce(child, "parent"))}
    own["length"] = F.when(node == F.lit(below), part(F.col("length"), share)).when(child == F.lit(below), part(F.col("_length"), 1 - share)).when(child.isNotNull(), F.col("_length")).otherwise(F.col("length"))
    own |= {c: F.when(child.isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in notes}
    joined = nodes.join(path, node == F.col("_turned"), "left")
    if not pair:
        fresh = {"node": top}
        turned = joined.select(*[own.get(c, F.col(c)).alias(c) for c in nodes.columns])
        row = nodes.limit(1).select(*[fresh.get(c, F.lit(None)).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns])
        return turned.unionByName(row)
    # the branches on both sides of the old root become one
    last = path.where(F.col("_turned") == F.lit(root)).select("_child", "_length").first()
    sibling = (F.col("parent") == F.lit(root)) & (node != F.lit(last["_child"]))
    one = F.when(F.col("length").isNull() & F.lit(last["_length"] is None), F.lit(None)).otherwise(F.coalesce("length", F.lit(0.0)) + F.lit(last["_length"] or 0.0))
    is_root = node == F.lit(root)
    own["parent"] = F.when(is_root, F.lit(None)).when(sibling, F.lit(last["_child"])).otherwise(own["parent"])
    own["length"] = F.when(is_root, F.lit(None)).when(sibling, one).otherwise(own["length"])
    own |= {c: F.when(is_root, F.lit(None)).otherwise(own[c]) for c in notes}
    return joined.select(*[own.get(c, F.col(c)).alias(c) for c in nodes.columns])


def unknown_leaves(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(node, name) of leaves (rows with a name) that the alignment's names do not have: a tree is bound only if there are none."""
    return nodes.where("name is not null").join(names.select("name").distinct(), "name", "left_anti").select("node", "name")


def bind(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Add `seq`, the alignment's row (seq, name), to the leaves of a tree by name; binding anew replaces an older `seq`."""
    return nodes.drop("seq").join(rows.select("name", "seq"), "name", "left")


def unplaced(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (seq, name) of the alignment that no leaf stands for; none means that the tree is complete."""
    return rows.join(nodes.select("name").where("name is not null").distinct(), "name", "left_anti")


def collapsed(nodes: DataFrame, limit: float) -> DataFrame:
    """(node, host): leaves on branches of at most `limit` beside a sibling leaf that is on one as well, with the sibling that keeps the
    place, the smallest of them. `nodes` is (node, parent, length)."""
    inner = nodes.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    short = nodes.join(inner, "node", "left_anti").where(F.col("length") <= limit)
    host = F.min("node").over(Window.partitionBy("parent"))
    return short.withColumn("host", host).where("node <> host").select("node", "host")

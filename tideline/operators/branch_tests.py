"""Support of inner branches by resampling sites: how often a tree beats its two neighbours by less than chance would.

An inner branch has two subtrees at either end. Swapping one from each end gives the two neighbouring trees; all that differs are three merges, so
log-likelihoods of the three trees differ at few sites, and only those differences are kept. A replicate draws as many sites as there are, with
replacement, by a hash of replicate and draw: a weight for each site. Sums of weights times differences are partial aggregates over (branch,
replicate), joined by site. Lengths stay as they are in the neighbouring trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import algebra, passes
from .algebra import Model
from .trees import written

#: Replicates, and what is added to a difference before it counts.
REPLICATES, EPSILON = 1_000, 0.05
#: The pairs of subtrees (0 and 1 on one end, 2 and 3 on the other) that stand together in the tree and its two neighbours.
PAIRINGS = (((0, 1), (2, 3)), ((2, 1), (0, 3)), ((0, 2), (1, 3)))


def quartets(nodes: DataFrame, lower: DataFrame, rest: DataFrame) -> DataFrame:
    """(tree, node, center, slot, t, start, ...): the lists of the four subtrees around the branch above each inner `node`, with the lengths `t` to them.

    Slots 0 and 1 are the node's children; slot 2 is its sibling and slot 3 the rest of the tree, as seen from the parent's place, over its own branch. At
    the root both are the sibling's children, and the two branches there are one. Branches without length, at a leaf, or at nodes of another number of
    children than two have no neighbours. `nodes` is (tree, node, parent, length), `lower` (tree, node, ...), `rest` (tree, node, ...)."""
    length = F.coalesce("length", F.lit(0.0)).alias("length")
    known = nodes.select("tree", "node", "parent", length)
    kids = known.where("parent is not null").groupBy("tree", F.col("parent").alias("at")).agg(F.sort_array(F.collect_list(F.struct("node", "length"))).alias("kids")).where(F.size("kids") == 2)
    of = lambda name: kids.select("tree", F.col("at").alias(name), F.col("kids").alias(f"{name}_kids"))
    above = known.select("tree", F.col("node").alias("parent"), F.col("parent").alias("grand"), F.col("length").alias("parent_length"))
    inner = known.where("parent is not null").join(of("node"), ["tree", "node"]).join(of("parent"), ["tree", "parent"]).join(above, ["tree", "parent"])
    sibling = F.element_at(F.filter("parent_kids", lambda k: k["node"] != F.col("node")), 1)
    inner = inner.withColumn("sibling", sibling["node"]).withColumn("sibling_length", sibling["length"])
    inner = inner.join(of("sibling"), ["tree", "sibling"], "left")
    at_root = F.col("grand").isNull()
    center = F.when(at_root, F.col("length") + F.col("sibling_length")).otherwise(F.col("length"))
    slot = lambda number, kind, node, t: F.struct(F.lit(number).alias("slot"), F.lit(kind).alias("kind"), node.alias("of"), t.alias("t"))
    own = [slot(i, "lower", F.col("node_kids")[i]["node"], F.col("node_kids")[i]["length"]) for i in (0, 1)]
    far = [slot(2 + i, "lower", F.get("sibling_kids", F.lit(i))["node"], F.get("sibling_kids", F.lit(i))["length"]) for i in (0, 1)]
    near = [slot(2, "lower", F.col("sibling"), F.col("sibling_length")), slot(3, "rest", F.col("parent"), F.col("parent_length"))]
    usable = (center > 0) & (~at_root | F.col("sibling_kids").isNotNull())
    each = inner.where(usable).select("tree", "node", center.alias("center"), F.inline(F.when(at_root, F.array(*own, *far)).otherwise(F.array(*own, *near))))
    lists = lower.select("tree", F.col("node").alias("of"), F.lit("lower").alias("kind"), *passes.PARTS).unionByName(rest.select("tree", F.col("node").alias("of"), F.lit("rest").alias("kind"), *passes.PARTS))
    return each.join(lists, ["tree", "of", "kind"]).select("tree", "node", "center", "slot", "t", *passes.PARTS)


def site_differences(around: DataFrame, m: Model, sums: DataFrame, ends: DataFrame) -> DataFrame:
    """(tree, node, pos, d2, d3): log-likelihoods of sites in the two neighbouring trees less that in the tree, where they differ. `around` comes from
    `quartets`, `sums` is (pos, ref, rate, ...) with the reference's running sums of rates."""
    key = ["tree", "node"]
    lengths = around.groupBy(*key).agg(F.max("center").alias("center"), *[F.max(F.when(F.col("slot") == i, F.col("t"))).alias(f"t{i}") for i in range(4)])
    run = lambda i: F.col("cells")[i]["cell"]["run"]
    t = lambda i: F.col(f"t{i}")
    # where one determined state, the reference or nothing known stands at all four ends, the three trees say the same
    alike = (run(0)["type"] != "O") & (run(0)["type"] == run(1)["type"]) & (run(0)["type"] == run(2)["type"]) & (run(0)["type"] == run(3)["type"])
    met = passes.laid_over(around.select(*key, "slot", *passes.PARTS), key, ends, [0, 1, 2, 3]).where(~F.coalesce(alike, F.lit(False))).join(lengths, key)
    ref, same = F.col("ref"), F.col("same_rate")

    def merged(a: Column, t_a: Column, b: Column, t_b: Column) -> Column:
        never = F.struct(F.lit(None).cast(algebra.RUN).alias("run"), F.lit(float("-inf")).alias("gain"))
        return F.when(a.isNull() | b.isNull(), never).otherwise(algebra.merge_lowers(m, a, t_a, b, t_b, ref, same))

    half = F.col("center") / 2
    # each merge is bound to a name of its own, as the next one looks at it many times
    bound = algebra.bound

    def term(pairs: tuple) -> Column:
        (i, j), (k, l) = pairs
        both = F.struct(merged(run(i), t(i), run(j), t(j)).alias("a"), merged(run(k), t(k), run(l), t(l)).alias("b"))
        at_root = lambda r: r["gain"] + F.coalesce(algebra.root_likelihood(m, r["run"], ref, F.col("same_pi")), F.lit(0.0))
        return bound(both, lambda p: p["a"]["gain"] + p["b"]["gain"] + bound(merged(p["a"]["run"], half, p["b"]["run"], half), at_root))

    found = met.select(*key, "start", "stop", "same_rate", *[term(pairs).alias(f"lh{k}") for k, pairs in enumerate(PAIRINGS)])
    found = written(found)
    off = found.select(*key, "start", "stop", "same_rate", (F.col("lh1") - F.col("lh0")).alias("d2"), (F.col("lh2") - F.col("lh0")).alias("d3")).where("abs(d2) > 1e-12 or abs(d3) > 1e-12")
    single = off.where("start = stop").select(*key, F.col("start").alias("pos"), "d2", "d3")
    # a long segment is equal to the reference where it is known: sites share by their rates
    before = sums.select((F.col("pos") + 1).alias("pos"), F.col("rate").alias("before"))
    own = sums.select("pos", "rate").join(before, "pos", "left").select("pos", (F.col("rate") - F.coalesce("before", F.lit(0.0))).alias("own"))
    long = off.where("start < stop").withColumn("pos", F.explode(F.sequence("start", "stop"))).join(own, "pos")
    shared = lambda d: F.coalesce(F.try_divide(F.col(d) * F.col("own"), F.col("same_rate")), F.lit(0.0)).alias(d)
    return single.unionByName(long.select(*key, "pos", shared("d2"), shared("d3")))


def drawn_site(replicate: Column, draw: Column, sites: int, seed: int = 0) -> Column:
    """The site of one draw: 32 bits of a hash of seed, replicate and draw, so reruns agree, on any number of machines."""
    text = F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), draw.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % sites).cast("int")


def site_weights(spark: SparkSession, sites: int, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, pos, w): how often each site is drawn, less the once that it stands in the data; sites drawn once are left out."""
    draws = spark.range(replicates * sites).select((F.col("id") / sites).cast("int").alias("replicate"), (F.col("id") % sites).alias("draw"))
    drawn = draws.select("replicate", drawn_site(F.col("replicate"), F.col("draw"), sites, seed).alias("pos")).groupBy("replicate", "pos").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(replicates * sites).select((F.col("id") / sites).cast("int").alias("replicate"), (F.col("id") % sites).cast("int").alias("pos"))
    return every.join(drawn, ["replicate", "pos"], "left").select("replicate", "pos", (F.coalesce("n", F.lit(0)) - 1).alias("w")).where("w <> 0")


def resampled_supports(around: DataFrame, differences: DataFrame, weights: DataFrame, replicates: int = REPLICATES, epsilon: float = EPSILON) -> DataFrame:
    """(tree, node, d2, d3, support): for each branch of `around` the differences of its neighbours, and the share of replicates, of 100, in which the
    tree's lead over the better one exceeds the lead that the best of the three centred sums has over the second, and half an epsilon.

    Sums of the three trees are only compared, so they are taken less that of the tree itself: 0 and two sums of weighted differences."""
    key = ["tree", "node"]
    totals = differences.groupBy(*key).agg(F.sum("d2").alias("d2"), F.sum("d3").alias("d3"))
    every = around.select(*key).distinct().join(totals, key, "left").fillna(0.0, ["d2", "d3"])
    sums = differences.join(weights, "pos").groupBy(*key, "replicate").agg(F.sum(F.col("d2") * F.col("w")).alias("x2"), F.sum(F.col("d3") * F.col("w")).alias("x3"))
    lead = -F.greatest("d2", "d3")
    zero = F.lit(0.0)
    top = F.greatest(zero, "x2", "x3")
    second = F.greatest(F.least(zero, F.col("x2")), F.least(F.greatest(zero, F.col("x2")), F.col("x3")))
    hits = sums.join(every, key).groupBy(*key).agg(F.sum((lead > top - second + epsilon).cast("bigint")).alias("hits"), F.count(F.lit(1)).alias("n"))
    # a replicate that draws no site with a difference has three equal sums
    still = F.when(lead > epsilon, F.lit(replicates) - F.coalesce("n", F.lit(0))).otherwise(0)
    return every.join(hits, key, "left").select(*key, "d2", "d3", (100.0 * (F.coalesce("hits", F.lit(0)) + still) / replicates).alias("support"))

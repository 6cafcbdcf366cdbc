"""Rates of single sites from a tree: changes and waiting times along its branches, and a matrix for each site by turns of both.

All is by (site, state): what a branch says about a site with a determined or an ambiguous state at its ends is a few rows; where both ends are
equal to the reference over a long run, its two borders are, and sums along the reference say the rest. So rows grow with the
differences in a tree, not with branches times sites.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import passes
from .algebra import Model
from .segments import prefix_sums
from .trees import written

#: Bounds of one rate for a site, and of an entry of a site's matrix.
RATE_BOUNDS, ENTRY_BOUNDS = (1e-4, 100.0), (1e-3, 250.0)
#: Added to every waiting time, and as much of the mean count to counts.
PSEUDO_WAIT = 0.1
#: Sites whose running sums one task takes.
BLOCK = 65_536


def _equal_runs(branches: DataFrame) -> Column:
    return (F.col("above.type") == "R") & (F.col("below.type") == "R")


def _along_reference(runs: DataFrame, sites: DataFrame) -> DataFrame:
    """(pos, state, wait): for each site its reference's state and the sum of `wait` over the runs (start, stop, wait) that hold it."""
    borders = runs.select(F.col("start").alias("pos"), F.col("wait")).unionByName(runs.select((F.col("stop") + 1).alias("pos"), (-F.col("wait")).alias("wait")))
    return _from_borders(borders.groupBy("pos").agg(F.sum("wait").alias("change")), sites)


def _from_borders(change: DataFrame, sites: DataFrame) -> DataFrame:
    """The same from what runs that start or have stopped at a site change there (pos, change)."""
    every = sites.select("pos", "ref").join(change, "pos", "left").fillna(0.0, ["change"])
    sums = prefix_sums(every, [], "pos", {"wait": F.col("change")}, BLOCK)
    # what is left of sums that cancel is not a waiting time
    return sums.join(sites.select("pos", F.col("ref").alias("state")), "pos").select("pos", "state", F.when(F.col("wait") > 1e-12, F.col("wait")).otherwise(0.0).alias("wait"))


def single_rates(branches: DataFrame, sites: DataFrame, diagonal: DataFrame) -> DataFrame:
    """(pos, rate): changes at a site over those to be expected while it waited in determined states; 0.001 without any change, 1 where hardly
    any is to be expected; divided by the mean, and bounded. `sites` is (pos, ref), `diagonal` (state, q)."""
    own = branches.where("length > 0 and above.type not in ('N', 'O') and below.type not in ('N', 'O')")
    fact = lambda pos, state, wait, n: F.struct(pos.alias("pos"), state.cast("string").alias("state"), wait.cast("double").alias("wait"), F.lit(n).cast("bigint").alias("n"))
    start, length = F.col("start"), F.col("length")
    borders = F.array(fact(start, F.lit("R"), length, 0), fact(F.col("stop") + 1, F.lit("R"), -length, 0))
    facts = F.when(_equal_runs(own), borders).when(F.col("above.type") == F.col("below.type"), F.array(fact(start, F.col("above.type"), length, 0))).otherwise(F.array(fact(start, F.lit(None), F.lit(0.0), 1)))
    # branches are read once, and leave a row for each site and state
    met = written(own.select(F.inline(facts)).groupBy("pos", "state").agg(F.sum("wait").alias("wait"), F.sum("n").alias("n")))
    waits = _from_borders(met.where("state = 'R'").select("pos", F.col("wait").alias("change")), sites).unionByName(met.where("state <> 'R'").select("pos", "state", "wait"))
    expected = waits.join(F.broadcast(diagonal), "state").groupBy("pos").agg(F.sum(F.col("wait") * F.abs("q")).alias("expected"))  # a row for each state
    changes = met.where("state is null").select("pos", "n")
    per = sites.select("pos").join(expected, "pos", "left").join(changes, "pos", "left").fillna(0)
    raw = F.when(F.col("n") == 0, 0.001).when(F.col("expected") <= 0.01, 1.0).otherwise(F.col("n") / F.col("expected"))
    scaled = per.select("pos", raw.alias("raw"))
    mean = scaled.agg(F.avg("raw").alias("mean"))
    low, high = RATE_BOUNDS
    return scaled.crossJoin(F.broadcast(mean)).select("pos", F.least(F.greatest(F.col("raw") / F.col("mean"), F.lit(low)), F.lit(high)).alias("rate"))  # one row


def expected_changes(branches: DataFrame, m: Model, sites: DataFrame, matrices: DataFrame) -> DataFrame:
    """(pos, from_state, to_state, c, wait): expected changes, and with to_state null expected waiting times, of each site by the current matrices
    (pos, q). Branches without length, and ends that were seen further below, say nothing.

    With ambiguous ends, every pair of states counts by its likelihood, rounded to three decimals at each end; where the upper end was last seen
    beyond the root, a change may lie on either side of it."""
    states = [F.lit(s) for s in m.states]
    n = len(states)
    own = branches.where("length > 0 and above.type <> 'N' and below.type <> 'N' and coalesce(below.n, 0.0) <= 0")
    a, b, t = F.col("above"), F.col("below"), F.col("length")
    seen, beyond = F.coalesce(a["n"], F.lit(0.0)), F.coalesce(a["r"], F.lit(0.0))
    far = t + F.when(beyond > 0, beyond).otherwise(seen)
    long = own.where(_equal_runs(own)).select("start", "stop", far.alias("wait"))
    single = own.where(~_equal_runs(own)).withColumn("far", far).join(matrices, F.col("start") == F.col("pos"))
    determined = (a["type"] != "O") & (b["type"] != "O")
    across = F.when(determined, beyond > 0).otherwise(a["r"].isNotNull())
    index = lambda x: m.index(F.when(x["type"] == "R", F.col("ref")).otherwise(x["type"]))
    vector = lambda x: F.when(x["type"] == "O", F.transform(x["v"], lambda y: F.floor(y * 1000 + 0.5) / 1000)).otherwise(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i == index(x), 1.0).otherwise(0.0)))
    # a table of its own: the optimizer moves conditions on what follows below the join, where the matrix is not known yet
    single = written(single.select("pos", "q", "far", across.alias("across"), (t + beyond).alias("to_root"), seen.alias("to_seen"), vector(a).alias("av"), vector(b).alias("bv")))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.struct((F.floor(k / n) + 1).cast("int").alias("i"), (k % n + 1).cast("int").alias("j")))
    weighed = single.withColumn("pairs", pairs)
    rate = lambda i, j: F.element_at(F.element_at(F.col("q"), i), j)
    weight = lambda p: F.element_at("av", p["i"]) * F.element_at("bv", p["j"]) * F.when(p["i"] == p["j"], 1 - F.col("far") * rate(p["i"], p["j"])).otherwise(F.col("far") * rate(p["i"], p["j"]))
    weighed = weighed.withColumn("w", F.transform("pairs", weight)).withColumn("total", F.aggregate("w", F.lit(0.0), lambda s, x: s + x)).where("total > 0")
    each = weighed.select("pos", "q", "far", "across", "to_root", "to_seen", F.inline(F.arrays_zip("pairs", "w")), "total")
    each = each.where("w > 0").select("*", F.col("pairs.i").alias("i"), F.col("pairs.j").alias("j"), (F.col("w") / F.col("total")).alias("p"))
    i, j, p = F.col("i"), F.col("j"), F.col("p")
    of_upper = F.element_at(m.pi, i) * rate(i, j) * F.col("to_root")
    of_lower = F.element_at(m.pi, j) * rate(j, i) * F.col("to_seen")
    # the root had the upper state, and the change lies on this side, or the lower one
    share = F.when(~F.col("across"), 1.0).when(i == j, 0.0).otherwise(of_upper / (of_upper + of_lower))
    length = F.when(F.col("across"), F.col("to_root")).otherwise(F.col("far"))
    name = lambda k: F.element_at(F.array(*states), k)
    none = F.lit(None)
    entry = lambda x, y, c, wait: F.struct(x.cast("string").alias("from_state"), y.cast("string").alias("to_state"), c.cast("double").alias("c"), wait.cast("double").alias("wait"))
    changed = F.array(entry(name(i), name(j), p * share, none), entry(name(i), none, none, p * share * length / 2), entry(name(j), none, none, p * share * length / 2 + F.when(F.col("across"), p * (1 - share) * length).otherwise(0.0)))
    stayed = F.array(entry(name(i), none, none, p * length))
    rows = each.select("pos", F.inline(F.when(i == j, stayed).otherwise(changed)))
    waits = _along_reference(long, sites).where("wait > 0").select("pos", F.col("state").alias("from_state"), none.cast("string").alias("to_state"), none.cast("double").alias("c"), "wait")
    return rows.unionByName(waits).groupBy("pos", "from_state", "to_state").agg(F.sum("c").alias("c"), F.sum("wait").alias("wait"))


def count_matrices(changes: DataFrame, sites: DataFrame, states: str = "ACGT", pseudo: float = PSEUDO_WAIT) -> DataFrame:
    """(pos, q), rows as arrays, for all sites (pos, ref) from `expected_changes`. To every waiting time `pseudo` is added and to every count as many
    changes as all sites together have in that time; the mean rate away from the reference's states is 1; entries are bounded. A state in
    which no site ever waits has the lowest rates."""
    size = sites.agg(F.count(F.lit(1)).alias("size"))
    names = F.array(*[F.lit(s) for s in states])
    grid = sites.select("pos", "ref", F.explode(names).alias("from_state"))
    mean_wait = changes.where("to_state is null").groupBy("from_state").agg(F.sum("wait").alias("all_wait"))
    mean_count = changes.where("to_state is not null").groupBy("from_state", "to_state").agg(F.sum("c").alias("all_c"))
    waits = changes.where("to_state is null").select("pos", "from_state", "wait")
    counts = changes.where("to_state is not null").select("pos", "from_state", "to_state", "c")
    # means over sites have the same divisor, so sums will do
    full = grid.join(waits, ["pos", "from_state"], "left").join(F.broadcast(mean_wait), "from_state", "left").select("*", F.explode(names).alias("to_state")).where("from_state <> to_state")
    full = full.join(counts, ["pos", "from_state", "to_state"], "left").join(F.broadcast(mean_count), ["from_state", "to_state"], "left")  # a row for each pair of states
    added = F.coalesce(F.try_divide(F.col("all_c") * pseudo, F.col("all_wait")), F.lit(0.0))
    rate = (F.coalesce("c", F.lit(0.0)) + added) / (F.coalesce("wait", F.lit(0.0)) + pseudo)
    raw = written(full.select("pos", "ref", "from_state", "to_state", rate.alias("rate")))
    total = raw.where("from_state = ref").agg(F.sum("rate").alias("total")).crossJoin(size).select((F.col("total") / F.col("size")).alias("mean"))
    low, high = ENTRY_BOUNDS
    entry = F.least(F.greatest(F.try_divide(F.col("rate"), F.col("mean")), F.lit(low)), F.lit(high))
    scaled = raw.crossJoin(F.broadcast(total)).select("pos", "from_state", "to_state", F.coalesce(entry, F.lit(low)).alias("q"))  # one row
    diagonal = scaled.groupBy("pos", "from_state").agg((-F.sum("q")).alias("q")).select("pos", "from_state", F.col("from_state").alias("to_state"), "q")
    every = scaled.unionByName(diagonal)
    lines = every.groupBy("pos", "from_state").agg(F.transform(F.array_sort(F.collect_list(F.struct("to_state", "q"))), lambda x: x["q"]).alias("row"))
    return lines.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("from_state", "row"))), lambda x: x["row"]).alias("q"))


def running_sums(sites: DataFrame, matrices: DataFrame, m: Model) -> tuple[DataFrame, DataFrame]:
    """((pos, ref, rate, log_pi), (rate, log_pi)): running sums of the reference's own rates by the sites' matrices, and sums over all sites."""
    number = m.index(F.col("ref"))
    own = sites.select("pos", "ref").join(matrices, "pos").select("pos", "ref", F.element_at(F.element_at("q", number), number).alias("own"), F.log(F.element_at(m.pi, number)).alias("own_pi"))
    sums = prefix_sums(own, [], "pos", {"rate": F.col("own"), "log_pi": F.col("own_pi")}, BLOCK)
    found = written(sums.join(own.select("pos", "ref"), "pos"))
    return found, found.agg(F.max_by("rate", "pos").alias("rate"), F.max_by("log_pi", "pos").alias("log_pi"))


@dataclass
class Turn:
    """One turn of the iteration: the log-likelihood by the matrices it began with, and those it ended with (pos, q)."""

    likelihood: float
    matrices: DataFrame


def iterated_matrices(nodes: DataFrame, regions: DataFrame, sites: DataFrame, m: Model, matrices: DataFrame, rounds: int = 20, least: float = 1.0) -> list[Turn]:
    """Matrices of sites and the likelihood of the trees by turns: both passes with the current matrices, changes and waiting times from them, new
    matrices; until a turn gains no more than `least`, or for `rounds` turns. The last turn has the likelihood of the last matrices.

    `nodes` is (tree, node, parent, length), `regions` the leaves' runs (tree, node, start, stop, type), `sites` (pos, ref), `matrices` (pos, q) to start from.
    Two numbers come to the driver for each turn: likelihoods."""
    steps = passes.chains(nodes)
    regions, turns = written(regions), []
    for turn in range(rounds + 1):
        sums, ends = running_sums(sites, matrices, m)
        leaves = passes.runs_of(regions, sums)
        lower, gains = passes.lower_lists(steps, leaves, m, ends, matrices)
        lh = passes.tree_likelihoods(lower, gains, steps, m, ends).agg(F.sum("lh")).first()[0]
        turns.append(Turn(lh, matrices))
        if turn == rounds or turn and lh - turns[-2].likelihood <= least:
            return turns
        branches = written(passes.branch_sides(steps, lower, m, ends, matrices))
        matrices = written(count_matrices(expected_changes(branches, m, sites, matrices), sites, m.states))
    return turns

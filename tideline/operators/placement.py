"""Hanging sequences on reference profiles by a branch: log-likelihood costs and the best places.

A sequence and a profile are mostly equal to one reference, the commonest state of the profiles at each site. So the cost of a
pair is the sequence's own cost on that reference, plus what the profile's differences change for a sequence that is equal to the
reference there, plus corrections at sites where both differ. Only those meet in a join, by site, and their sums are kept with the sequence by
profile. Costs then are sums of three numbers, taken for each sequence over arrays of profiles: no row for a pair is shuffled, and no site
is looked at for a pair where one of the two is equal to the reference.

`sites` is (seq, pos, ch) with a row for every site of a sequence, `profiles` (label, pos, ref) with a row for every site of a profile, `matrix`
(from_state, to_state, q) with a row per pair of states. A site where the sequence is unknown or ambiguous says nothing; a sequence
without a known site has no place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Profiles in one array.
BLOCK = 4_096
KNOWN = ("A", "C", "G", "T")


def _gains(matrix: DataFrame, step: float) -> DataFrame:
    """One row with a map from two states to the log-likelihood of a site that has them above and below the branch."""
    gain = F.when(F.col("from_state") == F.col("to_state"), F.col("q") * step).otherwise(F.log(F.col("q") * step))
    return matrix.agg(F.map_from_entries(F.collect_list(F.struct(F.concat("from_state", "to_state"), gain))).alias("gains"))


def _parts(sites: DataFrame, profiles: DataFrame, matrix: DataFrame, step: float) -> tuple[DataFrame, DataFrame]:
    """((seq, base, own), (block, labels)): sequences with their cost on the reference and the corrections `own` by label; arrays of (label, shift)."""
    gains = F.broadcast(_gains(matrix, step))  # one row, states x states numbers
    g = lambda a, b: F.element_at("gains", F.concat(a, b))
    ref = profiles.groupBy("pos").agg(F.mode("ref", True).alias("base_state"))
    off = profiles.join(ref, "pos").where("ref <> base_state").crossJoin(gains)
    shift = (g(F.col("ref"), F.col("base_state")) - g(F.col("base_state"), F.col("base_state"))).alias("shift")
    differ = off.select("label", "pos", "ref", "base_state", shift)
    cells = sites.select("seq", "pos", F.when(F.col("ch").isin(*KNOWN), F.col("ch")).alias("ch")).join(ref, "pos")
    base = cells.where("ch is not null").crossJoin(gains).groupBy("seq").agg(F.sum(g(F.col("base_state"), F.col("ch"))).alias("base"))
    # where both differ: what the pair costs there, less what was reckoned already; an unknown site costs nothing
    met = cells.where(~F.col("ch").eqNullSafe(F.col("base_state"))).select("seq", "pos", "ch").join(differ, "pos").crossJoin(gains)
    more = F.coalesce(g(F.col("ref"), F.col("ch")) - g(F.col("base_state"), F.col("ch")), F.lit(0.0)) - F.col("shift")
    sums = met.groupBy("seq", "label").agg(F.sum(more).alias("more"))
    own = sums.groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("label", "more"))).alias("own"))
    shifts = profiles.select("label").distinct().join(differ.groupBy("label").agg(F.sum("shift").alias("shift")), "label", "left").fillna(0.0, ["shift"])
    return base.join(own, "seq", "left"), _blocks(shifts)


def _blocks(shifts: DataFrame) -> DataFrame:
    """(block, labels): arrays of about BLOCK profiles."""
    n = shifts.count()
    number = F.pmod(F.xxhash64("label"), F.lit(-(-n // BLOCK) or 1)).alias("block")
    return shifts.groupBy(number).agg(F.sort_array(F.collect_list(F.struct("label", "shift"))).alias("labels"))


def _costs(sites: DataFrame, profiles: DataFrame, matrix: DataFrame, step: float) -> DataFrame:
    """(seq, block, costs): all sequences against all arrays of profiles, costs being an array of (label, lh)."""
    seqs, blocks = _parts(sites, profiles, matrix, step)
    cost = lambda x: F.struct(x["label"].alias("label"), (F.col("base") + x["shift"] + F.coalesce(F.element_at("own", x["label"]), F.lit(0.0))).alias("lh"))
    return seqs.crossJoin(blocks).select("seq", "block", F.transform("labels", cost).alias("costs"))  # every sequence is asked of every block


def placement_costs(sites: DataFrame, profiles: DataFrame, matrix: DataFrame, step: float) -> DataFrame:
    """(seq, label, lh): log-likelihood change of hanging each sequence on each profile by a branch of length `step`."""
    return _costs(sites, profiles, matrix, step).select("seq", F.inline("costs"))


def near_placements(sites: DataFrame, profiles: DataFrame, matrix: DataFrame, step: float, slack: float, digits: int = 6) -> DataFrame:
    """(seq, label, lh, best): the places whose log-likelihood, rounded to `digits`, is within `slack` of the best one. What is further off is dropped in
    the array it stands in, so only near places are shuffled."""
    rounded = F.transform("costs", lambda x: F.struct(x["label"].alias("label"), F.round(x["lh"], digits).alias("lh")))
    per = _costs(sites, profiles, matrix, step).select("seq", rounded.alias("costs"))
    top = F.array_max(F.transform("costs", lambda x: x["lh"]))
    near = per.withColumn("top", top).select("seq", F.inline(F.filter("costs", lambda x: x["lh"] >= F.col("top") - slack)))
    return near.withColumn("best", F.max("lh").over(Window.partitionBy("seq"))).where(F.col("lh") >= F.col("best") - slack)


def best_places(sites: DataFrame, profiles: DataFrame, matrix: DataFrame, step: float, digits: int = 6) -> DataFrame:
    """(seq, label, lh): the place of the largest log-likelihood, rounded to `digits`, the smallest label of equals."""
    least = lambda costs: F.array_min(F.transform(costs, lambda x: F.struct((-F.round(x["lh"], digits)).alias("cost"), x["label"].alias("label"))))
    per = _costs(sites, profiles, matrix, step).select("seq", least(F.col("costs")).alias("x"))
    return per.groupBy("seq").agg(F.min("x").alias("x")).select("seq", "x.label", (-F.col("x.cost")).alias("lh"))


def best_placement(costs: DataFrame, digits: int = 6) -> DataFrame:
    """(seq, label, lh) from costs of all places, the smallest label of equals."""
    best = F.min(F.struct((-F.round("lh", digits)).alias("cost"), "label")).alias("best")
    return costs.groupBy("seq").agg(best).select("seq", "best.label", (-F.col("best.cost")).alias("lh"))


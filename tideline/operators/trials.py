"""Trials of branch lengths: all trial lengths of all places at once, instead of one after the other."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trial_lengths(start: Column, factor: float, shortest: float, longest: float) -> Column:
    """An array of structs (k, length): start * factor**k from k = 0 on, as far as it stays above `shortest` and not beyond `longest`; the start
    itself is always there."""
    if factor <= 0 or factor == 1:
        raise ValueError(f"lengths do not change by a factor of {factor}")
    bound = shortest if factor < 1 else longest
    # one more than the logarithm says, since it is rounded; the filter decides
    most = F.when(start > 0, F.greatest(F.ceil(F.log(F.lit(float(bound)) / start) / math.log(factor)) + 1, F.lit(0))).otherwise(0).cast("int")
    every = F.transform(F.sequence(F.lit(0), most), lambda k: F.struct(k.alias("k"), (start * F.pow(F.lit(float(factor)), k)).alias("length")))
    return F.filter(every, lambda x: (x["k"] == 0) | ((x["length"] > shortest) & (x["length"] <= longest)))


def trial_costs(segments: DataFrame, key: list[str], trials: Column, cost: Callable[[Column], Column]) -> DataFrame:
    """(key, k, length, cost): the sum of `cost(length)` over the segments of a place, for every trial. Sums are partial before they are shuffled."""
    tried = segments.select("*", F.inline(trials)).select(*key, "k", "length", cost(F.col("length")).alias("cost"))
    return tried.groupBy(*key, "k").agg(F.first("length").alias("length"), F.sum("cost").alias("cost"))


def best_trial(costs: DataFrame, key: list[str]) -> DataFrame:
    """(key, k, length, cost): the last trial in a row in which each costs more than the one before; the first one that does not (or has no
    cost) ends it, also if a later one were better. Log-likelihoods are costs, so more is better."""
    order = Window.partitionBy(*key).orderBy("k")
    gain = F.lag("k").over(order).isNull() | F.coalesce(F.col("cost") > F.lag("cost").over(order), F.lit(False))
    ended = costs.withColumn("_gain", gain).withColumn("_all", F.min("_gain").over(order))
    last = ended.where("_all").groupBy(*key).agg(F.max(F.struct("k", "length", "cost")).alias("x"))
    return last.select(*key, "x.k", "x.length", "x.cost")

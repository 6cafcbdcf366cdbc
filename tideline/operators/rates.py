"""Substitution models from counts, with Spark aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Starting pseudo-counts of nucleotide transitions, rows and columns A, C, G, T.
DNA_SEED = ((0, 1, 5, 2), (2, 0, 1, 40), (5, 2, 0, 20), (2, 3, 1, 0))
STATES = "ACGT"


def root_frequencies(ref: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, state, freq): composition of the reference."""
    key = key or []
    counts = ref.groupBy(*key, F.col("ref").alias("state")).count()
    return counts.select(*key, "state", (F.col("count") / F.sum("count").over(Window.partitionBy(*key))).alias("freq"))


def equal_rates(spark: SparkSession, states: str = STATES) -> DataFrame:
    """(from_state, to_state, q): every change as likely, at a mean rate of 1, whatever the data."""
    return equal_rates_of(spark.createDataFrame([(s,) for s in states], "state string"))


def equal_rates_of(states: DataFrame) -> DataFrame:
    """The same for the states (state) that occur. A few rows: one for each state."""
    known = states.select("state").where("state is not null").distinct()
    n = known.agg(F.count(F.lit(1)).alias("n"))
    pairs = known.select(F.col("state").alias("from_state")).crossJoin(F.broadcast(known.select(F.col("state").alias("to_state")))).crossJoin(F.broadcast(n))  # states x states
    rate = F.when(F.col("from_state") == F.col("to_state"), F.when(F.col("n") > 1, -1.0).otherwise(0.0)).otherwise(F.try_divide(F.lit(1.0), F.col("n") - 1))
    return pairs.select("from_state", "to_state", rate.alias("q"))


def seed_counts(like: DataFrame) -> DataFrame:
    rows = [(STATES[i], STATES[j], float(DNA_SEED[i][j])) for i in range(4) for j in range(4) if i != j]
    return like.sparkSession.createDataFrame(rows, "from_state string, to_state string, n double")


def transition_counts(pairs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, from_state, to_state, n) of unequal neighbours."""
    return pairs.where("from_state <> to_state").groupBy(*(key or []), "from_state", "to_state").agg(F.count(F.lit(1)).cast("double").alias("n"))


def rate_matrix(counts: DataFrame, freqs: DataFrame, symmetric: bool = True) -> DataFrame:
    """(from_state, to_state, q): off-diagonal rates from counts, both ways together if `symmetric`; the diagonal makes row sums 0;
    scaled so that the mean rate at the frequencies is 1."""
    n = counts
    if symmetric:
        turned = counts.select(F.col("to_state").alias("from_state"), F.col("from_state").alias("to_state"), "n")
        n = counts.unionByName(turned)
    n = n.groupBy("from_state", "to_state").agg(F.sum("n").alias("n"))
    pi = F.broadcast(freqs.select(F.col("state").alias("from_state"), "freq"))  # one row per state
    rates = n.join(pi, "from_state").select("from_state", "to_state", "freq", (F.col("n") / F.col("freq")).alias("q"))
    diagonal = rates.groupBy("from_state", "freq").agg((-F.sum("q")).alias("q")).select("from_state", F.col("from_state").alias("to_state"), "freq", "q")
    every = rates.unionByName(diagonal)
    mean = -F.sum(F.when(F.col("from_state") == F.col("to_state"), F.col("freq") * F.col("q"))).over(Window.partitionBy())
    return every.select("from_state", "to_state", (F.col("q") / mean).alias("q"))


def exchange_matrix(exchange: DataFrame, freqs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, from_state, to_state, q): rates from exchangeabilities (key, from_state, to_state, s), each pair given once or both ways, times the
    frequency (key, state, freq) of the state that is changed to; row sums 0, mean rate 1. Keys are models: a few rows for each.
    """
    key = key or []
    turned = exchange.select(*key, F.col("to_state").alias("from_state"), F.col("from_state").alias("to_state"), "s")
    both = exchange.select(*key, "from_state", "to_state", "s").unionByName(turned).where("from_state <> to_state")
    both = both.groupBy(*key, "from_state", "to_state").agg(F.max("s").alias("s"))
    raw = both.join(freqs.select(*key, F.col("state").alias("to_state"), "freq"), [*key, "to_state"]).select(*key, "from_state", "to_state", (F.col("s") * F.col("freq")).alias("q"))
    diagonal = raw.groupBy(*key, "from_state").agg((-F.sum("q")).alias("q")).select(*key, "from_state", F.col("from_state").alias("to_state"), "q")
    mean = diagonal.join(freqs.select(*key, F.col("state").alias("from_state"), "freq"), [*key, "from_state"]).groupBy(*key).agg((-F.sum(F.col("q") * F.col("freq"))).alias("mean"))
    every = raw.unionByName(diagonal)
    scaled = every.join(mean, key) if key else every.crossJoin(F.broadcast(mean))  # one row
    return scaled.select(*key, "from_state", "to_state", (F.col("q") / F.col("mean")).alias("q"))


def key_matrices(counts: DataFrame, waits: DataFrame, key: str, pseudo: float = 0.1, low: float = 1e-3, high: float = 250.0) -> DataFrame:
    """(key, from_state, to_state, rate): a matrix for each key (a site, a user) from expected changes (key, from_state, to_state, c) and waiting
    times (key, from_state, wait), a share of their means over all keys added to both; clamped."""
    mean_wait = waits.groupBy("from_state").agg(F.avg("wait").alias("mean_wait"))
    mean_count = counts.groupBy("from_state", "to_state").agg(F.avg("c").alias("mean_c"))
    full = counts.join(waits, [key, "from_state"]).join(mean_wait, "from_state").join(mean_count, ["from_state", "to_state"])
    rate = (F.col("c") + pseudo * F.col("mean_c")) / (F.col("wait") + pseudo * F.col("mean_wait"))
    return full.select(key, "from_state", "to_state", F.least(F.greatest(rate, F.lit(low)), F.lit(high)).alias("rate"))


def site_matrices(sites: DataFrame, shared: DataFrame, own: DataFrame | None = None, rates: DataFrame | None = None) -> DataFrame:
    """(pos, q), q being an array of rows as `algebra.Model` takes it: the shared matrix (from_state, to_state, q) at every site (pos), replaced by the
    site's own (pos, from_state, to_state, q) where there is one, times the site's rate (pos, rate), 1 if not given. States are in order."""
    as_rows = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda r: r["row"])

    def folded(matrix: DataFrame, by: list[str]) -> DataFrame:
        lines = matrix.groupBy(*by, "from_state").agg(F.transform(F.array_sort(F.collect_list(F.struct("to_state", "q"))), lambda x: x["q"]).alias("row"))
        return lines.groupBy(*by).agg(as_rows(F.struct("from_state", "row")).alias("q"))

    every = sites.select("pos").crossJoin(F.broadcast(folded(shared, [])))  # one row, of states x states numbers
    if own is not None:
        every = every.join(folded(own, ["pos"]).withColumnRenamed("q", "own"), "pos", "left").select("pos", F.coalesce("own", "q").alias("q"))
    if rates is not None:
        rate = F.coalesce("rate", F.lit(1.0))
        every = every.join(rates.select("pos", "rate"), "pos", "left").select("pos", F.transform("q", lambda row: F.transform(row, lambda x: x * rate)).alias("q"))
    return every


def changed(old: DataFrame, new: DataFrame, limit: float = 1e-3) -> DataFrame:
    """(change, updated): sum of absolute differences off the diagonal, and whether it exceeds the limit."""
    both = old.where("from_state <> to_state").withColumnRenamed("q", "q0").join(new.where("from_state <> to_state"), ["from_state", "to_state"], "full")
    total = F.coalesce(F.sum(F.abs(F.coalesce("q", F.lit(0.0)) - F.coalesce("q0", F.lit(0.0)))), F.lit(0.0))
    return both.agg(total.alias("change")).withColumn("updated", F.col("change") > limit)


def site_rates(events: DataFrame, key: str, n: Column, exposure: Column, low: float = 1e-4, high: float = 100.0) -> DataFrame:
    """(key, rate): substitutions per exposure, 0.001 without any, 1 where hardly any is to be expected; divided by the mean, clamped."""
    per = events.groupBy(key).agg(F.sum(n).alias("n"), F.sum(exposure).alias("expected"))
    raw = F.when(F.col("n") == 0, 0.001).when(F.col("expected") <= 0.01, 1.0).otherwise(F.col("n") / F.col("expected"))
    scaled = per.select(key, raw.alias("raw"))
    mean = scaled.agg(F.avg("raw").alias("mean"))
    return scaled.crossJoin(F.broadcast(mean)).select(key, F.least(F.greatest(F.col("raw") / F.col("mean"), F.lit(low)), F.lit(high)).alias("rate"))


def supports(rows: DataFrame, key: list[str], score: str = "lh", slack: float | None = None) -> DataFrame:
    """Add support: softmax of log-likelihoods within a key, over alternatives within `slack` of the best."""
    w = Window.partitionBy(*key)
    best = F.max(score).over(w)
    near = rows.withColumn("_best", best)
    if slack is not None:
        near = near.where(F.col(score) >= F.col("_best") - slack)
    e = F.exp(F.col(score) - F.col("_best"))
    return near.withColumn("support", e / F.sum(e).over(w)).drop("_best")


def support_lines(rows: DataFrame, key: str, place: str, least: float = 0.01) -> DataFrame:
    """(key, line): the best place of each key with its support and the other places that have `least` support, as tab-separated text. `rows` is
    (key, place, lh, support)."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("lh"), place))
    ranked = rows.withColumn("nth", nth)
    label = F.format_string("in%s:%.5f", F.col(place).cast("string"), F.col("support"))
    others = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("nth") > 1) & (F.col("support") >= least), F.struct("nth", label.alias("text"))))), lambda x: x["text"]), ",")
    best = lambda c: F.max(F.when(F.col("nth") == 1, F.col(c)))
    per = ranked.groupBy(key).agg(best(place).alias("place"), best("support").alias("support"), others.alias("others"))
    return per.select(key, F.concat_ws("\t", F.concat(F.lit("s"), F.col(key).cast("string")), F.col("place").cast("string"), F.format_string("%.5f", "support"), "others").alias("line"))

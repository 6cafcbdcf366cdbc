"""Rows that say no more than another row: a containment join on differences from the reference.

A row is the list of its runs that differ from the reference, each with the set of states that are possible there (bits A=1, C=2, G=4, T=8; 15 is
unknown). Row `a` takes in row `b` if at every site what is possible in `a` is possible in `b`. So every run of `a` must lie inside
one of `b` that allows as much, and every run of `b` that rules the reference out must be one of `a`.

A possible host is listed once, under the rarest of its runs, and a row looks for hosts at its own runs: sites that all rows share are
nobody's rarest, unless a row has no others, so rows that meet grow with the rows and not with their square. Equal rows are one row here. A
host without any run is the reference itself and takes in all rows that rule it out nowhere: an aggregate finds those. Nothing is put
into one task but the runs of one row.

Tables whose rows grow with the sequences are joined by sorting both sides, whatever their files' sizes say: packed columns of a small file
may be many rows, which must not be sent to the driver and to all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import prefix_sums
from .trees import written

UNKNOWN = 15
#: Sites that one row of a long run is expanded to.
BLOCK = 256


def runs_of_rows(rows: DataFrame, diffs: DataFrame) -> DataFrame:
    """(aln, seq, runs): the differences (aln, seq, start, stop, bits, ref_bits) of all rows (aln, seq), neighbouring unknown runs put together.

    `runs` is an array of (start, stop, bits, hard) in order; a hard one rules the reference out."""
    order = Window.partitionBy("aln", "seq").orderBy("start")
    goes_on = (F.col("bits") == UNKNOWN) & (F.lag("bits").over(order) == UNKNOWN) & (F.lag("stop").over(order) == F.col("start") - 1)
    numbered = diffs.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    hard = (F.col("bits").bitwiseAND(F.col("ref_bits")) == 0).alias("hard")
    whole = numbered.groupBy("aln", "seq", "_run", "bits", hard).agg(F.min("start").cast("int").alias("start"), F.max("stop").cast("int").alias("stop"))
    per = whole.groupBy("aln", "seq").agg(F.sort_array(F.collect_list(F.struct("start", "stop", F.col("bits").cast("int").alias("bits"), "hard"))).alias("runs"))
    return rows.select("aln", "seq").distinct().join(per.hint("merge"), ["aln", "seq"], "left").select("aln", "seq", F.coalesce("runs", F.array().cast("array<struct<start:int,stop:int,bits:int,hard:boolean>>")).alias("runs"))


def _mask(runs: Column) -> Column:
    """A bit for each hard run, by a hash of its place."""
    bit = lambda r: F.expr("1L") * F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.hash(r["start"]), F.lit(64)).cast("int"))
    return F.aggregate(F.filter(runs, lambda r: r["hard"]), F.lit(0).cast("bigint"), lambda s, r: s.bitwiseOR(bit(r)))


def classes(rows: DataFrame) -> DataFrame:
    """(aln, row, runs, n_hard, mask) of distinct rows (aln, seq, runs): `row` is the smallest of equal ones."""
    one = rows.groupBy("aln", "runs").agg(F.min("seq").alias("row"))
    return one.select("aln", "row", "runs", F.size(F.filter("runs", lambda r: r["hard"])).alias("n_hard"), _mask(F.col("runs")).alias("mask"))


def hosts(distinct: DataFrame) -> DataFrame:
    """(aln, pos, bits, host, host_hard, host_mask): each row that has runs under the rarest of them: the one that fewest rows could hold."""
    items = distinct.where(F.size("runs") > 0).select("aln", "row", F.explode("runs").alias("r")).select("aln", "row", "r.*")
    unknown = items.where(F.col("bits") == UNKNOWN)
    # how many rows are unknown at a site: borders of runs, summed along the sites
    borders = unknown.select("aln", F.col("start").alias("pos"), F.lit(1).alias("d")).unionByName(unknown.select("aln", (F.col("stop") + 1).alias("pos"), F.lit(-1).alias("d")))
    ends = unknown.select("aln", F.col("start").alias("pos")).unionByName(unknown.select("aln", F.col("stop").alias("pos"))).distinct()
    change = borders.unionByName(ends.withColumn("d", F.lit(0))).groupBy("aln", "pos").agg(F.sum("d").alias("d"))
    covered = prefix_sums(change, ["aln"], "pos", {"n_unknown": F.col("d")}, 65_536)
    known = items.where(F.col("bits") != UNKNOWN).groupBy("aln", F.col("start").alias("pos"), "bits").agg(F.count(F.lit(1)).alias("n"))
    at = items.select("aln", "row", F.explode(F.array_distinct(F.array("start", F.when(F.col("bits") == UNKNOWN, F.col("stop")).otherwise(F.col("start"))))).alias("pos"), "bits")
    counted = at.join(known.hint("merge"), ["aln", "pos", "bits"], "left").join(covered.hint("merge"), ["aln", "pos"], "left")
    rarity = F.coalesce(F.col("n"), F.lit(0)) + F.coalesce("n_unknown", F.lit(0))
    best = counted.groupBy("aln", "row").agg(F.min(F.struct(rarity.alias("n"), "pos", "bits")).alias("x"))
    return best.select("aln", "row", "x.pos", "x.bits").join(distinct.select("aln", "row", "n_hard", "mask").hint("merge"), ["aln", "row"]).select("aln", "pos", "bits", F.col("row").alias("host"), F.col("n_hard").alias("host_hard"), F.col("mask").alias("host_mask"))


def candidates(distinct: DataFrame, listed: DataFrame) -> DataFrame:
    """(aln, row, host): pairs with a smaller host that agree at the host's rarest run, as far as counts and masks tell."""
    items = distinct.select("aln", "row", "n_hard", "mask", F.explode("runs").alias("r")).select("aln", "row", "n_hard", "mask", "r.start", "r.stop", "r.bits")
    single = items.where(F.col("start") == F.col("stop")).select("aln", F.col("start").alias("pos"), "row", "n_hard", "mask", F.col("bits").alias("own"))
    # a long run only looks at sites under which some host is listed
    sites = listed.select("aln", "pos").distinct().groupBy("aln", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.collect_list("pos").alias("listed"))
    blocks = items.where(F.col("start") < F.col("stop")).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(F.col("stop") / BLOCK))))
    inside = blocks.join(sites.hint("merge"), ["aln", "block"]).withColumn("pos", F.explode(F.filter("listed", lambda p: (p >= F.col("start")) & (p <= F.col("stop")))))
    asked = single.unionByName(inside.select("aln", "pos", "row", "n_hard", "mask", F.col("bits").alias("own")))
    met = asked.join(listed.hint("merge"), ["aln", "pos"]).where("host < row and n_hard <= host_hard")
    return met.where((F.col("bits").bitwiseAND(F.col("own")) == F.col("bits")) & (F.col("mask").bitwiseAND(F.col("host_mask")) == F.col("mask"))).select("aln", "row", "host")


def absorbed(rows: DataFrame, diffs: DataFrame) -> DataFrame:
    """(aln, seq, host): rows (aln, seq) that say no more than another one before them in their alignment, with the smallest such row.

    Of two equal rows the later one is taken in by the earlier. `diffs` is (aln, seq, start, stop, bits, ref_bits)."""
    packed = written(runs_of_rows(rows, diffs))
    distinct = written(classes(packed))
    listed = written(hosts(distinct))
    a, b = (distinct.select("aln", F.col("row").alias(k), F.col("runs").alias(f"{k}_runs")) for k in ("host", "row"))
    inside = lambda r: F.exists("row_runs", lambda t: (t["start"] <= r["start"]) & (t["stop"] >= r["stop"]) & (t["bits"].bitwiseAND(r["bits"]) == r["bits"]))
    met = lambda t: F.exists("host_runs", lambda r: r["start"] == t["start"])
    pairs = candidates(distinct, listed).join(a.hint("merge"), ["aln", "host"]).join(b.hint("merge"), ["aln", "row"])
    holds = pairs.where(F.forall("host_runs", inside) & F.forall(F.filter("row_runs", lambda t: t["hard"]), met))
    plain = distinct.where(F.size("runs") == 0).select("aln", F.col("row").alias("host"))
    of_plain = distinct.where((F.col("n_hard") == 0) & (F.size("runs") > 0)).select("aln", "row").join(F.broadcast(plain), "aln").where("host < row")  # one row for each alignment
    found = holds.select("aln", "row", "host").unionByName(of_plain).groupBy("aln", "row").agg(F.min("host").alias("best"))
    per = packed.join(distinct.select("aln", "runs", "row").hint("merge"), ["aln", "runs"]).join(found.hint("merge"), ["aln", "row"], "left")
    # an earlier equal row is a host as well; what takes that one in comes before both
    host = F.least(F.when(F.col("seq") > F.col("row"), F.col("row")), F.col("best"))
    return per.select("aln", "seq", host.alias("host")).where("host is not null")

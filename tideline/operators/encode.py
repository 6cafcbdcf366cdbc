"""Sequences as differences from one reference row.

`cells` has a row (aln, seq, pos, ch) for each site of each sequence; `aln` tells alignments apart. Nothing here needs a whole
sequence or a whole site in one task: counts are partial aggregates, and runs are found by windows over the
differences of a sequence only, which are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trees import counted, written


def consensus(cells: DataFrame, block: int = 65_536) -> DataFrame:
    """(aln, pos, ref): at each site, the first character other than a gap that reaches half of the rows, in row order; without
    one, the most frequent (the smallest of equals); at a site of gaps, A. An ambiguous character becomes A as well.

    Row order matters only where several characters reach half. There, rows are counted by block of `block` row numbers; running sums tell the
    block that the decisive row is in, and only rows of that block are ranked.
    """
    sizes = cells.groupBy("aln").agg(F.countDistinct("seq").alias("n"))
    # written, so that plans know how few rows of it there are, and tables of all cells are never what is sent to all tasks
    counts = cells.groupBy("aln", "pos", "ch").agg(F.count(F.lit(1)).alias("k")).join(sizes, "aln", "left")
    need = F.greatest(F.floor(F.col("n") / 2), F.lit(1))
    site = Window.partitionBy("aln", "pos")
    known = F.coalesce(F.col("ch") != "-", F.lit(False))
    counts = counts.withColumn("need", need).withColumn("reach", F.coalesce(known & (F.col("k") >= need), F.lit(False)).cast("int")).withColumn("rivals", F.sum("reach").over(site))
    counts, rivals = counted(counts, F.col("rivals") > 1)
    first = F.row_number().over(site.orderBy(F.desc("reach"), F.desc("k"), "ch"))
    clear = counts.where("rivals < 2").where(known).withColumn("place", first).where("place = 1").select("aln", "pos", "ch")
    sites = counts.select("aln", "pos").distinct()
    if not rivals:
        return _references(sites, clear)
    rival = counts.where("rivals > 1 and reach = 1").select("aln", "pos", "ch", "need")
    key = ["aln", "pos", "ch"]
    of_block = F.floor(F.col("seq") / block)
    sizes_of = cells.join(rival, key).groupBy(*key, "need", of_block.alias("block")).agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.partitionBy(*key).orderBy("block")) - F.col("k")
    decisive = written(sizes_of.withColumn("before", before).where("before < need and need <= before + k").select(*key, "block", (F.col("need") - F.col("before")).alias("left")))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("seq"))
    reached = cells.withColumn("block", of_block).join(decisive, [*key, "block"]).withColumn("nth", nth).where("nth = left")
    decided = reached.groupBy("aln", "pos").agg(F.min_by("ch", "seq").alias("ch"))
    return _references(sites, clear.unionByName(decided))


def _references(sites: DataFrame, winner: DataFrame) -> DataFrame:
    found = sites.join(winner, ["aln", "pos"], "left")
    return written(found.select("aln", "pos", F.when(F.col("ch").isin("A", "C", "G", "T"), F.col("ch")).otherwise("A").alias("ref")))


def differences(cells: DataFrame, ref: DataFrame) -> DataFrame:
    """(aln, seq, type, pos, len): sites that differ from the reference; neighbouring unknowns, and neighbouring gaps, are one run."""
    off = cells.join(ref, ["aln", "pos"]).where("ch <> ref").select("aln", "seq", "pos", F.col("ch").alias("type"))
    order = Window.partitionBy("aln", "seq", "type").orderBy("pos")
    run = F.when(F.col("type").isin("N", "-"), F.col("pos") - F.row_number().over(order)).otherwise(F.col("pos"))
    return off.withColumn("run", run).groupBy("aln", "seq", "type", "run").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).cast("int").alias("len")).drop("run")


def distances(cells: DataFrame, mut: DataFrame, block: int = 65_536) -> DataFrame:
    """(aln, seq, records, ambiguous, distance, ord): 1000 * records + ambiguous sites, and the stable order by it.

    Rows are counted by distance and by block of `block` numbers, and ranked inside those only, so no task orders a whole alignment.
    """
    per = mut.groupBy("aln", "seq").agg(F.count(F.lit(1)).alias("records"), F.sum(F.when(F.col("type").isin("A", "C", "G", "T"), 0).otherwise(F.col("len"))).alias("ambiguous"))
    every = cells.select("aln", "seq").distinct().join(per, ["aln", "seq"], "left").fillna(0, ["records", "ambiguous"])
    every = every.withColumn("distance", F.col("records") * 1000 + F.col("ambiguous"))
    every = every.withColumn("block", F.floor(F.col("seq") / block))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = every.groupBy("aln", "distance", "block").agg(F.count(F.lit(1)).alias("n"))
    nearer = blocks.groupBy("aln", "distance").agg(F.sum("n").alias("n")).select("aln", "distance", F.coalesce(F.sum("n").over(before("aln", "distance")), F.lit(0)).alias("nearer"))
    earlier = blocks.select("aln", "distance", "block", F.coalesce(F.sum("n").over(before("aln", "distance", "block")), F.lit(0)).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy("aln", "distance", "block").orderBy("seq"))
    ranked = every.withColumn("inside", inside).join(earlier, ["aln", "distance", "block"]).join(nearer, ["aln", "distance"])
    return ranked.select("aln", "seq", "records", "ambiguous", "distance", (F.col("nearer") + F.col("earlier") + F.col("inside")).alias("ord"))


def effectiveness(mut: DataFrame, sizes: DataFrame, max_share: float = 0.067, mean_share: float = 0.02, least: int = 3) -> DataFrame:
    """(aln, n, most, total, effective): are all rows, and rows on average, close enough to the reference? `sizes` is (aln, n, length).

    Fewer than `least` rows, an empty reference, or a limit for one row below that for the mean are errors."""
    if max_share < mean_share:
        raise ValueError(f"the limit of a row, {max_share}, is below the limit of the mean, {mean_share}")
    if (bad := sizes.where((F.col("n") < least) | (F.coalesce("length", F.lit(0)) < 1)).first()) is not None:
        raise ValueError(f"alignment {bad.aln} has {bad.n} rows and {bad.length} sites; {least} rows and one site are needed")
    per = mut.groupBy("aln", "seq").count().groupBy("aln").agg(F.max("count").alias("most"), F.sum("count").alias("total"))
    out = sizes.join(per, "aln", "left").fillna(0, ["most", "total"])
    ok = (F.col("most") <= F.col("length") * max_share) & (F.col("total") <= F.col("length") * mean_share * F.col("n"))
    return out.select("aln", "n", "most", "total", ok.alias("effective"))


def reconstruct(mut: DataFrame, ref: DataFrame, rows: DataFrame, most: int = 32 << 20) -> DataFrame:
    """(aln, seq, text): full sequences from differences, which are spliced into the text of the reference.

    The reference is sent to all tasks if it has at most `most` sites over all alignments; beyond that, sites are laid out for each sequence and
    joined by alignment, sequence and position."""
    if ref.count() > most:
        return _reconstruct_by_site(mut, ref, rows)
    whole = ref.groupBy("aln").agg(F.array_sort(F.collect_list(F.struct("pos", "ref"))).alias("sites"))
    whole = whole.select("aln", F.array_join(F.transform("sites", lambda x: x["ref"]), "").alias("whole"))
    runs = mut.groupBy("aln", "seq").agg(F.array_sort(F.collect_list(F.struct("pos", "len", "type"))).alias("runs"))
    none = F.array().cast(runs.schema["runs"].dataType)
    both = rows.join(runs, ["aln", "seq"], "left").withColumn("runs", F.coalesce("runs", none)).join(F.broadcast(whole), "aln")

    def stop(i: Column) -> Column:
        """Where the run before the i-th stops, or the sequence starts."""
        before = F.get("runs", i - 1)
        return F.coalesce(before["pos"] + before["len"], F.lit(0))

    parts = F.transform("runs", lambda x, i: F.concat(F.substr("whole", stop(i) + 1, x["pos"] - stop(i)), F.repeat(x["type"], x["len"])))
    tail = F.substr("whole", stop(F.size("runs")) + 1)
    return both.select("aln", "seq", F.concat(F.array_join(parts, ""), tail).alias("text"))


def _reconstruct_by_site(mut: DataFrame, ref: DataFrame, rows: DataFrame) -> DataFrame:
    over = mut.select("aln", "seq", F.col("type").alias("ch"), F.explode(F.sequence("pos", F.col("pos") + F.col("len") - 1)).alias("pos"))
    base = rows.join(ref, "aln").select("aln", "seq", "pos", "ref")
    sites = base.join(over, ["aln", "seq", "pos"], "left").select("aln", "seq", "pos", F.coalesce("ch", "ref").alias("ch"))
    parts = sites.groupBy("aln", "seq").agg(F.array_sort(F.collect_list(F.struct("pos", "ch"))).alias("parts"))
    return parts.select("aln", "seq", F.array_join(F.transform("parts", lambda x: x["ch"]), "").alias("text"))


def delta_lines(mut: DataFrame, strict_reference: bool = True) -> DataFrame:
    """(aln, seq, lines): the records of a sequence as text, 1-based, length for runs only. With `strict_reference` unknown sites
    are written as '-' too."""
    ch = F.when(F.col("type").isin("N", "-"), "-").otherwise(F.lower("type")) if strict_reference else F.lower("type")
    line = F.concat_ws("\t", ch, (F.col("pos") + 1).cast("string"), F.when(F.col("type").isin("N", "-"), F.col("len").cast("string")))
    per = mut.groupBy("aln", "seq").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("parts"))
    return per.select("aln", "seq", F.array_join(F.transform("parts", lambda x: x["line"]), "\n").alias("lines"))


def regions(mut: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """(aln, seq, start, stop, type): runs that cover the whole length; R is a run equal to the reference, N unknown or gap, O ambiguous
    (its character stays in `ch`)."""
    order = Window.partitionBy("aln", "seq").orderBy("pos")
    kind = F.when(F.col("type").isin("A", "C", "G", "T"), F.col("type")).when(F.col("type").isin("N", "-"), "N").otherwise("O")
    own = mut.withColumn("stop", F.col("pos") + F.col("len") - 1).withColumn("before", F.coalesce(F.lag("stop").over(order), F.lit(-1)))
    runs = own.select("aln", "seq", F.col("pos").alias("start"), "stop", kind.alias("type"), F.col("type").alias("ch"))
    gaps = own.where("pos > before + 1").select("aln", "seq", (F.col("before") + 1).alias("start"), (F.col("pos") - 1).alias("stop"), F.lit("R").alias("type"), F.lit("R").alias("ch"))
    last = own.groupBy("aln", "seq").agg(F.max("stop").alias("last"))
    tail = rows.join(last, ["aln", "seq"], "left").fillna(-1, ["last"]).where(F.col("last") < length - 1)
    tail = tail.select("aln", "seq", (F.col("last") + 1).cast("int").alias("start"), F.lit(length - 1).alias("stop"), F.lit("R").alias("type"), F.lit("R").alias("ch"))
    return runs.unionByName(gaps).unionByName(tail)


def padded_rows(texts: DataFrame) -> DataFrame:
    """(aln, seq, line): names padded to one more than the longest (10 at least), then the sequence. `texts` is (aln, seq, name, text)."""
    width = texts.groupBy("aln").agg((F.greatest(F.max(F.length("name")), F.lit(9)) + 1).alias("width"))
    return texts.join(width, "aln").select("aln", "seq", F.concat(F.rpad("name", F.col("width"), F.lit(" ")), "text").alias("line"))

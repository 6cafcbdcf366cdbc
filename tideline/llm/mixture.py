"""Mixing sources to target weights, with DataFrame operations only.

The words of a source are laid end to end and packed into blocks of `block_words` (the last one may be
shorter). A target says how many words the mix takes from each source, hence how many blocks, its slots. The mix is cut
into shards of `shard_slots` slots, and every slot of a shard draws its source, so the source counts of a shard are a
multinomial draw with the targets as weights. Over all shards such draws miss the targets by chance: the slots that a source has drawn
beyond its number go to the sources that have drawn too few, in pseudorandom order, and then every target is met. The j-th slot of a
source takes block `permutation(j mod n_blocks)` of that source, so a block is taken again only when all others have been
taken as often. Slots and blocks meet in one equi-join on (source, block).

Nothing is collected. Equal rows are counted first and laid end to end. Word offsets come from two-level running sums: distinct
documents fall into buckets of a source by a hash of id and text (so a source with a third of all rows is spread over many tasks), buckets
are summed, and only the bucket sums are ordered; the places of a shard's slots in their source likewise. All draws and places are functions of
the data and `seed`, never of how files are split, so reruns and retried tasks agree.

Defined results: null or wordless texts have size 0 and are taken 0 times; a null source is a source of its own,
last in order; repeated rows, null ids and rows of one id are documents of their own; without words every target is 0; columns other
than doc_id, source and text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, shuffle_width

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, and how often a source may be repeated.
SHARE, MOST = 1.5, 2.0
BLOCK_WORDS = 128
#: Documents of a source that one bucket of the running sums holds, about.
BUCKET_DOCS = 4096
#: Slots that one row is expanded to; slots of a shard; shards that are added up together; parts that intervals are looked up in.
SLOT_RUN, SHARD_SLOTS, SHARD_RUN, PARTS = 4096, 8192, 4096, 1024
_ROUNDS = 4


def word_count(text: str | Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add weight and target to one row per source (source, source_size).

    Sources share `share` of all words by weight; a target stops at `most` times its source, and the excess goes to
    the others by weight until none is above. The fixed point is a water level: sources whose cap per weight is
    below the level are full, all others get level * weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rank = (F.row_number().over(order) - 1) % len(weights)
    out = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank + 1))
    out = out.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    out = out.withColumn("total", F.sum("source_size").over(everything) * share)
    out = out.withColumn("full_caps", F.sum("cap").over(by_ratio)).withColumn("rest", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio))
    out = out.withColumn("is_full", F.col("full_caps") + F.col("ratio") * F.col("rest") <= F.col("total"))
    full = lambda c: F.sum(F.when(F.col("is_full"), F.col(c)).otherwise(0.0)).over(everything)
    out = out.withColumn("level", (F.col("total") - full("cap")) / (F.sum("weight").over(everything) - full("weight")))
    return out.withColumn("target", F.when(F.col("is_full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))).select("source", "source_size", "weight", "target")


def permuted(index: Column, size: Column, *keys: Column) -> Column:
    """A pseudorandom permutation of [0, size) at `index`: a balanced Feistel network on the smallest even number of bits that
    holds `size`, walked until the value falls inside. A walk from inside returns inside after under 4 steps on average."""
    half = F.greatest(F.ceil(F.ceil(F.log2(F.greatest(size, F.lit(2)).cast("double"))) / 2), F.lit(1)).cast("int")
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), half) - 1

    def once(x: Column) -> Column:
        def turn(acc: Column, r: Column) -> Column:
            return F.struct(acc["b"].alias("a"), acc["a"].bitwiseXOR(F.xxhash64(acc["b"], r, *keys).bitwiseAND(low)).alias("b"))

        start = F.struct(F.call_function("shiftright", x, half).alias("a"), x.bitwiseAND(low).alias("b"))
        return F.aggregate(F.array(*[F.lit(i) for i in range(_ROUNDS)]), start, turn, lambda s: F.call_function("shiftleft", s["a"], half).bitwiseOR(s["b"]))

    def walk(x: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda acc, _: F.when(acc < size, acc).otherwise(once(acc)))

    # nearly all walks end in the first 12 steps; that one is longer than all 268 has a chance below 0.75 ** 268
    short = F.transform(F.array(walk(once(index), 12)), lambda x: F.when(x < size, x).otherwise(walk(x, 256)))
    return F.element_at(short, 1)


def word_offsets(docs: DataFrame) -> DataFrame:
    """Add `begin`, the words of the same source before this row, to distinct rows (doc_id, source, size, h, g, copies, part); a row stands for
    `copies` equal ones."""
    docs = docs.withColumn("_all", F.col("size") * F.col("copies"))
    buckets = docs.groupBy("source", "part").agg(F.sum("_all").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(F.col("source").alias("b_source"), F.col("part").alias("b_part"), F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_begin"))
    inside = Window.partitionBy("source", "part").orderBy("doc_id", "h", "g", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = docs.withColumn("local_begin", F.coalesce(F.sum("_all").over(inside), F.lit(0)))
    both = local.join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("part") == F.col("b_part")))
    return both.withColumn("begin", F.col("bucket_begin") + F.col("local_begin")).drop("_all", "local_begin", "bucket_begin", "b_source", "b_part")


def copied(placed: DataFrame) -> DataFrame:
    """Rows with `begin` and `copies` as that many rows, one behind the other. Many copies are expanded in runs, by several tasks."""
    one = placed.where(F.col("copies") <= SLOT_RUN).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    runs = placed.where(F.col("copies") > SLOT_RUN).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / SLOT_RUN))))
    runs = runs.repartition(shuffle_width(placed.sparkSession), "h", "_run")
    many = runs.withColumn("_copy", F.explode(F.sequence(F.col("_run") * SLOT_RUN, F.least(F.col("copies"), (F.col("_run") + 1) * SLOT_RUN) - 1))).drop("_run")
    return one.unionByName(many).withColumn("begin", F.col("begin") + F.col("_copy") * F.col("size")).drop("_copy", "copies")


def pack(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each part of a document inside a block: row_id, source, block, words."""
    last = F.floor((F.col("begin") + F.col("size") - 1) / block_words)
    first = F.floor(F.col("begin") / block_words)
    parts = placed.where("size > 0").select("row_id", "source", "begin", "size", F.explode(F.sequence(first, last)).alias("block"))
    upper = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block_words)
    return parts.select("row_id", "source", "block", (upper - F.greatest("begin", F.col("block") * block_words)).alias("words"))


def _inside(points: DataFrame, at: str, intervals: DataFrame, whole: str) -> DataFrame:
    """Points joined with the one interval [begin, stop) of [0, whole) that holds `at`. Both meet by part of the range, so it is an
    equi-join however many intervals there are; every point has a column `whole`."""
    width = lambda c: F.greatest(F.ceil(F.col(c) / PARTS), F.lit(1)).cast("bigint")
    spread = intervals.where("stop > begin").withColumn("_part", F.explode(F.sequence(F.floor(F.col("begin") / width(whole)), F.floor((F.col("stop") - 1) / width(whole))))).drop(whole)
    found = points.withColumn("_part", F.floor(F.col(at) / width(whole))).join(spread, "_part")
    return found.where((F.col(at) >= F.col("begin")) & (F.col(at) < F.col("stop"))).drop("_part", "begin", "stop")


def _laid_out(rows: DataFrame, size: str) -> DataFrame:
    """Sources with the interval [begin, stop) that each has when sizes are laid end to end, and their sum `whole`: a row per source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("stop", F.sum(size).over(order)).withColumn("begin", F.col("stop") - F.col(size)).withColumn("whole", F.sum(size).over(Window.partitionBy()))


def draws(wanted: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(sources, drawn): rows (source, n_blocks, n_slots, begin, stop, whole), and a row (place, shard, source, n_blocks, n_slots) for each slot of
    the mix with the source that it has drawn, from rows (source, source_size, target)."""
    n_blocks = F.ceil(F.col("source_size") / block_words).cast("bigint")
    # as many blocks as come nearest to the target, counted in words of a mean block
    count = F.least(F.round(F.col("target") / F.col("source_size") * n_blocks), 2 * n_blocks).cast("bigint")
    per = wanted.where("source_size > 0").select("source", n_blocks.alias("n_blocks"), count.alias("n_slots")).where("n_slots > 0")
    sources = checkpoint(_laid_out(per, "n_slots"))
    whole = sources.agg(F.max("whole").alias("whole")).where("whole > 0")
    runs = whole.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("whole") - 1) / SLOT_RUN))))
    # a fixed number of partitions: these few rows grow to all slots, which their size does not show
    runs = runs.repartition(shuffle_width(wanted.sparkSession), "run")
    each = runs.select("whole", F.explode(F.sequence(F.col("run") * SLOT_RUN, F.least(F.col("whole"), (F.col("run") + 1) * SLOT_RUN) - 1)).alias("place"))
    each = each.withColumn("shard", F.floor(F.col("place") / shard_slots)).withColumn("u", F.pmod(F.xxhash64("place", F.lit(seed)), F.col("whole")))
    return sources, _inside(each, "u", sources, "whole").select("place", "shard", "source", "n_blocks", "n_slots")


def slots(wanted: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(source, shard, slot, block) of the whole mix, from rows of (source, source_size, target)."""
    sources, drawn = draws(wanted, seed, block_words, shard_slots)
    drawn = checkpoint(drawn)
    counts = drawn.groupBy("shard", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.floor(F.col("shard") / SHARD_RUN))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("source", "run").agg(F.sum("n").alias("run_n"))
    runs = runs.select(F.col("source").alias("run_source"), F.col("run").alias("run_number"), F.coalesce(F.sum("run_n").over(before("source").orderBy("run")), F.lit(0)).alias("run_first"))
    first = counts.join(runs, counts["source"].eqNullSafe(runs["run_source"]) & (counts["run"] == runs["run_number"]))
    first = first.withColumn("first", F.col("run_first") + F.coalesce(F.sum("n").over(before("source", "run").orderBy("shard")), F.lit(0)))
    first = first.select(F.col("source").alias("in_source"), F.col("shard").alias("in_shard"), "first")
    numbered = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "source").orderBy("place")) - 1)
    numbered = numbered.join(first, numbered["source"].eqNullSafe(first["in_source"]) & (numbered["shard"] == first["in_shard"]))
    numbered = numbered.select("place", "shard", "source", "n_blocks", "n_slots", (F.col("first") + F.col("nth")).alias("j"))

    # what a source has drawn beyond its number goes to those that have drawn too few
    totals = counts.groupBy("source").agg(F.sum("n").alias("drawn")).withColumnRenamed("source", "d_source")
    balance = sources.drop("begin", "stop", "whole").join(totals, F.col("source").eqNullSafe(F.col("d_source")), "left").drop("d_source").fillna(0, ["drawn"])
    balance = checkpoint(balance)
    lacking = _laid_out(balance.select("source", "n_blocks", "drawn", F.greatest(F.col("n_slots") - F.col("drawn"), F.lit(0)).alias("lack")), "lack")
    beyond = _laid_out(balance.select("source", F.greatest(F.col("drawn") - F.col("n_slots"), F.lit(0)).alias("over")), "over")
    beyond = beyond.select(F.col("source").alias("b_source"), F.col("begin").alias("b_begin"), F.col("whole").alias("b_whole")).where("b_whole > 0")
    excess = numbered.where("j >= n_slots")
    excess = excess.join(beyond, excess["source"].eqNullSafe(beyond["b_source"])).select("place", "shard", (F.col("b_begin") + F.col("j") - F.col("n_slots")).alias("number"), F.col("b_whole").alias("all"))
    excess = excess.select("place", "shard", F.col("all").alias("whole"), permuted(F.col("number"), F.col("all"), F.lit(seed + 2)).alias("u"))
    # begin is where the source's part of all missing slots begins
    given = _inside(excess, "u", lacking.withColumn("low", F.col("begin")), "whole").select("place", "shard", "source", "n_blocks", (F.col("drawn") + F.col("u") - F.col("low")).alias("j"))
    met = numbered.where("j < n_slots").select("place", "shard", "source", "n_blocks", "j").unionByName(given)
    block = permuted(F.col("j") % F.col("n_blocks"), F.col("n_blocks"), F.lit(seed + 1), F.coalesce(F.col("source"), F.lit("")))
    return met.select("source", "shard", (F.col("place") % shard_slots).alias("slot"), block.alias("block"))


def mix_sources(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """Mix all documents (doc_id, source, text): (documents with size, source_size and target; the mix).

    The mix has a row (source, shard, slot, block, row_id, words) for each part of a document in each block it takes;
    `row_id` belongs to the row of documents. Write `slots` joined with `pack` to lay the mix out.
    """
    base = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    base = checkpoint(base.groupBy("doc_id", "source", "size", "h", "g").agg(F.count(F.lit(1)).alias("copies")))
    sizes = base.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    wanted = checkpoint(targets(sizes, weights, share, most).join(sizes.select(F.col("source").alias("s"), "n_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    known = base.join(wanted, base["source"].eqNullSafe(wanted["source"])).drop(wanted["source"])
    known = known.withColumn("part", F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), F.ceil(F.col("n_docs") / BUCKET_DOCS)))
    rows = copied(word_offsets(known.select("doc_id", "source", "size", "h", "g", "copies", "source_size", "target", "part")))
    # numbers of rows as they are written; places do not depend on them
    rows = checkpoint(rows.select("doc_id", "source", "size", "begin", "source_size", "target").withColumn("row_id", F.monotonically_increasing_id()))
    parts = pack(rows, block_words)
    taken = slots(wanted, seed, block_words)
    both = taken.hint("merge").join(parts, taken["source"].eqNullSafe(parts["source"]) & (taken["block"] == parts["block"])).select(taken["source"], "shard", "slot", taken["block"], "row_id", "words")
    return rows.select("row_id", "doc_id", "size", "source", "source_size", "target"), both


def mixture_report(docs: DataFrame, **options: object) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source) and taken, the words the mix takes of it."""
    known, mix = mix_sources(docs, **options)
    taken = mix.groupBy("row_id").agg(F.sum("words").alias("taken"))
    return known.join(taken, "row_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

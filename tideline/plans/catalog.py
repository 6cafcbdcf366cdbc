"""Queries over the standard tables: every set-oriented operator applied to characters derived from them.

`embeddings` gives aligned sequences (a character per component), `events` gives transitions with waiting times, and the
star schema gives trees. Doubles are rounded last, so results can be compared between engines.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import states
from ..operators import absorption, algebra, branch_tests, encode, passes, placement, rates, segments, site_models, trees, trials
from ..sources import trees as tree_text
from ..streaming import incremental

LENGTH = 64
#: A default branch length: one change per sequence.
STEP = 1.0 / LENGTH


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str, by_label: bool = False) -> DataFrame:
    """(aln, seq, pos, ch): one character for each component of each embedding; alignments are all rows, or labels."""
    return _characters(table(spark, sf_dir, "embeddings"), by_label)


def _characters(vectors: DataFrame, by_label: bool = False) -> DataFrame:
    wide = vectors.select((F.col("label") if by_label else F.lit(0)).alias("aln"), F.col("vec_id").alias("seq"), F.posexplode("embedding").alias("pos", "x"))
    x, letter = F.col("x").cast("double"), lambda k: F.substring(F.lit("ACGT"), (F.col("pos") + k) % 4 + 1, F.lit(1))
    ch = F.when(F.abs(x) < 0.002, "N").when(F.abs(x) < 0.004, "-").when(x < -0.26, letter(1)).when(x > 0.26, letter(2)).when(x > 0.24, letter(3)).otherwise(letter(0))
    return wide.select("aln", "seq", "pos", ch.alias("ch"))


def _rows(sites: DataFrame) -> DataFrame:
    return sites.select("aln", "seq").distinct()


def _mut(sites: DataFrame, ref: DataFrame | None = None) -> DataFrame:
    return encode.differences(sites, encode.consensus(sites) if ref is None else ref)


def q01_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.consensus(cells(spark, sf_dir, True))


def q02_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mut(cells(spark, sf_dir)).select("seq", "type", "pos", "len")


def q03_distance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = cells(spark, sf_dir)
    return encode.distances(sites, _mut(sites)).select("seq", "records", "ambiguous", "distance", "ord")


def q04_effectiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = cells(spark, sf_dir, True)
    sizes = sites.groupBy("aln").agg(F.countDistinct("seq").alias("n"), (F.max("pos") + 1).alias("length"))
    return encode.effectiveness(_mut(sites), sizes, 0.14, 0.075)


def q05_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = cells(spark, sf_dir)
    ref = trees.written(encode.consensus(sites))
    return encode.reconstruct(encode.differences(sites, ref), ref, _rows(sites)).select("seq", "text")


def q06_delta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.delta_lines(_mut(cells(spark, sf_dir))).select("seq", "lines")


def q07_padded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = q05_reconstruct(spark, sf_dir).select(F.lit(0).alias("aln"), "seq", F.concat(F.lit("seq_"), F.col("seq").cast("string")).alias("name"), "text")
    return encode.padded_rows(named).select("seq", "line")


def q08_sequence_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", states.sequence_type(F.col("p_name")).alias("by_name"), states.sequence_type(F.translate("p_brand", "Brand#12345", "ACGTACGTACG")).alias("by_brand"))


def q09_clean_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", states.clean_body(F.regexp_replace("url", "[:/]", " ")).alias("url_body"), states.clean_body(F.col("html")).alias("html_body"))


def q10_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = cells(spark, sf_dir)
    return encode.regions(_mut(sites), _rows(sites), LENGTH).select("seq", "start", "stop", "type")


def q11_state_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of parts' names and kinds that stand for a nucleotide or an unknown site: how often, their codes, and what is possible there."""
    text = table(spark, sf_dir, "part").select(F.explode(F.split(F.upper(F.concat_ws("", "p_name", "p_brand", "p_type")), "")).alias("ch"))
    letters = text.where("ch between 'A' and 'Z'").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    code = states.state_code(F.col("ch"))
    vector = F.array_join(F.transform(states.ambiguity_vector(F.col("code")), lambda x: F.format_string("%.4f", x)), ",")
    return letters.withColumn("code", code).where("code is not null").select("ch", "n", "code", states.state_char(F.col("code")).alias("back"), F.coalesce(vector, F.lit("")).alias("vector"))


def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = cells(spark, sf_dir)
    runs = encode.regions(_mut(sites), _rows(sites), LENGTH).select("seq", "start", "stop", "type")
    last = runs.agg(F.max("seq").alias("top"))
    left = runs.join(F.broadcast(last), F.col("seq") < F.col("top")).drop("top")  # one row
    return segments.overlay(left, runs.where("seq > 0").withColumn("seq", F.col("seq") - 1), ["seq"])


def q12_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlay(spark, sf_dir)


def q12_shared_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlay(spark, sf_dir).groupBy("seq").agg((F.count(F.lit(1)) + 1).alias("n_segments"))


def _bits(ch: str, ref: Column | None = None) -> Column:
    known = F.create_map(*[x for c, b in (("A", 1), ("C", 2), ("G", 4), ("T", 8), ("N", 15)) for x in (F.lit(c), F.lit(b))])
    col = F.when(F.col(ch) == "R", ref).otherwise(F.col(ch)) if ref is not None else F.col(ch)
    return F.element_at(known, col)


def q13_informativeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    # equal types say the same whatever the reference is; R against a letter always contradicts
    seg = _overlay(spark, sf_dir)
    as_bits = lambda c: F.coalesce(_bits(c), F.lit(16))
    unknown = lambda c, d: F.when(F.col(c) == "N", as_bits(d).bitwiseOR(32)).otherwise(as_bits(c))
    return segments.informativeness(seg.select("seq", unknown("a", "b").alias("a"), unknown("b", "a").alias("b")), ["seq"])


def q14_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlay(spark, sf_dir).groupBy("seq").agg(F.bool_or(F.col("a") != F.col("b")).alias("differs"))


def q15_coalesced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    one = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    return segments.coalesce_runs(one, ["l_orderkey"], "l_linenumber", "l_returnflag").select("l_orderkey", F.col("run").cast("long").alias("run"), "l_returnflag", "first", "last", "n")


def _matrix(spark: SparkSession, sf_dir: str, symmetric: bool = True, part: Column | None = None, ref: DataFrame | None = None) -> DataFrame:
    counts = _counts(spark, sf_dir, part).groupBy("from_state", "to_state").agg(F.sum("n").alias("n"))
    return rates.rate_matrix(counts, rates.root_frequencies(encode.consensus(cells(spark, sf_dir)) if ref is None else ref), symmetric)


def _counts(spark: SparkSession, sf_dir: str, part: Column | None = None) -> DataFrame:
    sites = cells(spark, sf_dir, True)
    pairs = sites.join(encode.consensus(sites), ["aln", "pos"]).where(F.col("ch").isin("A", "C", "G", "T"))
    if part is not None:
        pairs = pairs.where(part)
    counts = rates.transition_counts(pairs.select(F.col("ref").alias("from_state"), F.col("ch").alias("to_state")))
    return counts.unionByName(rates.seed_counts(sites))


def _diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir).where("from_state = to_state").select(F.col("from_state").alias("ref"), "q")


def q16_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = encode.consensus(cells(spark, sf_dir)).join(_diagonal(spark, sf_dir), "ref")
    values = {"rate": F.col("q")} | {f"n_{s}": (F.col("ref") == s).cast("long") for s in "ACGT"}
    return segments.prefix_sums(ref, [], "pos", values, block=16).select("pos", F.round("rate", 6).alias("rate"), *[f"n_{s}" for s in "ACGT"])


def q17_root_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.root_frequencies(encode.consensus(cells(spark, sf_dir, True)), ["aln"]).select("aln", "state", F.round("freq", 6).alias("freq"))


def q18_transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).groupBy("from_state", "to_state").agg(F.sum("n").alias("n"))


def q19_rate_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [_matrix(spark, sf_dir, s).select(F.lit(name).alias("model"), "from_state", "to_state", F.round("q", 6).alias("q")) for name, s in (("GTR", True), ("UNREST", False))]
    return both[0].unionByName(both[1])


def q20_matrix_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (_matrix(spark, sf_dir, False, F.col("seq") % 2 == k) for k in (0, 1))
    return rates.changed(old, new).select(F.round("change", 6).alias("change"), "updated")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    nexts = events.select("user_id", F.col("event_type").alias("from_type"), F.lead("event_type").over(order).alias("to_type"), (F.unix_micros(F.lead("ts").over(order)) - F.unix_micros("ts")).alias("wait_us"))
    return nexts.where("to_type is not null")


def q21_key_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rates.site_rates(_steps(spark, sf_dir), "from_type", (F.col("from_type") != F.col("to_type")).cast("long"), F.col("wait_us") / 86_400e6)
    return found.select("from_type", F.round("rate", 6).alias("rate"))


def q22_count_matrices(spark: SparkSession, sf_dir: str, pseudo: float = 0.1) -> DataFrame:
    """Per user: transition counts with a share of the overall rate added to counts and waiting times, and their quotient."""
    steps = _steps(spark, sf_dir)
    steps = steps.select("user_id", F.col("from_type").alias("from_state"), F.col("to_type").alias("to_state"), "wait_us")
    waits = steps.groupBy("user_id", "from_state").agg((F.sum("wait_us") / 86_400e6).alias("wait"))
    counts = steps.where("from_state <> to_state").groupBy("user_id", "from_state", "to_state").agg(F.count(F.lit(1)).alias("c"))
    found = rates.key_matrices(counts, waits, "user_id", pseudo)
    return found.select("user_id", F.col("from_state").alias("from_type"), F.col("to_state").alias("to_type"), F.round("rate", 6).alias("rate"))


def q23_root_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of each sequence at the root: runs equal to the reference by prefix counts, others by their state."""
    sites = cells(spark, sf_dir)
    ref = encode.consensus(sites)
    log_pi = rates.root_frequencies(ref).select(F.col("state"), F.log("freq").alias("log_pi"))
    runs = encode.regions(encode.differences(sites, ref), _rows(sites), LENGTH).select("seq", "start", "stop", "type")
    sums = segments.prefix_sums(ref.join(log_pi, F.col("ref") == F.col("state")), [], "pos", {"total": F.col("log_pi")}, block=16)
    equal = runs.where("type = 'R'").join(sums.select(F.col("pos").alias("stop"), F.col("total").alias("upper")), "stop")
    equal = equal.join(sums.select((F.col("pos") + 1).alias("start"), F.col("total").alias("lower")), "start", "left").select("seq", (F.col("upper") - F.coalesce("lower", F.lit(0.0))).alias("lh"))
    single = runs.join(log_pi, F.col("type") == F.col("state")).select("seq", F.col("log_pi").alias("lh"))
    total = equal.unionByName(single).groupBy("seq").agg(F.round(F.sum("lh"), 6).alias("lh"))
    return total


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, label, lh): log-likelihood change of hanging each sequence on each label's consensus by a branch of length STEP."""
    return placement.placement_costs(cells(spark, sf_dir), _profiles(spark, sf_dir), _matrix(spark, sf_dir), STEP)


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.consensus(cells(spark, sf_dir, True)).select(F.col("aln").alias("label"), "pos", "ref")


def q24_placement_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(spark, sf_dir).select("seq", "label", F.round("lh", 6).alias("lh"))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.near_placements(cells(spark, sf_dir), _profiles(spark, sf_dir), _matrix(spark, sf_dir), STEP, round(math.log(LENGTH), 6))


def q25_best_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select("seq", "label", "lh", F.row_number().over(Window.partitionBy("seq").orderBy(F.desc("lh"), "label")).alias("place"))


def q26_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.supports(_near(spark, sf_dir), ["seq"], "lh").select("seq", "label", F.round("support", 6).alias("support"))


def star_tree(spark: SparkSession, sf_dir: str, orders: bool = True) -> DataFrame:
    """(node, parent): regions, nations, customers and orders below one root."""
    name = lambda letter, col: F.concat(F.lit(letter), F.lpad(F.col(col).cast("string"), 9, "0"))
    root = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"))
    out = root.unionByName(table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("node"), F.lit("root").alias("parent")))
    out = out.unionByName(table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent")))
    out = out.unionByName(table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("parent")))
    if orders:
        out = out.unionByName(table(spark, sf_dir, "orders").select(name("o", "o_orderkey").alias("node"), name("c", "o_custkey").alias("parent")))
    return out


def q27_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.subtree_counts(star_tree(spark, sf_dir))


def q28_pre_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.pre_order(star_tree(spark, sf_dir, False))


def q29_newick(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("tree"), F.col("c_custkey").alias("node"), F.lit(-1).cast("long").alias("parent"), F.lit(0).alias("ord"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.lit(0.5).alias("length"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("tree"), F.lit(-1).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("ord"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.lit(None).cast("double").alias("length"))
    return tree_text.newick_text(nations.unionByName(customers))


def q30_reroot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.reroot(star_tree(spark, sf_dir, False), "c000000001")


def q31_unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label stands for."""
    name = F.col("doc_id").cast("string").alias("name")
    return trees.unplaced(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), name), table(spark, sf_dir, "labels").select(name)).select("seq", "name")


def q32_resampled_support(spark: SparkSession, sf_dir: str, replicates: int = 100) -> DataFrame:
    """Support of the inner branches of trees of four rows by resampled sites, with the log-likelihoods of the two neighbouring trees less that of the tree."""
    p = _Passes.of(spark, sf_dir)
    rest, _ = passes.rest_lists(p.steps, p.lower, p.m, p.ends)
    around = trees.written(branch_tests.quartets(p.nodes, passes.node_lists(p.lower), rest.where("node is not null")))
    differences = trees.written(branch_tests.site_differences(around, p.m, p.sums, p.ends))
    found = branch_tests.resampled_supports(around, differences, branch_tests.site_weights(spark, LENGTH, replicates), replicates)
    return found.select("tree", "node", F.round("d2", 6).alias("d2"), F.round("d3", 6).alias("d3"), F.round("support", 4).alias("support"))


def q33_two_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.col("l_tax"), F.col("l_discount"), F.col("l_linenumber") / 100.0
    top = F.greatest(a, b, c)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(top, 6).alias("first"), F.round(F.greatest(F.least(a, b), F.least(F.greatest(a, b), c)), 6).alias("second"))


#: What describes a part as characters: digits of brand and size, and first letters of the kind and of both words of the name, in turns.
PART_LETTERS, PART_STATES = "0123456789" + string.ascii_uppercase + string.ascii_lowercase, "ACGTNACGT-" + "ACGTACGTACGTACGTACGTACGTAC" * 2


def part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(aln, seq, pos, ch): a short row of characters for each part, in alignments by the first letter of its kind."""
    words = F.split("p_name", " ")
    letters = F.concat(F.lpad(F.element_at(F.split("p_brand", "#"), 2), 2, "0"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.substring("p_type", 1, 1), F.substring(words[0], 1, 1), F.substring(words[1], 1, 1))
    text = F.translate(letters, PART_LETTERS, PART_STATES)
    wide = table(spark, sf_dir, "part").select(F.substring("p_type", 1, 1).alias("aln"), F.col("p_partkey").alias("seq"), F.posexplode(F.split(text, "")).alias("pos", "ch"))
    return wide.where("ch <> ''")


def _absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = part_cells(spark, sf_dir)
    ref = encode.consensus(sites)
    bits = lambda c: F.coalesce(F.element_at(F.create_map(*[x for s, b in (("A", 1), ("C", 2), ("G", 4), ("T", 8)) for x in (F.lit(s), F.lit(b))]), F.col(c)), F.lit(15))
    mut = encode.differences(sites, ref).join(ref, ["aln", "pos"])
    diffs = mut.select("aln", "seq", F.col("pos").alias("start"), (F.col("pos") + F.col("len") - 1).alias("stop"), bits("type").alias("bits"), bits("ref").alias("ref_bits"))
    return absorption.absorbed(_rows(sites), diffs)


def q34_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose characters say no more than those of another part of their kind (equal but for unknown sites), with the smallest such part."""
    return _absorbed(spark, sf_dir)


def _quartets(spark: SparkSession, sf_dir: str, ref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees ((4k, 4k + 1), (4k + 2, 4k + 3)) of four rows, all branches of length STEP: nodes, and runs of leaves. Inner nodes are -1 (the root) to -3."""
    sites = cells(spark, sf_dir)
    tree = F.floor(F.col("seq") / 4).cast("bigint")
    every = trees.written(_rows(sites))
    rows = every.withColumn("tree", tree)
    whole = trees.written(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).where("n = 4").select("tree"))
    tips = rows.join(whole, "tree").select("tree", F.col("seq").cast("bigint").alias("node"), F.when(F.col("seq") % 4 < 2, -2).otherwise(-3).cast("bigint").alias("parent"), F.lit(STEP).alias("length"))
    inner = whole.select("tree", F.inline(F.array(*[F.struct(F.lit(n).cast("bigint").alias("node"), F.lit(p).cast("bigint").alias("parent"), F.lit(STEP).alias("length")) for n, p in ((-1, None), (-2, -1), (-3, -1))])))
    # what differs is few of all cells: a table of its own, since regions look at it three times
    mut = trees.written(_mut(sites, ref))
    runs = encode.regions(mut, every, LENGTH).withColumn("tree", tree).join(whole, "tree")
    return tips.unionByName(inner), runs.select("tree", F.col("seq").cast("bigint").alias("node"), "start", "stop", "type")


@dataclass
class _Passes:
    m: algebra.Model
    sums: DataFrame
    ends: DataFrame
    steps: DataFrame
    lower: DataFrame
    gains: DataFrame
    nodes: DataFrame
    matrix: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, roots: bool = True) -> _Passes:
        """Without `roots`, for what looks at branches only, the lists of the roots and what their merges add are left out."""
        ref = encode.consensus(cells(spark, sf_dir))
        matrix = trees.written(_matrix(spark, sf_dir, ref=ref))
        m, sums = _model(spark, sf_dir, ref, matrix)
        ends = sums.where(F.col("pos") == LENGTH - 1).select("rate", "log_pi")
        nodes, runs = _quartets(spark, sf_dir, ref)
        nodes = trees.written(nodes)
        steps = passes.chains(nodes)
        lower, gains = passes.lower_lists(steps, passes.runs_of(runs, sums), m, ends, roots=roots)
        return cls(m, sums, ends, steps, lower, gains, nodes, matrix)

    def upper(self) -> DataFrame:
        return passes.upper_lists(self.steps, self.lower, self.m, self.ends)

    def branches(self) -> DataFrame:
        return passes.branch_sides(self.steps, self.lower, self.m, self.ends)


def q35_site_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of each site of trees of four rows, by the pass from the leaves to the root."""
    p = _Passes.of(spark, sf_dir)
    return passes.site_likelihoods(p.lower, p.gains, p.steps, p.m, p.sums, p.ends).select("tree", "pos", F.round("lh", 6).alias("lh"))


def q36_streamed_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sequence's best label, placed by a stream over the files of the table."""
    kind = table(spark, sf_dir, "embeddings").schema
    # a pattern, since the table may be one file or a folder of them
    arriving = spark.readStream.schema(kind).parquet(f"{sf_dir}/embeddings*.parquet")
    store = incremental.shared_folder(spark, "placements")
    incremental.place_stream(arriving, _characters, _profiles(spark, sf_dir), _matrix(spark, sf_dir), store, STEP).awaitTermination()
    return incremental.placements(spark, store).select("seq", "label", "lh")


def _model(spark: SparkSession, sf_dir: str, ref: DataFrame | None = None, matrix: DataFrame | None = None) -> tuple[algebra.Model, DataFrame]:
    """The shared model as columns, and (pos, ref, rate, log_pi): running sums over sites of what the reference's states have of both."""
    ref = encode.consensus(cells(spark, sf_dir)) if ref is None else ref
    matrix = _matrix(spark, sf_dir, ref=ref) if matrix is None else matrix
    q = {(r.from_state, r.to_state): r.q for r in matrix.collect()}  # 16 rows
    pi = {r.state: r.freq for r in rates.root_frequencies(ref).collect()}  # 4 rows
    m = algebra.Model.of([[q[a, b] for b in "ACGT"] for a in "ACGT"], [pi.get(s, 0.0) for s in "ACGT"])
    number = m.index(F.col("ref"))
    values = {"rate": m.rate(number, number), "log_pi": F.log(F.element_at(m.pi, number))}
    sums = segments.prefix_sums(ref.select("pos", "ref"), [], "pos", values, block=16)
    return m, trees.written(sums.join(ref.select("pos", "ref"), "pos"))


def _pair_segments(spark: SparkSession, sf_dir: str, sums: DataFrame) -> DataFrame:
    """(seq, start, stop, a, b, ref, rate, log_pi): shared segments of rows 2k and 2k + 1 as runs, with the reference's sums over each."""
    sites = cells(spark, sf_dir)
    runs = encode.regions(_mut(sites), _rows(sites), LENGTH).select("seq", "start", "stop", "type")
    both = segments.overlay(runs.where("seq % 2 = 0"), runs.where("seq % 2 = 1").withColumn("seq", F.col("seq") - 1), ["seq"]).where("a is not null and b is not null")
    upper = sums.select(F.col("pos").alias("stop"), "ref", "rate", "log_pi")
    lower = sums.select((F.col("pos") + 1).alias("start"), F.col("rate").alias("rate_before"), F.col("log_pi").alias("log_before"))
    over = both.join(upper, "stop").join(lower, "start", "left")
    base = lambda c: F.coalesce(c, F.lit(0.0))
    return over.select("seq", "start", "stop", algebra.run(F.col("a")).alias("a"), algebra.run(F.col("b")).alias("b"), "ref", (F.col("rate") - base("rate_before")).alias("rate"), (F.col("log_pi") - base("log_before")).alias("log_pi"))


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[algebra.Model, DataFrame]:
    m, sums = _model(spark, sf_dir)
    return m, _pair_segments(spark, sf_dir, sums)


def q37_cherry_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of each pair of neighbouring rows as the two leaves of a tree."""
    m, rows = _pairs(spark, sf_dir)
    step = F.lit(STEP)
    merged = rows.select("seq", "ref", "log_pi", algebra.merge_lowers(m, F.col("a"), step, F.col("b"), step, F.col("ref"), F.col("rate")).alias("x"))
    # an unknown beside a run of the reference keeps its run, whose sum of frequencies is that of the segment
    return merged.groupBy("seq").agg(F.round(F.sum(F.col("x.gain") + algebra.root_likelihood(m, F.col("x.run"), F.col("ref"), F.col("log_pi"))), 6).alias("lh"))


def q38_upper_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands on the way to one leaf of such a pair, where the run of the other comes down from the root: sites by type and lengths."""
    m, rows = _pairs(spark, sf_dir)
    # a column of its own: merges look at it many times
    rows = rows.withColumn("above", algebra.root_total(m, F.col("b"), F.lit(STEP)))
    met = rows.select("seq", (F.col("stop") - F.col("start") + 1).cast("bigint").alias("sites"), algebra.merge_upper_lower(m, F.col("above"), F.lit(STEP), F.col("a"), F.lit(STEP), F.col("ref")).alias("x"))
    return met.groupBy("seq", "x.type", "x.n", "x.r").agg(F.sum("sites").alias("sites"))


def q39_sample_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, rows = _pairs(spark, sf_dir)
    return rows.groupBy("seq").agg(F.round(F.sum(algebra.sample_cost(m, F.col("a"), F.col("b"), F.lit(STEP), F.col("ref"), F.col("rate"))), 6).alias("cost"))


def q40_branch_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best length of a branch between neighbouring rows: collected terms, and the zero of the slope."""
    m, rows = _pairs(spark, sf_dir)
    terms = rows.where("a.type <> 'N' and b.type <> 'N'").select("seq", algebra.length_terms(m, F.col("a"), F.col("b"), F.col("ref"), F.col("rate")).alias("x"))
    sums = terms.groupBy("seq").agg(F.sum("x.linear").alias("linear"), F.collect_list("x.ratio").alias("ratios"))
    return sums.select("seq", F.round("linear", 6).alias("linear"), F.size("ratios").cast("bigint").alias("n_ratios"), F.round(algebra.solved_lengths(F.col("linear"), F.col("ratios"), 1e-10), 6).alias("length"))


def q41_subtree_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, rows = _pairs(spark, sf_dir)
    return rows.groupBy("seq").agg(F.round(F.sum(algebra.subtree_cost(m, F.col("a"), F.col("b"), F.lit(STEP), F.col("ref"))) - STEP * LENGTH, 6).alias("cost"))


def q42_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal rates between the states that the labels' consensus rows have."""
    found = encode.consensus(cells(spark, sf_dir, True)).select("aln", F.col("ref").alias("state"))
    return rates.equal_rates_of(found).select(F.lit("JC").alias("model"), "from_state", "to_state", F.round("q", 6).alias("q"))


def q43_collapsed_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a positive balance as leaves on branches without length, below their nation."""
    node = F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    leaves = table(spark, sf_dir, "customer").select(node.alias("node"), F.col("c_nationkey").cast("string").alias("parent"), F.col("c_acctbal").cast("double").alias("length"))
    return trees.collapsed(leaves, 0.0)


def q44_bound_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as leaves that are named after their customers, bound to customers by name."""
    leaves = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"))
    bound = trees.bind(leaves, table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("seq")))
    return bound.groupBy("name", "seq").agg(F.count(F.lit(1)).alias("n"))


def q45_support_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.support_lines(rates.supports(_near(spark, sf_dir), ["seq"], "lh"), "seq", "label")


def q46_minor_clades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with those that they absorb as clades without lengths."""
    return tree_text.minor_clades(_absorbed(spark, sf_dir).select("aln", "host", "seq", F.concat(F.lit("s"), F.col("host").cast("string")).alias("host_name"), F.concat(F.lit("s"), F.col("seq").cast("string")).alias("name")))


def q47_length_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch on which a row hangs on its neighbour, halved and doubled as long as that gains."""
    m, rows = _pairs(spark, sf_dir)
    found = []
    for way, factor in (("shorter", 0.5), ("longer", 2.0)):
        lengths = trials.trial_lengths(F.lit(STEP), factor, STEP / 64, STEP * 16)
        costs = trials.trial_costs(rows, ["seq"], lengths, lambda t: algebra.sample_cost(m, F.col("a"), F.col("b"), t, F.col("ref"), F.col("rate")))
        found.append(trials.best_trial(costs, ["seq"]).select("seq", F.lit(way).alias("way"), "k", "length", F.round("cost", 6).alias("cost")))
    return found[0].unionByName(found[1])


def q48_exchange_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix per label from its frequencies, with changes within A, G and within C, T twice as likely as others."""
    freqs = rates.root_frequencies(encode.consensus(cells(spark, sf_dir, True)), ["aln"])
    pairs = spark.createDataFrame([(a, b, 2.0 if a + b in ("AG", "CT") else 1.0) for a in "ACGT" for b in "ACGT" if a < b], "from_state string, to_state string, s double")
    exchange = freqs.select("aln").distinct().crossJoin(F.broadcast(pairs))  # six rows
    return rates.exchange_matrix(exchange, freqs, ["aln"]).select("aln", "from_state", "to_state", F.round("q", 6).alias("q"))


def q49_site_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared matrix at every site, times the site's rate: how often each state leaves itself there."""
    sites = cells(spark, sf_dir)
    ref = encode.consensus(sites)
    events = sites.join(ref, ["aln", "pos"])
    of_site = rates.site_rates(events, "pos", (F.col("ch") != F.col("ref")).cast("long"), F.lit(STEP))
    per = rates.site_matrices(ref, _matrix(spark, sf_dir), rates=of_site)
    return per.select("pos", F.inline(F.array(*[F.struct(F.lit(s).alias("state"), F.round(-F.col("q")[i][i], 6).alias("leaves")) for i, s in enumerate("ACGT")])))


def q50_tree_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Passes.of(spark, sf_dir)
    return passes.tree_likelihoods(p.lower, p.gains, p.steps, p.m, p.ends).select("tree", F.round("lh", 6).alias("lh"))


def q51_lower_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies below the inner nodes of these trees: sites by type of run, and the lengths since they were seen."""
    runs = passes.node_lists(_Passes.of(spark, sf_dir).lower).where("node < 0")
    sites = (F.col("stop") - F.col("start") + 1).cast("bigint")
    return runs.groupBy("tree", "node", "run.type").agg(F.sum(sites).alias("sites"), F.round(F.sum(sites * F.coalesce("run.n", F.lit(0.0))), 6).alias("length"))


def q52_upper_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies on the other side of each branch: sites by type of run, lengths since they were seen and beyond the root."""
    runs = _Passes.of(spark, sf_dir, roots=False).upper()
    sites = (F.col("stop") - F.col("start") + 1).cast("bigint")
    length = lambda c: F.round(F.sum(sites * F.coalesce(c, F.lit(0.0))), 6)
    return runs.groupBy("tree", "node", "run.type").agg(F.sum(sites).alias("sites"), length("run.n").alias("length"), length("run.r").alias("beyond"))


def q53_branch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes along the branches of these trees: unequal determined states at both ends."""
    return passes.branch_counts(_Passes.of(spark, sf_dir, roots=False).branches())


def q54_tree_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symmetric matrix from those changes and the starting pseudo-counts."""
    counts = trees.written(passes.branch_counts(_Passes.of(spark, sf_dir, roots=False).branches()))
    sites = cells(spark, sf_dir)
    found = rates.rate_matrix(counts.unionByName(rates.seed_counts(sites)), rates.root_frequencies(encode.consensus(sites)))
    return found.select("from_state", "to_state", F.round("q", 6).alias("q"))


def q55_tree_site_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rate for each site from changes and waiting times along the branches of trees of four rows."""
    p = _Passes.of(spark, sf_dir, roots=False)
    diagonal = p.matrix.where("from_state = to_state").select(F.col("from_state").alias("state"), "q")
    return site_models.single_rates(p.branches(), p.sums.select("pos", "ref"), diagonal).select("pos", F.round("rate", 6).alias("rate"))


def q56_iterated_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices of sites after two turns of expected changes along those branches."""
    ref = encode.consensus(cells(spark, sf_dir))
    sites, matrix = ref.select("pos", "ref"), trees.written(_matrix(spark, sf_dir, ref=ref))
    nodes, runs = _quartets(spark, sf_dir, ref)
    m, _ = _model(spark, sf_dir, ref, matrix)
    shared = trees.written(rates.site_matrices(sites, matrix))
    last = site_models.iterated_matrices(nodes, runs, sites, m, shared, rounds=2, least=float("-inf"))[-1].matrices
    to = lambda i: F.round(F.col("row")[i], 5)
    return last.select("pos", F.posexplode("q").alias("i", "row")).select("pos", F.substring(F.lit("ACGT"), F.col("i") + 1, F.lit(1)).alias("from_state"), to(0).alias("to_a"), to(1).alias("to_c"), to(2).alias("to_g"), to(3).alias("to_t"))


def q57_root_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each branch of trees of four rows carries the root: log-likelihood of the tree hung from its middle, and its share among those near the best."""
    p = _Passes.of(spark, sf_dir)
    lh = passes.root_likelihoods(p.steps, p.lower, p.gains, p.m, p.ends).withColumn("lh", F.round("lh", 6))
    return rates.supports(lh, ["tree"], "lh", round(math.log(LENGTH), 6)).where("support >= 0.01").select("tree", "node", "lh", F.round("support", 5).alias("support"))


def q58_rerooted_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers with the root on the branch of the first customer: lengths and notes of turned branches go with them."""
    code = F.substring("node", 2, 9).cast("long")
    length = F.when(F.col("parent").isNotNull(), (code % 7 + 1) / 8.0)
    nodes = star_tree(spark, sf_dir, False).select("node", "parent", length.alias("length"), F.concat_ws("-", "node", "parent").alias("note"))
    return trees.reroot_branch(nodes, "c000000001", 0.25, "top", ("note",))


def _shape_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, start, stop, run): each vector as 16 runs of the sizes of four components, to four digits."""
    size = lambda i: F.round(F.abs(F.element_at("embedding", i).cast("double")), 4)
    parts = F.array(*[F.struct(F.lit(4 * k).alias("start"), F.lit(4 * k + 3).alias("stop"), algebra.run(F.lit("O"), F.lit(STEP), None, F.array(*[size(4 * k + i) for i in range(1, 5)])).alias("run")) for k in range(16)])
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), F.inline(parts))


def q59_changed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows k and k + 1 as lists of vectors: runs that differ by more than the limits, and whether the lists are equal within a wider one."""
    lists = _shape_lists(spark, sf_dir)
    left, right = lists.where("seq % 2 = 0"), lists.where("seq % 2 = 1").withColumn("seq", F.col("seq") - 1)
    moved = segments.changed_lists(left, right, ["seq"], limit=0.26005, update=0.32005, fold=1.001)
    return moved.join(segments.equal_lists(left, right, ["seq"], 0.30005), "seq").select("seq", "n_changed", "changed", "equal")


def q60_coalesced_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as runs with lengths: neighbours of one type and of nearly equal lengths become one."""
    at = ["l_orderkey", "l_linenumber"]
    lines = table(spark, sf_dir, "lineitem").groupBy(*at).agg(F.min("l_linestatus").alias("status"), F.min("l_discount").alias("n"), F.min("l_tax").alias("r"))
    runs = lines.select("l_orderkey", F.col("l_linenumber").alias("start"), F.col("l_linenumber").alias("stop"), algebra.run(F.when(F.col("status") == "O", "R").otherwise("N"), F.col("n"), F.col("r")).alias("run"))
    found = segments.coalesce_within(runs, ["l_orderkey"], 0.035)
    return found.select("l_orderkey", "start", "stop", "run.type", F.round("run.n", 6).alias("n"), F.round("run.r", 6).alias("r"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("q") and name[1:3].isdigit()}

"""Alignments: readers, consensus, differences, order, writers."""

from __future__ import annotations

import collections
import random

import pytest

from tideline.functions import states
from tideline.operators import encode, segments
from tideline.sources import alignments as al

ROWS = {"T1": "ATTAAAGCTTTATACCTVYC", "T2": "ATTAAAGGTTTATACCTVCA", "T5": "ATTAANNN-TTATACCTVCC", "T3": "ATTAAAGGTTTATACCTVCC"}


@pytest.fixture
def fasta(tmp_path):
    path = tmp_path / "rows.fa"
    path.write_text("".join(f">{k} some text\n{v[:7].lower()}\n{v[7:]}\n" for k, v in ROWS.items()))
    return str(path)


def test_fasta_and_formats(spark, fasta, tmp_path):
    rows = al.read_fasta(spark, fasta).orderBy("seq").collect()
    assert [(r.name, r.text) for r in rows] == list(ROWS.items())
    assert al.detect_format(spark, fasta) == "fasta"
    assert al.read_reference(spark, fasta, "t5") == ROWS["T5"]
    with pytest.raises(al.FormatError):
        al.read_reference(spark, fasta, "missing")
    bad = tmp_path / "bad.fa"
    bad.write_text(">a\nACGT\n>b\nACG\n>c\nACGT\n")
    with pytest.raises(al.FormatError):
        al.read_fasta(spark, str(bad))


def test_phylip_sequential_and_interleaved(spark, tmp_path):
    one, two = tmp_path / "one.phy", tmp_path / "two.phy"
    one.write_text("3 8\nfirst ACGTACGT\nsecond    AC GTAC GA\nthird ACGTACGC\n")
    two.write_text("3 8\nfirst ACGT\nsecond ACGT\nthird ACGT\n\nACGT\nACGA\nACGC\n")
    for path in (one, two):
        rows = al.read_phylip(spark, str(path)).orderBy("seq").collect()
        assert [(r.name, r.text) for r in rows] == [("first", "ACGTACGT"), ("second", "ACGTACGA"), ("third", "ACGTACGC")]
        assert al.detect_format(spark, str(path)) == "phylip"
    one.write_text("3 9\nfirst ACGTACGT\nsecond ACGTACGA\nthird ACGTACGC\n")
    with pytest.raises(al.FormatError):
        al.read_phylip(spark, str(one))


def test_differences_order_and_round_trip(spark, fasta, tmp_path):
    rows = al.read_fasta(spark, fasta)
    sites = al.cells(rows)
    ref = encode.consensus(sites)
    text = "".join(r.ref for r in ref.orderBy("pos").collect())
    assert text == "ATTAAAGGTTTATACCTACC"  # the ambiguous V wins its site and becomes A
    mut = encode.differences(sites, ref)
    found = {r.seq: [] for r in rows.collect()}
    for r in mut.orderBy("seq", "pos").collect():
        found[r.seq].append((r.type, r.pos, r.len))
    assert found[0] == [("C", 7, 1), ("V", 17, 1), ("Y", 18, 1)]
    assert found[2] == [("N", 5, 3), ("-", 8, 1), ("V", 17, 1)]
    order = encode.distances(sites, mut).orderBy("ord").collect()
    assert [(r.seq, r.distance) for r in order] == [(3, 1001), (1, 2001), (0, 3002), (2, 3005)]
    back = {r.seq: r.text for r in encode.reconstruct(mut, ref, sites.select("aln", "seq").distinct()).collect()}
    assert back == {r.seq: r.text for r in rows.collect()}

    path = str(tmp_path / "delta")
    al.write_text(al.delta_file(text, rows.select("seq", "name"), encode.delta_lines(mut, strict_reference=False)), path)
    reference, names, again = al.read_delta(spark, path)
    assert reference == text
    assert [r.name for r in names.orderBy("seq").collect()] == list(ROWS)
    assert sorted((r.seq, r.type, r.pos, r.len) for r in again.collect()) == sorted((r.seq, r.type, r.pos, r.len) for r in mut.collect())
    strict = {r.seq: r.lines.split("\n") for r in encode.delta_lines(mut).collect()}
    assert strict[2][:2] == ["-\t6\t3", "-\t9\t1"]  # unknown sites are written as gaps
    with pytest.raises(Exception, match="already exists"):
        al.write_text(al.fasta_lines(rows), path)


@pytest.mark.parametrize("body", [">REF\nACGT\nACGT\n>a\nt\t1\n", ">a\nt\t1\n", ">REF\nACGT\n>x\na\t1\n", ">REF\nACGT\n>x\nt\t1\t2\n", ">REF\nACGT\n>x\nt\t9\n", ">REF\nACGTACGTACGTRACGT\n>x\nt\t9\n"])
def test_delta_errors(spark, tmp_path, body):
    path = tmp_path / "x.txt"
    path.write_text(body)
    with pytest.raises(al.FormatError):
        al.read_delta(spark, str(path))


def test_consensus_takes_the_first_to_reach_half(spark):
    cells = spark.createDataFrame([(0, s, 0, c) for s, c in enumerate("CAAC")] + [(0, s, 1, "-") for s in range(4)] + [(0, s, 2, c) for s, c in enumerate("TGA-")], "aln int, seq long, pos int, ch string")
    assert [(r.pos, r.ref) for r in encode.consensus(cells).orderBy("pos").collect()] == [(0, "A"), (1, "A"), (2, "A")]


def test_states(spark):
    rows = spark.createDataFrame([(c,) for c in "ACGTURYWSMKBHDVNX?-z"], "ch string")
    got = {r.ch: (r.code, r.v) for r in rows.select("ch", states.state_code(rows.ch).alias("code"), states.ambiguity_vector(states.state_code(rows.ch)).alias("v")).collect()}
    assert got["U"][0] == 3 and got["V"] == (10, [1 / 3, 1 / 3, 1 / 3, 0.0]) and got["-"] == (253, None) and got["z"] == (None, None)
    text = spark.createDataFrame([("ac(gt){a}-n",), ("ac!",), (None,)], "t string")
    assert [r[0] for r in text.select(states.clean_body(text.t)).collect()] == ["AC??-N", None, None]


def test_overlay_matches_a_join_of_intervals(spark):
    left = spark.createDataFrame([(1, 0, 4, "R"), (1, 5, 5, "A"), (1, 6, 9, "R"), (2, 0, 9, "N")], "k int, start int, stop int, type string")
    right = spark.createDataFrame([(1, 0, 2, "N"), (1, 3, 9, "R"), (2, 0, 3, "R"), (2, 4, 9, "N")], "k int, start int, stop int, type string")
    got = sorted(tuple(r) for r in segments.overlay(left, right, ["k"]).collect())
    assert got == [(1, 0, 2, "R", "N"), (1, 3, 4, "R", "R"), (1, 5, 5, "A", "R"), (1, 6, 9, "R", "R"), (2, 0, 3, "N", "R"), (2, 4, 9, "N", "N")]


@pytest.mark.parametrize("block", [1, 3, 65_536])
def test_distance_order_in_blocks_is_one_stable_order(spark, block):
    rows = [(aln, seq, pos, "ACGT"[(seq * 7 + pos * seq) % 3 % 2]) for aln in (0, 1) for seq in range(11) for pos in range(5)]
    sites = spark.createDataFrame(rows, "aln int, seq long, pos int, ch string")
    ref = spark.createDataFrame([(aln, pos, "A") for aln in (0, 1) for pos in range(5)], "aln int, pos int, ref string")
    found = encode.distances(sites, encode.differences(sites, ref), block).collect()
    off = {(a, s): 1000 * sum(1 for x, y, _, ch in rows if (x, y) == (a, s) and ch != "A") for a, s, _, _ in rows}
    want = {(a, s): 1 + sorted((d, k) for (b, k), d in off.items() if b == a).index((off[a, s], s)) for a, s in off}
    assert {(r.aln, r.seq): r.ord for r in found} == want
    assert len(found) == len(want)
    assert not encode.distances(sites.limit(0), encode.differences(sites, ref).limit(0), block).collect()


@pytest.mark.parametrize("n", [2, 3, 5, 8, 9])
def test_contested_sites_are_decided_by_blocks_of_rows(spark, n):
    """Sites where two characters reach half, against a walk over the rows, in blocks of any size."""
    rng = random.Random(n)
    texts = ["".join(rng.choice("AC" if p < 30 else "AC-GN") for p in range(40)) for _ in range(n)]
    cells = spark.createDataFrame([(0, 10 * s, p, ch) for s, t in enumerate(texts) for p, ch in enumerate(t)], "aln int, seq long, pos int, ch string")
    want = []
    for p in range(40):
        seen = collections.Counter()
        found = None
        for t in texts:
            if t[p] != "-":
                seen[t[p]] += 1
                found = found or (t[p] if seen[t[p]] >= max(n // 2, 1) else None)
        found = found or min(seen, key=lambda c: (-seen[c], c), default="A")
        want.append(found if found in "ACGT" else "A")
    for block in (5, 25, 65_536):
        assert [r.ref for r in encode.consensus(cells, block).orderBy("pos").collect()] == want
    ref = encode.consensus(cells)
    mut, rows = encode.differences(cells, ref), cells.select("aln", "seq").distinct()
    for most in (39, 40):
        assert {r.seq: r.text for r in encode.reconstruct(mut, ref, rows, most).collect()} == {10 * s: t for s, t in enumerate(texts)}

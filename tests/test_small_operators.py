"""Small operators on fixtures written out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tideline.functions import states
from tideline.operators import encode, rates, trees
from tideline.sources import trees as tt


def test_names_of_leaves(spark):
    nodes = spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, "zz")], "node long, name string")
    rows = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c")], "seq long, name string")
    assert [tuple(r) for r in trees.unknown_leaves(nodes, rows).collect()] == [(4, "zz")]
    bound = {r.node: r.seq for r in trees.bind(nodes.withColumn("seq", F.lit(99)), rows).collect()}
    assert bound == {1: None, 2: 10, 3: 11, 4: None}
    assert [tuple(r) for r in trees.unplaced(rows, nodes).collect()] == [(12, "c")] or [r.seq for r in trees.unplaced(rows, nodes).collect()] == [12]
    assert trees.unplaced(rows.where("seq < 12"), nodes).isEmpty()


def test_collapsed_leaves(spark):
    rows = [(0, None, None), (1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.5), (4, 0, 0.0), (5, 3, 0.0), (6, 3, 0.1)]
    nodes = spark.createDataFrame(rows, "node long, parent long, length double")
    assert {r.node: r.host for r in trees.collapsed(nodes, 0.0).collect()} == {2: 1, 4: 1}


def test_minor_clades(spark):
    rows = spark.createDataFrame([(0, 1, 5, "h", "x"), (0, 1, 3, "h", "y"), (0, 2, 9, "k", "z")], "aln int, host long, seq long, host_name string, name string")
    assert {r.host: r.clade for r in tt.minor_clades(rows).collect()} == {1: "(h:0,y:0,x:0)", 2: "(k:0,z:0)"}


def test_support_lines(spark):
    rows = spark.createDataFrame([(1, 7, -1.0, 0.7), (1, 8, -2.0, 0.295), (1, 9, -9.0, 0.005), (2, 3, -1.0, 1.0)], "seq long, label int, lh double, support double")
    got = {r.seq: r.line for r in rates.support_lines(rows, "seq", "label").collect()}
    assert got == {1: "s1\t7\t0.70000\tin8:0.29500", 2: "s2\t3\t1.00000\t"}


def test_effectiveness_errors(spark):
    mut = spark.createDataFrame([(0, 1, "A", 3, 1)], "aln int, seq long, type string, pos int, len int")
    sizes = lambda n, length: spark.createDataFrame([(0, n, length)], "aln int, n long, length long")
    assert encode.effectiveness(mut, sizes(3, 100)).first().effective
    assert not encode.effectiveness(mut, sizes(3, 10)).first().effective
    with pytest.raises(ValueError, match="below"):
        encode.effectiveness(mut, sizes(3, 100), 0.01, 0.02)
    for n, length in ((2, 100), (3, 0), (3, None)):
        with pytest.raises(ValueError, match="needed"):
            encode.effectiveness(mut, sizes(n, length))


@pytest.mark.parametrize(("text", "want"), [("ACGTNNNNNNNNNNNNNNNN", "dna"), ("ACGU--..", "dna"), ("MKVLARND", "protein"), ("", "unknown"), ("ACGTNNNNKL", "protein"), ("1234567", "unknown")])
def test_sequence_types(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(states.sequence_type(F.col("t"))).first()[0] == want

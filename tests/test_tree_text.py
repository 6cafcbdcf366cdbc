"""Trees as text by a walk around them, in lines that many tasks write."""

from __future__ import annotations

import glob
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import trees
from tideline.sources import trees as tt


@pytest.mark.parametrize("x", [0.5, 1.0, 1e-05, 0.0001, 123456789012.0, 1234567890123.0, 0.1 + 0.2, 1 / 3, 2.5e-10, 1e20, 1e100, 7.000000000049, 0.0, -3.0, 9.9999999999999])
def test_numbers(spark, x):
    assert spark.range(1).select(tt.number_text(F.lit(x))).first()[0] == (f"{x:.12g}" if x > 0 else "0")


def test_tour(spark):
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r"), ("c", "a"), ("d", "a")], "node string, parent string")
    got = {r.node: (r.enter, r.leave, r.size, r.nth) for r in trees.toured(nodes).collect()}
    assert got == {"r": (0, 9, 5, 1), "a": (1, 6, 3, 1), "c": (2, 3, 1, 1), "d": (4, 5, 1, 2), "b": (7, 8, 1, 2)}


def plain_text(kids, x):
    own = [plain_text(kids, c) for c in sorted(kids.get(x, []))]
    return f"({','.join(own)})n{x}" if own else f"n{x}"


def test_round_trip_of_100000_nodes(spark, tmp_path):
    rng = random.Random(1)
    rows = [(1, 0, None, 0, "n0", None, None)] + [(1, i, max(0, i - 1 - int(rng.expovariate(0.05))), i, f"n{i}", 0.25, f"support={i % 100}" if i % 3 == 0 else None) for i in range(1, 100_000)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, ord int, name string, length double, note string")
    path = str(tmp_path / "tree")
    tt.write_newick(nodes, path, parts=5)
    parts = sorted(glob.glob(f"{path}/part-*"))
    assert len(parts) > 1 and max(len(line) for p in parts for line in open(p)) < 100_000
    text = "".join(line.rstrip("\n") for p in parts for line in open(p))
    assert text.count("[&support=") == sum(r[6] is not None for r in rows)
    back = {name: (parent, length) for _, parent, _, name, length in tt.parse_newick(text)}
    names = [x[3] for x in tt.parse_newick(text)]
    assert {k: (None if p is None else names[p], t) for k, (p, t) in back.items()} == {r[4]: (None if r[2] is None else f"n{r[2]}", r[5]) for r in rows}


def test_texts_and_documents(spark, tmp_path):
    rng = random.Random(2)
    rows, kids = [], {}
    for tree in (4, 9):
        own = {}
        for i in range(40):
            p = rng.randrange(i) if i else None
            rows.append((tree, i, p, i, f"n{i}", None))
            if i:
                own.setdefault(p, []).append(i)
        kids[tree] = own
    rows.append((11, 0, None, 0, "alone", None))
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, ord int, name string, length double")
    got = {r.tree: r.text for r in tt.newick_text(nodes).collect()}
    assert got == {4: plain_text(kids[4], 0) + ";", 9: plain_text(kids[9], 0) + ";", 11: "alone;"}
    path = str(tmp_path / "nexus")
    tt.write_nexus(nodes.where("tree = 4").withColumn("note", F.when(F.col("node") == 3, "x=1")), path)
    text = "\n".join(open(p).read().rstrip("\n") for p in sorted(glob.glob(f"{path}/part-*")))
    assert text.startswith("#NEXUS\nBEGIN TAXA;\nDIMENSIONS NTAX=") and text.rstrip().endswith("END;") and "n3[&x=1]" in text
    again = tt.newick_nodes(spark.createDataFrame([(4, text)], "tree long, text string"))
    assert {r.text for r in tt.newick_text(again).collect()} == {got[4]}

"""Rates of sites from trees: the turns of the iteration, and single rates."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import algebra, passes, site_models
from tideline.operators.trees import written

STATES = "ACGT"


def simulated(spark, trees=4, leaves=8, sites=24):
    """Random trees whose first sites change much more often than the others; nodes, leaves' runs and the reference."""
    rng = np.random.default_rng(8)
    ref = [STATES[i] for i in rng.integers(4, size=sites)]
    nodes, regions = [], []
    for tree in range(trees):
        texts = {0: list(ref)}
        nodes.append((tree, 0, None, None))
        tips = [0]
        while len(tips) < leaves:
            x = tips.pop(0)
            for y in (len(texts), len(texts) + 1):
                text = [str(rng.choice([s for s in STATES if s != c])) if rng.random() < (0.12 if i < 4 else 0.004) else c for i, c in enumerate(texts[x])]
                texts[y] = text
                nodes.append((tree, y, x, 0.03))
                tips.append(y)
        for x in tips:
            i = 0
            while i < sites:
                j = i
                while texts[x][i] == ref[i] and j + 1 < sites and texts[x][j + 1] == ref[j + 1]:
                    j += 1
                regions.append((tree, x, i, j, "R" if texts[x][i] == ref[i] else texts[x][i]))
                i = j + 1
    return (
        spark.createDataFrame(nodes, "tree long, node long, parent long, length double"),
        spark.createDataFrame(regions, "tree long, node long, start int, stop int, type string"),
        written(spark.createDataFrame(list(enumerate(ref)), "pos int, ref string")),
    )


def test_turns_gain_and_stop(spark):
    nodes, regions, sites = simulated(spark)
    q = [[-1.0 if a == b else 1 / 3 for b in STATES] for a in STATES]
    m = algebra.Model.of(q, [0.25] * 4)
    shared = written(sites.select("pos", F.lit(q).alias("q")))
    turns = site_models.iterated_matrices(nodes, regions, sites, m, shared, rounds=3)
    gains = np.diff([t.likelihood for t in turns])
    assert len(gains) and gains[0] > 1 and (gains[:-1] > 1).all()  # goes on only while a turn gains more than one
    # the last turn may lose a little: counts and lengths are first-order estimates
    assert abs(gains[-1]) <= 1 or len(gains) == 3
    last = {r.pos: r.q for r in turns[-1].matrices.collect()}
    assert len(last) == sites.count()
    for rows in last.values():
        assert np.allclose(np.sum(rows, axis=1), 0) and all(site_models.ENTRY_BOUNDS[0] <= rows[i][j] <= site_models.ENTRY_BOUNDS[1] for i in range(4) for j in range(4) if i != j)
    leaving = {p: -np.mean(np.diag(rows)) for p, rows in last.items()}
    assert min(leaving[p] for p in range(4)) > max(leaving[p] for p in range(4, 24))  # the sites that change most


def test_single_rates(spark):
    """Written out for three branches: waiting times of equal ends, changes of unequal ones, unknown and ambiguous ends apart."""
    kind = f"tree int, node int, length double, start int, stop int, above {algebra.RUN}, below {algebra.RUN}, ref string, same_rate double"
    run = lambda t: (t, None, None, None)
    rows = [(1, 1, 0.5, 0, 3, run("R"), run("R"), None, 0.0), (1, 2, 0.25, 0, 0, run("R"), run("C"), "A", 0.0), (1, 2, 0.25, 1, 3, run("R"), run("R"), None, 0.0), (1, 3, 0.125, 0, 1, run("N"), run("R"), None, 0.0), (1, 3, 0.125, 2, 2, run("G"), run("G"), "A", 0.0), (1, 3, 0.125, 3, 3, run("T"), run("A"), "C", 0.0), (1, 4, 0.0, 3, 3, run("T"), run("A"), "C", 0.0)]
    sites = spark.createDataFrame([(0, "A"), (1, "A"), (2, "A"), (3, "C")], "pos int, ref string")
    diagonal = spark.createDataFrame([("A", -1.0), ("C", -2.0), ("G", -4.0), ("T", -1.0)], "state string, q double")
    got = {r.pos: r.rate for r in site_models.single_rates(spark.createDataFrame(rows, kind), sites, diagonal).collect()}
    raw = [1 / 0.5, 0.001, 0.001, 1 / (0.75 * 2)]
    assert [got[p] for p in range(4)] == pytest.approx([max(x / np.mean(raw), 1e-4) for x in raw])


def test_total_lists_agree_with_the_tree(spark):
    """What is known of a node from both sides is the same likelihood wherever it is looked at, as far as first-order steps go."""
    nodes, regions, sites = simulated(spark, trees=1, leaves=6, sites=10)
    q = [[-1.0 if a == b else 1 / 3 for b in STATES] for a in STATES]
    m = algebra.Model.of(q, [0.25] * 4)
    sums, ends = site_models.running_sums(sites, written(sites.select("pos", F.lit(q).alias("q"))), m)
    steps = passes.chains(nodes)
    lower, _ = passes.lower_lists(steps, passes.runs_of(regions, sums), m, ends)
    branches = passes.branch_segments(passes.upper_lists(steps, lower, m, ends), passes.node_lists(lower), ends)
    totals = passes.total_lists(branches, m)
    per = {(r.node): r.n for r in totals.groupBy("node").agg(F.sum(F.col("stop") - F.col("start") + 1).alias("n")).collect()}
    assert set(per.values()) == {10} and len(per) == nodes.count() - 1
    for r in totals.where("run.type = 'O'").collect():
        assert sum(r.run.v) == pytest.approx(1) and min(r.run.v) >= 0

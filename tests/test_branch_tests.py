"""Resampled supports of branches against trees written out."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_passes import PI, Q, both_passes, plain_passes
from tideline.operators import algebra, branch_tests, passes

REF = "ACGTTGCAACGT"


def test_inner_branch_below_the_root(spark):
    """A branch away from the root, and the one that the root divides: differences by site, and supports with the same draws."""
    nodes = {0: (None, 0.0), 1: (0, 0.02), 2: (0, 0.03), 3: (1, 0.04), 4: (1, 0.01), 5: (3, 0.02), 6: (3, 0.015), 7: (2, 0.01), 8: (2, 0.02)}
    texts = {(1, 4): "ACGTTGCAACGA", (1, 5): "CCGATGCTACNT", (1, 6): "CCGATNCAACGT", (1, 7): "ACGTTGGTAAGA", (1, 8): "ACTTTGGAANNT"}
    model = algebra.Model.of(Q.tolist(), PI.tolist())
    sums, ends, steps, lower, _, _ = both_passes(spark, model, {1: nodes}, texts, REF)
    rest, _ = passes.rest_lists(steps, lower, model, ends)
    frame = spark.createDataFrame([(1, x, p, t) for x, (p, t) in nodes.items()], "tree long, node long, parent long, length double")
    around = branch_tests.quartets(frame, passes.node_lists(lower), rest.where("node is not null"))
    assert {r.node for r in around.select("node").distinct().collect()} == {1, 2, 3}
    differences = branch_tests.site_differences(around, model, sums, ends)
    got = {(r.node, r.pos): (r.d2, r.d3) for r in differences.collect()}

    # around 3: the cherries (5, 6) and (4, rest), the rest being (7, 8) over its branches; around 1 and 2: (3, 4) and (7, 8)
    deep = {10: {5: 0.02, 6: 0.015}, 20: {4: 0.01, 2: 0.05}}
    wide = {10: {3: 0.04, 4: 0.01}, 20: {7: 0.01, 8: 0.02}}
    under = {2: {7: 0.01, 8: 0.02}, 3: {5: 0.02, 6: 0.015}}

    def likelihood(ends_of, center, swap, p):
        a, b = ({k: dict(v) for k, v in ends_of.items()}[x] for x in (10, 20))
        if swap is not None:
            x, y = sorted(a)[swap], sorted(b, key=lambda k: k != (4 if 4 in b else 7))[0]
            a[y], b[x] = b.pop(y), a.pop(x)
        tree = {0: (None, 0.0), 10: (0, center / 2), 20: (0, center / 2)}
        for top, kids in ((10, a), (20, b)):
            tree |= {k: (top, t) for k, t in kids.items()}
        for k in [k for k in tree if k in under]:
            tree |= {x: (k, t) for x, t in under[k].items()}
        with_kids = {parent for parent, _ in tree.values()}
        return plain_passes(tree, {x: texts[1, x][p] for x in tree if x not in with_kids})[2]

    totals = {}
    for node, ends_of, center in ((3, deep, 0.04), (1, wide, 0.05), (2, wide, 0.05)):
        for p in range(len(REF)):
            base = likelihood(ends_of, center, None, p)
            want = sorted(likelihood(ends_of, center, s, p) - base for s in (0, 1))
            assert sorted(got.get((node, p), (0.0, 0.0))) == pytest.approx(want, abs=1e-9), (node, p)
        totals[node] = np.array([got.get((node, p), (0.0, 0.0)) for p in range(len(REF))])

    n = 200
    weights = branch_tests.site_weights(spark, len(REF), n, seed=3)
    found = {r.node: r.support for r in branch_tests.resampled_supports(around, differences, weights, n).collect()}
    draw = lambda b, j: int(hashlib.md5(f"3:{b}:{j}".encode()).hexdigest()[:8], 16) % len(REF)
    for node, d in totals.items():
        hits = 0
        for b in range(n):
            x = d[[draw(b, j) for j in range(len(REF))]].sum(0) - d.sum(0)
            first, second = sorted([0.0, *x])[::-1][:2]
            hits += -d.sum(0).max() > first - second + branch_tests.EPSILON
        assert found[node] == pytest.approx(100 * hits / n)
    assert len(set(found.values())) > 1 or 0 < found[3] <= 100


def test_weights_add_up(spark):
    rows = branch_tests.site_weights(spark, 50, 20).groupBy("replicate").agg(F.sum("w").alias("w"), F.min("w").alias("least")).collect()
    assert len(rows) == 20 and all(r.w == 0 and r.least == -1 for r in rows)


def test_sites_alike_at_all_four_ends_are_left_out(spark, monkeypatch):
    """Only segments that can tell the three trees apart are merged: not those of the reference, one state or nothing known all around."""
    nodes = {0: (None, 0.0), 1: (0, 0.02), 2: (0, 0.03), 3: (1, 0.04), 4: (1, 0.01), 5: (2, 0.02), 6: (2, 0.015)}
    texts = {(1, 3): "ACTNACGAACGT", (1, 4): "ACTNTCGTACGT", (1, 5): "ACTNTCGTACGT", (1, 6): "ACTNTGGTACGT"}
    model = algebra.Model.of(Q.tolist(), PI.tolist())
    sums, ends, steps, lower, _, _ = both_passes(spark, model, {1: nodes}, texts, REF)
    rest, _ = passes.rest_lists(steps, lower, model, ends)
    frame = spark.createDataFrame([(1, x, p, t) for x, (p, t) in nodes.items()], "tree long, node long, parent long, length double")
    around = branch_tests.quartets(frame, passes.node_lists(lower), rest.where("node is not null"))
    merged, write = [], branch_tests.written
    monkeypatch.setattr(branch_tests, "written", lambda df: merged.append(write(df)) or merged[-1])
    found = branch_tests.site_differences(around, model, sums, ends)
    assert {r.start for r in merged[0].collect()} == {4, 5, 7}
    assert {r.pos for r in found.collect()} <= {4, 5, 7}

"""Trees: text, levels, likelihoods against brute force."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from pyspark.sql import functions as F

from tideline.operators import algebra
from tideline.operators import likelihood as lk
from tideline.operators import trees
from tideline.sources import trees as tt


def test_newick_round_trip(spark):
    text = "((a:1,b:0.5)x:0.25,'c d':1e-05,(e,f));"
    nodes = tt.newick_nodes(spark.createDataFrame([(1, text), (2, f"#NEXUS\nBEGIN TREES;\nTREE t = [&R] {text}\nEND;")], "tree long, text string"))
    got = {r.tree: r.text for r in tt.newick_text(nodes).collect()}
    assert got[1] == got[2] == "((a:1,b:0.5)x:0.25,c d:1e-05,(e,f));"
    deep = "(" * 3000 + "a" + ",b)" * 3000 + ";"
    assert len(tt.parse_newick(deep)) == 6001


@pytest.mark.parametrize("text", ["(a,b)", "(a,b));", "((a,b);", "(a:x,b);", "(a[b,c);"])
def test_newick_errors(text):
    with pytest.raises(tt.TreeError):
        tt.parse_newick(text)


def test_levels(spark):
    rows = [("r", None), ("a", "r"), ("b", "r"), ("c", "a"), ("d", "a"), ("e", "d")]
    nodes = spark.createDataFrame(rows, "node string, parent string")
    assert {r.node: r.n for r in trees.subtree_counts(nodes).collect()} == {"r": 3, "a": 2, "b": 1, "c": 1, "d": 1, "e": 1}
    assert {r.node: (r.depth, r.place) for r in trees.pre_order(nodes).collect()} == {"r": (0, 0), "a": (1, 1), "c": (2, 2), "d": (2, 3), "e": (3, 4), "b": (1, 5)}
    assert {r.node: r.parent for r in trees.reroot(nodes, "d").collect()} == {"d": None, "a": "d", "r": "a", "b": "r", "c": "a", "e": "d"}


Q = np.array([[-0.9, 0.2, 0.5, 0.2], [0.1, -1.1, 0.3, 0.7], [0.4, 0.2, -1.0, 0.4], [0.3, 0.6, 0.2, -1.1]])
PI = np.array([0.3, 0.2, 0.2, 0.3])


def test_likelihood_against_dense_recursion(spark):
    """The recursion with I + Qt over vectors, and its first-order rules: beside an unknown sibling lengths are added up, equal determined
    states stay determined at the cost of their diagonal rate, and at the root a length that is left over is not applied."""
    nodes = [(1, 0, None, None), (1, 1, 0, 0.01), (1, 2, 0, 0.02), (1, 3, 1, 0.015), (1, 4, 1, 0.01)]
    sites = list(itertools.product((1, 2, 4, 8, 15, 5), repeat=3))
    cells = [(1, n, i, b) for i, s in enumerate(sites) for n, b in zip((2, 3, 4), s, strict=True)]
    got = lk.site_likelihoods(spark.createDataFrame(nodes, "tree long, node long, parent long, length double"), spark.createDataFrame(cells, "tree long, node long, pos long, bits int"), Q.tolist(), PI.tolist(), block=50)
    found = {r.pos: r.lh for r in got.collect()}
    leaf = lambda b: np.array([(b >> k) & 1 for k in range(4)], float) / bin(b).count("1")
    move = lambda v, t: v + t * Q @ v

    def meet(a, b):
        """(vector, length above it, log-likelihood so far) of two children; None is unknown."""
        if a is None or b is None:
            return a or b
        if a[0].max() == 1 and (a[0] == b[0]).all():
            s = a[0].argmax()
            return a[0], 0.0, a[2] + b[2] + Q[s, s] * (a[1] + b[1])
        both = move(*a[:2]) * move(*b[:2])
        return both / both.sum(), 0.0, a[2] + b[2] + np.log(both.sum())

    def longer(x, t):
        return x and (x[0], x[1] + t, x[2])

    for i, (b2, b3, b4) in enumerate(sites):
        n2, n3, n4 = (None if b == 15 else (leaf(b), t, 0.0) for b, t in ((b2, 0.02), (b3, 0.015), (b4, 0.01)))
        root = meet(longer(meet(n3, n4), 0.01), n2)
        dense = 0.0 if root is None else root[2] + np.log(PI @ root[0])
        assert found[i] == pytest.approx(dense, abs=1e-6), (b2, b3, b4)


def test_a_path_of_5000_nodes(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(5000)], "node long, parent long")
    assert {r.node: r.depth for r in trees.depths(nodes).collect()} == {i: i for i in range(5000)}
    assert trees.ancestors(nodes, 4000).count() == 4001


def test_solved_lengths(spark):
    rows = [(0, -200.0, [0.001, 0.01, 0.05]), (1, -1.0, []), (2, -1.0, [0.0]), (3, -2000.0, [0.01, 0.02]), (4, -100.0, [-0.5, 0.1]), (5, -100.0, [0.0, 0.0])]
    t = {r.id: r.t for r in spark.createDataFrame(rows, "id int, k double, ratios array<double>").select("id", algebra.solved_lengths(F.col("k"), F.col("ratios"), 1e-9).alias("t")).collect()}
    assert sum(1 / (x + t[0]) for x in rows[0][2]) == pytest.approx(200, rel=1e-4)
    assert (t[1], t[2], t[3], t[4]) == (None, 0.1, None, 0.1) and t[5] == pytest.approx(0.02, abs=1e-8)


def test_algebra_against_numpy(spark):
    """Merges and costs of all kinds of runs against vectors written out."""
    m = algebra.Model.of(Q.tolist(), PI.tolist())
    kinds = [("R", None, None, None), ("C", None, None, None), ("C", 0.01, None, None), ("G", 0.01, 0.02, None), ("O", None, None, [0.1, 0.2, 0.3, 0.4]), ("O", 0.03, None, [0.0, 0.5, 0.5, 0.0]), ("N", None, None, None)]
    rows = [(i, j, a, b) for i, a in enumerate(kinds) for j, b in enumerate(kinds) if b[2] is None]
    df = spark.createDataFrame(rows, f"i int, j int, a {algebra.RUN}, b {algebra.RUN}")
    t, u, ref, same = F.lit(0.015), F.lit(0.02), F.lit("A"), F.lit(float(Q[0, 0]))
    got = df.select("i", "j", algebra.merge_lowers(m, F.col("a"), t, F.col("b"), u, ref, same).alias("low"), algebra.merge_upper_lower(m, F.col("a"), t, F.col("b"), u, ref).alias("up"), algebra.sample_cost(m, F.col("a"), F.col("b"), t, ref, same).alias("cost"), algebra.subtree_cost(m, F.col("a"), F.col("b"), t, ref).alias("sub")).collect()
    hot = lambda x: np.array(x[3]) if x[0] == "O" else np.eye(4)["ACGT".index("A" if x[0] == "R" else x[0])]
    far = lambda x, s: (x[1] or 0.0) + s
    for r in got:
        a, b = kinds[r.i], kinds[r.j]
        if "N" in (a[0], b[0]):
            assert r.cost == 0 and r.sub == 0 and (r.low.run.type == r.up.type == "N" or a[0] != b[0])
            continue
        low = (hot(a) + far(a, 0.015) * Q @ hot(a)) * (hot(b) + far(b, 0.02) * Q @ hot(b))
        if a[0] == b[0] != "O":
            k = "ACGT".index("A" if a[0] == "R" else a[0])
            assert r.low.run.type == a[0] and r.low.gain == pytest.approx(Q[k, k] * (far(a, 0.015) + far(b, 0.02)))
            assert r.up.type == a[0] and r.cost == pytest.approx(Q[k, k] * (far(a, 0.015) + (a[2] or 0)))
            continue
        assert r.low.gain == pytest.approx(np.log(low.sum())) and np.allclose(r.low.run.v, low / low.sum())
        if a[2] is None:
            above = hot(a) + far(a, 0.015) * Q.T @ hot(a)
        else:
            s = "ACGT".index(a[0])
            start = PI * (np.eye(4)[s] + a[1] * Q[:, s])
            above = start + (a[2] + 0.015) * Q.T @ start
        up = above * (hot(b) + far(b, 0.02) * Q @ hot(b))
        assert np.allclose(r.up.v, up / up.sum())
        if a[2] is None:
            can = (np.array(hot(b)) > 0.1).astype(float)
            if a[0] == "O":
                assert r.cost == pytest.approx(np.log(hot(a) @ (can + far(a, 0.015) * Q @ can)))
            elif b[0] != "O":
                assert r.cost == pytest.approx(np.log(hot(a) @ Q @ hot(b) * far(a, 0.015)))
            length = (a[1] or 0.0) + 0.015 + (b[1] or 0.0)
            assert r.sub == pytest.approx(np.log(hot(a) @ (hot(b) + length * Q @ hot(b)) if "O" in (a[0], b[0]) else hot(a) @ Q @ hot(b) * length))

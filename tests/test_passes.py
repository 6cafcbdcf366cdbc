"""Both passes over trees of any shape against a recursion site by site."""

from __future__ import annotations

import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import algebra, passes, trees

Q = np.array([[-0.9, 0.2, 0.5, 0.2], [0.1, -1.1, 0.3, 0.7], [0.4, 0.2, -1.0, 0.4], [0.3, 0.6, 0.2, -1.1]])
PI = np.array([0.3, 0.2, 0.2, 0.3])
STATES = "ACGT"


class Plain:
    """Runs of one site as (state or N or O, n, r, vector); the reference's state is a state like any other."""

    @staticmethod
    def far(x, t, root=False):
        return t if x[1] is None else x[1] + t + (x[2] or 0.0 if root and x[0] != "O" else 0.0)

    @staticmethod
    def column(x, t):
        if x[0] == "O":
            return x[3] + t * Q @ x[3] if t > 0 else x[3]
        s = STATES.index(x[0])
        out = t * Q[:, s]
        out[s] = 1 + out[s] if 1 + out[s] >= 0 else 0.25
        return out if t > 0 else np.eye(4)[s]

    @staticmethod
    def simple(v):
        v = v / v.sum()
        big = np.flatnonzero(v > 1e-8)
        return (STATES[big[0]], None, None, None) if len(big) == 1 else ("O", None, None, v)

    @classmethod
    def lowers(cls, a, t, b, u):
        if a is None or b is None:
            return None, -np.inf
        if a[0] == b[0] == "N":
            return a, 0.0
        for x, s, y in ((a, t, b), (b, u, a)):
            if y[0] == "N":
                n = cls.far(x, s)
                return (x[0], n if n > 0 and (x[0] != "O" or s > 0) else x[1] if x[0] == "O" else None, None, x[3]), 0.0
        ta, tb = cls.far(a, t), cls.far(b, u)
        if a[0] == b[0] != "O":
            s = STATES.index(a[0])
            return (a[0], None, None, None), Q[s, s] * (ta + tb)
        v = cls.column(a, ta) * cls.column(b, tb)
        return (cls.simple(v), np.log(v.sum())) if v.sum() > 0 else (None, -np.inf)

    @classmethod
    def across(cls, a, u, b, t):
        """What stands at a place with `a` above over u and `b` below over t."""
        if a is None or b is None:
            return None
        tb = cls.far(b, t)
        if a[0] == b[0] == "N":
            return a
        if a[0] == "N":
            if b[0] == "O":
                v = PI * cls.column(b, tb)
                return "O", 0.0, 0.0, v / v.sum()
            return (b[0], tb, 0.0, None) if tb > 0 else (b[0], None, None, None)
        ta = cls.far(a, u, True)
        if b[0] == "N":
            if a[0] == "O":
                return ("O", 0.0, 0.0, a[3] + ta * Q.T @ a[3]) if ta > 0 else a
            if a[2] is not None:
                return a[0], a[1], a[2] + u, None
            n = cls.far(a, u)
            return a[0], n if n > 0 else None, None, None
        if a[0] == b[0] != "O":
            return a[0], None, None, None
        fixed_a, fixed_b = a[0] != "O" and ta <= 0, b[0] != "O" and tb <= 0
        if fixed_a and fixed_b:
            return None
        if fixed_a or fixed_b:
            return (a if fixed_a else b)[0], None, None, None
        if a[0] == "O":
            above = a[3] + ta * Q.T @ a[3] if ta > 0 else a[3]
        else:
            s = STATES.index(a[0])
            if a[2] is not None:
                start = PI * cls.column((a[0], None, None, None), a[1] or 0.0)
                above = start + (a[2] + u) * Q.T @ start
            else:
                above = ta * Q[s]
                above[s] += 1
        v = above * cls.column(b, tb)
        return ("O", None, None, v / v.sum()) if "O" not in (a[0], b[0]) else cls.simple(v)

    @classmethod
    def rooted(cls, x, t):
        if x is None or x[0] == "N":
            return x
        if x[0] == "O":
            v = PI * cls.column(x, cls.far(x, t))
            return "O", x[1], x[2], v / v.sum()
        return (x[0], x[1] + t, 0.0, None) if x[1] is not None else (x[0], t, 0.0, None) if t > 0 else x


def plain_passes(nodes, leaves):
    """({node: lower}, {node: upper}, log-likelihood) of one tree (node: (parent, length)) and one site (leaf: state or N)."""
    kids = {}
    for x, (p, _) in nodes.items():
        kids.setdefault(p, []).append(x)
    size = lambda x: sum(map(size, kids[x])) if x in kids else 1
    length = lambda x: nodes[x][1]
    order = {x: sorted(k, key=lambda c: (-size(c), c))[:1] + sorted(sorted(k, key=lambda c: (-size(c), c))[1:]) for x, k in kids.items() if x is not None}
    lower, partial, gain = {}, {}, 0.0
    (root,) = kids[None]

    def up(x):
        nonlocal gain
        if x not in order:
            lower[x] = (leaves[x], None, None, None)
            return
        for c in order[x]:
            up(c)
        own, t = lower[order[x][0]], length(order[x][0])
        partial[x] = [(own, t)]
        rest = order[x][1:]
        if not rest:
            own, _ = Plain.lowers(own, t, ("N", None, None, None), 0.0)
        for c in rest:
            own, g = Plain.lowers(own, t, lower[c], length(c))
            gain, t = gain + g, 0.0
            partial[x].append((own, 0.0))
        lower[x] = own

    up(root)
    x, end = lower[root], 0.0
    if x is not None and x[0] != "N":
        end = np.log(PI @ (x[3] if x[0] == "O" else np.eye(4)[STATES.index(x[0])]))
    upper = {}

    def down(x):
        above, u, at_root = upper.get(x), length(x), x == root
        meet = lambda b, t: Plain.rooted(b, t) if at_root else Plain.across(above, u, b, t)
        others = order[x][1:]
        if not others:
            upper[order[x][0]] = meet(("N", None, None, None), 0.0)
        for i in range(len(others) - 1, -1, -1):
            side = meet(*partial[x][i])
            above = meet(lower[others[i]], length(others[i]))
            upper[others[i]], u, at_root = side, 0.0, False
            if i == 0:
                upper[order[x][0]] = above
        for c in order[x]:
            if c in order:
                down(c)

    if root in order:
        down(root)
    return lower, upper, gain + end


def runs(text, ref):
    out, i = [], 0
    kind = lambda k: "R" if text[k] == ref[k] else text[k]
    while i < len(text):
        j = i
        while kind(i) in "RN" and j + 1 < len(text) and kind(j + 1) == kind(i):
            j += 1
        out.append((i, j, kind(i)))
        i = j + 1
    return out


@pytest.fixture(scope="module")
def model():
    return algebra.Model.of(Q.tolist(), PI.tolist())


def reference(spark, ref):
    rate = np.cumsum([Q[STATES.index(c), STATES.index(c)] for c in ref])
    log_pi = np.cumsum([np.log(PI[STATES.index(c)]) for c in ref])
    sums = spark.createDataFrame([(i, c, float(a), float(b)) for i, (c, a, b) in enumerate(zip(ref, rate, log_pi, strict=True))], "pos int, ref string, rate double, log_pi double")
    return sums, sums.where(F.col("pos") == len(ref) - 1).select("rate", "log_pi")


def both_passes(spark, model, forest, texts, ref):
    sums, ends = reference(spark, ref)
    rows = [(t, x, p, l) for t, nodes in forest.items() for x, (p, l) in nodes.items()]
    steps = passes.chains(spark.createDataFrame(rows, "tree long, node long, parent long, length double"))
    regions = [(t, x, *r) for (t, x), text in texts.items() for r in runs(text, ref)]
    leaves = passes.runs_of(spark.createDataFrame(regions, "tree long, node long, start int, stop int, type string"), sums)
    lower, gains = passes.lower_lists(steps, leaves, model, ends)
    return sums, ends, steps, lower, gains, passes.upper_lists(steps, lower, model, ends)


def forest_of(rng):
    """Trees with several children, only children, branches without length, and a single node."""
    forest, leaves = {}, {}
    for tree in range(6):
        nodes, inner = {0: (None, 0.0)}, [0]
        for x in range(1, 1 if tree == 5 else 26):
            p = inner[int(rng.integers(max(0, len(inner) - 3), len(inner)))] if tree % 2 else inner[int(rng.integers(len(inner)))]
            nodes[x] = (p, float(rng.choice([0.0, 0.001, 0.01, 0.02], p=[0.15, 0.25, 0.3, 0.3])))
            if rng.random() < 0.55:
                inner.append(x)
        forest[tree] = nodes
        with_kids = {p for p, _ in nodes.values()}
        leaves[tree] = [x for x in nodes if x not in with_kids]
    return forest, leaves


def same(got, want, ref):
    if want is None or got is None:
        return want is None and got is None
    kind = ref if got.type == "R" else got.type
    close = lambda a, b: (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)
    return kind == want[0] and close(got.n, want[1]) and close(got.r, want[2]) and (kind != "O" or np.allclose(got.v, want[3], atol=1e-9))


@pytest.mark.parametrize("at_once", [512, 2])
def test_passes_against_recursion(spark, model, monkeypatch, at_once):
    monkeypatch.setattr(passes, "STEPS_AT_ONCE", at_once)
    rng = np.random.default_rng(5)
    ref = "ACGTTGCAAC"
    forest, leaves = forest_of(rng)
    texts = {(t, x): "".join(str(rng.choice(list("ACGTNN"))) if rng.random() < 0.25 else c for c in ref) for t, own in leaves.items() for x in own}
    sums, ends, steps, lower, gains, upper = both_passes(spark, model, forest, texts, ref)
    spread = lambda rows: {(r.tree, r.node, p): r.run for r in rows.collect() for p in range(r.start, r.stop + 1)}
    low, up = spread(passes.node_lists(lower)), spread(upper)
    sites = {(r.tree, r.pos): r.lh for r in passes.site_likelihoods(lower, gains, steps, model, sums, ends).collect()}
    total = {r.tree: r.lh for r in passes.tree_likelihoods(lower, gains, steps, model, ends).collect()}
    branches = passes.branch_segments(upper, passes.node_lists(lower), ends)
    counted = {(r.from_state, r.to_state): r.n for r in passes.branch_counts(branches).collect()}
    counts, whole = {}, {}
    for t, nodes in forest.items():
        for p, base in enumerate(ref):
            want_low, want_up, lh = plain_passes(nodes, {x: texts[t, x][p] for x in leaves[t]})
            whole[t] = whole.get(t, 0.0) + lh
            assert sites[t, p] == pytest.approx(lh, abs=1e-9) or np.isinf(lh) and np.isinf(sites[t, p])
            for x in nodes:
                assert same(low[t, x, p], want_low[x], base), (t, x, p, low[t, x, p], want_low[x])
                assert (x == 0) == ((t, x, p) not in up)
                if x:
                    assert same(up[t, x, p], want_up[x], base), (t, x, p, up[t, x, p], want_up[x])
                    a, b = want_up[x], want_low[x]
                    if nodes[x][1] > 0 and a and b and "N" not in a[0] + b[0] and "O" not in a[0] + b[0] and a[0] != b[0]:
                        counts[a[0], b[0]] = counts.get((a[0], b[0]), 0) + 1
    assert counted == counts
    for t in forest:
        assert total[t] == pytest.approx(whole[t], abs=1e-8) or np.isinf(whole[t]) and np.isinf(total[t])


@pytest.mark.parametrize("at_once", [512, 2])
def test_sides_of_branches_come_with_the_upper_pass(spark, model, monkeypatch, at_once):
    """Site by site what lists that are laid over again say, without that, and without the roots' own merges."""
    monkeypatch.setattr(passes, "STEPS_AT_ONCE", at_once)
    rng = np.random.default_rng(11)
    ref = "ACGTTGCA"
    forest, leaves = forest_of(rng)
    texts = {(t, x): "".join(str(rng.choice(list("ACGTNN"))) if rng.random() < 0.25 else c for c in ref) for t, own in leaves.items() for x in own}
    sums, ends, steps, lower, _, upper = both_passes(spark, model, forest, texts, ref)
    want = passes.branch_segments(upper, passes.node_lists(lower), ends)
    regions = [(t, x, *r) for (t, x), text in texts.items() for r in runs(text, ref)]
    below = passes.runs_of(spark.createDataFrame(regions, "tree long, node long, start int, stop int, type string"), sums)
    fewer, _ = passes.lower_lists(steps, below, model, ends, roots=False)
    assert fewer.where("top and depth = 0 and at > 0").isEmpty() and not lower.where("top and depth = 0 and at > 0").isEmpty()
    rounds, lay = [], passes.laid_over
    monkeypatch.setattr(passes, "laid_over", lambda *a, **k: rounds.append(1) or lay(*a, **k))
    got = passes.branch_sides(steps, fewer, model, ends)
    assert len(rounds) == sum(len(pieces) for _, pieces in passes._plan(steps))

    def spread(rows):
        shown = lambda x: x and (x.type, *[None if y is None else round(y, 9) for y in (x.n, x.r, *(x.v or []))])
        found = [((r.tree, r.node, p), (r.length, shown(r.above), shown(r.below))) for r in rows.collect() for p in range(r.start, r.stop + 1)]
        assert len(dict(found)) == len(found)
        return dict(found)

    assert spread(got) == spread(want)


def test_a_path_of_2000_nodes(spark, model):
    """A tree like a comb: a chain of 2,000 merges, a leaf beside each."""
    rng = np.random.default_rng(2)
    ref, n = "ACGT", 1000
    nodes = {0: (None, 0.0)} | {i: (i - 1, 0.001) for i in range(1, n)} | {n + i: (i, 0.001) for i in range(n - 1)} | {2 * n: (n - 1, 0.002), 2 * n + 1: (n - 1, 0.001)}
    leaves = [x for x in nodes if x >= n]
    texts = {(1, x): "".join(str(rng.choice(list("ACGTN"))) if rng.random() < 0.02 else c for c in ref) for x in leaves}
    began = time.time()
    sums, ends, steps, lower, gains, upper = both_passes(spark, model, {1: nodes}, texts, ref)
    total = passes.tree_likelihoods(lower, gains, steps, model, ends).first().lh
    assert upper.select("node").distinct().count() == len(nodes) - 1
    took = time.time() - began
    sys.setrecursionlimit(20_000)
    want = sum(plain_passes_lower(nodes, {x: texts[1, x][p] for x in leaves}) for p in range(len(ref)))
    assert total == pytest.approx(want, abs=1e-7)
    assert took < 60


def plain_passes_lower(nodes, leaves):
    """The comb's log-likelihood from its bottom up."""
    n = len([x for x in nodes if x not in leaves])
    leaf = lambda x: (leaves[x], None, None, None)
    own, gain = Plain.lowers(leaf(2 * n), 0.002, leaf(2 * n + 1), 0.001)
    for i in range(n - 2, -1, -1):
        own, g = Plain.lowers(own, nodes[i + 1][1], leaf(n + i), 0.001)
        gain += g
    return gain + (0.0 if own[0] == "N" else np.log(PI @ (own[3] if own[0] == "O" else np.eye(4)[STATES.index(own[0])])))


def test_orphans_and_cycles(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("x", "gone"), ("y", "x")], "node string, parent string")
    assert {r.node: r.depth for r in trees.depths(nodes).collect()} == {"a": 0, "b": 1, "x": 0, "y": 1}
    assert {r.node: r.n for r in trees.subtree_counts(nodes).collect()} == {"a": 1, "b": 1, "x": 1, "y": 1}
    assert {r.node for r in trees.pre_order(nodes).collect()} == {"a", "b", "x", "y"}
    ring = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", "a")], "node string, parent string")
    for call in (trees.depths, trees.subtree_counts, trees.pre_order, lambda x: trees.ancestors(x, "d")):
        with pytest.raises(ValueError, match="cycle"):
            call(ring)


def test_lists_are_laid_over_with_two_shuffles(spark):
    kind = "tree int, slot int, start int, stop int, run string, ref string, rate double, log_pi double"
    lists = {(1, 0): [(0, 3, "a"), (4, 4, "b"), (5, 9, "c")], (1, 2): [(0, 4, "d"), (5, 7, "e"), (8, 9, "f")], (1, 7): [(0, 9, "g")], (2, 3): [(0, 9, "h")]}
    rows = [(tree, slot, start, stop, run, "A" if start == stop else None, -1.0 * start, -2.0 * start) for (tree, slot), runs in lists.items() for start, stop, run in runs]
    slots, ends = trees.written(spark.createDataFrame(rows, kind)), spark.createDataFrame([(-10.0, -20.0)], "rate double, log_pi double")
    met = passes.laid_over(slots, ["tree"], ends)
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    got = {(r.tree, r.start): (r.stop, r.ref, r.rate, r.log_pi, r.same_rate, r.same_pi, [(c.slot, c.cell.run) for c in r.cells]) for r in met.collect()}
    want = {}
    for tree in (1, 2):
        own = {slot: runs for (t, slot), runs in lists.items() if t == tree}
        starts = sorted({r[0] for runs in own.values() for r in runs})
        for start, after in zip(starts, [*starts[1:], 10], strict=True):
            cells = [(slot, next(run for a, b, run in own[slot] if a <= start <= b)) for slot in sorted(own)]
            want[tree, start] = (after - 1, "A" if start == 4 else None, -1.0 * start, -2.0 * start, -1.0 * (after - start), -2.0 * (after - start), cells)
    assert got == want


def test_few_lists_are_laid_over_with_one_shuffle(spark):
    kind = "tree int, slot int, start int, stop int, run string, ref string, rate double, log_pi double"
    lists = {(1, 0): [(0, 3, "a"), (4, 4, None), (5, 9, "c")], (1, 2): [(0, 4, "d"), (5, 7, "e"), (8, 9, "f")], (1, 7): [(0, 9, "g")], (2, 2): [(0, 0, "h"), (1, 9, "i")]}
    rows = [(tree, slot, start, stop, run, "A" if start == stop else None, -1.0 * start, -2.0 * start) for (tree, slot), runs in lists.items() for start, stop, run in runs]
    slots, ends = trees.written(spark.createDataFrame(rows, kind)), spark.createDataFrame([(-10.0, -20.0)], "rate double, log_pi double")
    met = passes.laid_over(slots, ["tree"], ends, [0, 2, 3, 7])
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    by_name = lambda rows: sorted(rows.select("tree", "start", "stop", "cells", "ref", "rate", "log_pi", "same_rate", "same_pi").collect(), key=lambda r: (r.tree, r.start))
    # an impossible run is null and hides the one before it
    assert by_name(met) == by_name(passes.laid_over(slots, ["tree"], ends)) and by_name(met)[1].cells[0].cell.run is None


def test_lists_go_to_their_merges_without_joins(spark, model, monkeypatch):
    """The plan of each round deals lists and steps, one shuffle each, however many chains hang on others."""
    nodes = {0: (None, 0.0), 1: (0, 0.02), 2: (0, 0.03), 3: (1, 0.04), 4: (1, 0.01), 5: (2, 0.02), 6: (2, 0.015)}
    texts = {(1, x): text for x, text in ((3, "ACGA"), (4, "ACTT"), (5, "NCGT"), (6, "ACGT"))}
    rounds, write = [], passes.written

    def counting(df):
        if {"run", "start"} <= set(df.columns) or "s" in df.columns:
            plan = df._jdf.queryExecution().executedPlan().toString()
            rounds.append(("Generate" in plan, plan.count("Exchange hashpartitioning")))
        return write(df)

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(passes, "written", counting)
    try:
        both_passes(spark, model, {1: nodes}, texts, "ACGT")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    folds = [n for folded, n in rounds if folded]
    assert len(folds) == 4 and max(folds) == 2


def test_values_that_are_looked_at_often_are_worked_out_once(spark):
    """Lambdas share nothing, so an operand that stands in an expression twice is worked out twice for each state."""
    m = algebra.Model.of(Q.tolist(), PI.tolist())
    once = lambda x: str(x._jc.toString()).count("operand")
    operand, t = F.col("operand"), F.lit(0.1)
    assert once(algebra.normalized(operand)) == once(algebra.carried(m, operand, t)) == once(algebra.evolved(m, operand, t)) == 1
    assert once(algebra.column_of(m, operand, t)) == once(algebra.row_of(m, operand, t)) == 1

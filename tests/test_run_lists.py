"""Lists of runs compared within limits, merged within limits, and trees with the root moved onto a branch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tideline.operators import algebra, segments, trees

KIND = f"k int, start int, stop int, run {algebra.RUN}"


def lists(spark, *rows):
    """Rows (k, start, stop, type, n, r, v)."""
    return spark.createDataFrame([(k, a, b, (t, n, r, v)) for k, a, b, t, n, r, v in rows], KIND)


def test_lists_within_limits(spark):
    left, right, close, far = [], [], set(), set()
    cases = [  # a, b, equal within 0.01, changed
        (("R", 0.5, None, None), ("R", 0.505, None, None), True, False),
        (("R", 0.5, None, None), ("R", 0.52, None, None), False, True),
        (("R", 0.5, 0.1, None), ("R", 0.5, None, None), False, True),
        (("A", 0.5, 0.1, None), ("C", 0.5, 0.1, None), False, True),
        (("N", 0.5, None, None), ("N", 0.9, None, None), False, False),
        (("O", 0.5, None, [0.2, 0.8]), ("O", 0.5, None, [0.205, 0.795]), True, False),
        (("O", 0.5, None, [0.2, 0.8]), ("O", 0.5, None, [0.26, 0.74]), False, True),
        (("O", 0.5, None, [0.0, 1.0]), ("O", 0.5, None, [0.001, 0.999]), True, True),
        (("O", 0.5, None, [0.015, 0.985]), ("O", 0.5, None, [0.0, 1.0]), False, True),
        (("O", 0.5, None, [0.5]), ("O", 0.5, None, None), False, True),
    ]
    for k, (a, b, equal, changed) in enumerate(cases):
        left.append((k, 0, 9, *a))
        right.append((k, 0, 9, *b))
        close |= {k} if equal else set()
        far |= {k} if changed else set()
    left += [(20, 0, 4, "R", None, None, None), (20, 5, 9, "R", None, None, None), (21, 0, 9, "R", None, None, None)]
    right += [(20, 0, 9, "R", None, None, None), (22, 0, 9, "R", None, None, None)]
    a, b = lists(spark, *left), lists(spark, *right)
    assert {r.k for r in segments.equal_lists(a, b, ["k"], 0.01).where("equal").collect()} == close
    got = {r.k: (r.n_changed, r.changed) for r in segments.changed_lists(a, b, ["k"], limit=0.01, update=0.05).collect()}
    assert {k for k, (_, changed) in got.items() if changed} == far | {20, 21, 22}
    assert got[20] == (0, True) and got[21] == got[22] == (1, True)


def test_neighbours_merge_by_the_run_before(spark):
    rows = [(1, k, k, "R", 0.1 * k, None, None) for k in range(5)] + [(1, 5, 5, "R", 0.9, None, None), (1, 6, 6, "A", 0.9, None, None), (1, 7, 7, "A", 0.9, None, None), (1, 8, 8, "R", 0.9, 0.1, None), (1, 9, 9, "R", 0.9, None, None)]
    got = sorted((r.start, r.stop, r.run.type, r.run.n) for r in segments.coalesce_within(lists(spark, *rows), ["k"], 0.15).collect())
    assert got == [(0, 4, "R", 0.4), (5, 5, "R", 0.9), (6, 6, "A", 0.9), (7, 7, "A", 0.9), (8, 8, "R", 0.9), (9, 9, "R", 0.9)]
    assert segments.coalesce_within(lists(spark), ["k"], 0.15).count() == 0


@pytest.fixture(scope="module")
def pair(spark):
    """(((d, e)b, c)a, x)r"""
    rows = [("r", None, None, None), ("a", "r", 1.0, "ra"), ("x", "r", 2.0, "rx"), ("b", "a", 3.0, "ab"), ("c", "a", 4.0, "ac"), ("d", "b", 5.0, "bd"), ("e", "b", None, "be")]
    return spark.createDataFrame(rows, "node string, parent string, length double, note string")


def rows_of(df):
    return {r.node: (r.parent, r.length, r.note) for r in df.select("node", "parent", "length", "note").collect()}


def test_root_of_two_children_moves(pair):
    got = rows_of(trees.reroot_branch(pair, "d", notes=("note",)))
    assert got == {"r": (None, None, None), "d": ("r", 2.5, "bd"), "b": ("r", 2.5, "bd"), "a": ("b", 3.0, "ab"), "x": ("a", 3.0, "rx"), "c": ("a", 4.0, "ac"), "e": ("b", None, "be")}
    assert sum(v[1] or 0 for v in got.values()) == 15
    assert rows_of(trees.reroot_branch(pair, "x", notes=("note",))) == rows_of(pair) == rows_of(trees.reroot_branch(pair, "r"))
    e = rows_of(trees.reroot_branch(pair, "e", 0.5, None, ("note",)))
    assert e["e"] == ("r", None, "be") and e["b"] == ("r", None, "be")


def test_root_of_three_children_stays(spark, pair):
    more = pair.union(spark.createDataFrame([("y", "r", 6.0, "ry")], pair.schema))
    got = rows_of(trees.reroot_branch(more, "b", 0.25, "top", ("note",)))
    assert got["top"] == (None, None, None) and got["b"] == ("top", 0.75, "ab") and got["a"] == ("top", 2.25, "ab") and got["r"] == ("a", 1.0, "ra")
    assert got["x"] == ("r", 2.0, "rx") and got["y"] == ("r", 6.0, "ry") and sum(v[1] or 0 for v in got.values()) == 21
    with pytest.raises(ValueError, match="name the new one"):
        trees.reroot_branch(more, "b")
    with pytest.raises(ValueError, match="no node"):
        trees.reroot_branch(more, "nobody")
    other = more.withColumn("seq", F.col("node"))
    assert {r.node: r.seq for r in trees.reroot_branch(other, "d", 0.5, "top").collect()} == {**{n: n for n in "rabcdexy"}, "top": None}

"""Tree likelihoods by first-order transitions, in parallel over trees and blocks of sites.

Sites are independent given tree and model, so a task takes one tree and one block of sites, and all sites of the
block go through the tree together as arrays. A site of a node is unknown, in one determined state, or a vector; a
determined state remembers how far below it was seen, and lengths are added up instead of multiplied out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN, STATE, VECTOR = 0, 1, 2
#: Below this a likelihood counts as zero when a vector is simplified.
THRESHOLD = 1e-8
IMPOSSIBLE = -np.inf


@dataclass
class Sites:
    """What lies below a node, by site: kind, state, length since it was seen (-1: none), vector."""

    kind: np.ndarray
    state: np.ndarray
    length: np.ndarray
    vector: np.ndarray

    @classmethod
    def of(cls, bits: np.ndarray) -> Sites:
        """Leaves from bit sets of possible states (A=1, C=2, G=4, T=8; 15 is unknown)."""
        one = (bits & (bits - 1)) == 0
        kind = np.where(bits == 15, UNKNOWN, np.where(one, STATE, VECTOR))
        vector = ((bits[:, None] >> np.arange(4)) & 1).astype(float)
        vector /= np.maximum(vector.sum(1, keepdims=True), 1)
        return cls(kind, np.where(one, vector.argmax(1), 0), np.full(len(bits), -1.0), vector)


def _reach(x: Sites, t: float) -> np.ndarray:
    return np.where(x.length >= 0, x.length + max(t, 0.0), t)


def _moved(x: Sites, reach: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Likelihood of each state at the upper end of a branch, given what lies below: (I + reach Q) applied; probabilities that
    would be negative become 0.25, and a reach of 0 changes nothing."""
    reach = np.maximum(reach, 0)[:, None]
    mixed = x.vector + reach * (x.vector @ q.T)
    column = q[:, x.state].T * reach
    rows = np.arange(len(x.state))
    stay = 1 + column[rows, x.state]
    column[rows, x.state] = np.where(stay < 0, 0.25, stay)
    return np.where((x.kind == STATE)[:, None], column, mixed)


def merge_lowers(a: Sites, t_a: float, b: Sites, t_b: float, q: np.ndarray) -> tuple[Sites, np.ndarray]:
    """What lies below a node with two children at distances t_a and t_b, and the log-likelihood gained at each site."""
    n = len(a.kind)
    out = Sites(np.zeros(n, int), np.zeros(n, int), np.full(n, -1.0), np.zeros((n, 4)))
    gain = np.zeros(n)
    reach_a, reach_b = _reach(a, t_a), _reach(b, t_b)
    for x, reach, t, other in ((a, reach_a, t_a, b), (b, reach_b, t_b, a)):
        only = (other.kind == UNKNOWN) & (x.kind != UNKNOWN)
        keep = np.where((x.kind == VECTOR) & (t <= 0), x.length, reach)
        out.kind[only], out.state[only], out.vector[only] = x.kind[only], x.state[only], x.vector[only]
        out.length[only] = np.where(keep[only] > 0, keep[only], -1)
    known = (a.kind != UNKNOWN) & (b.kind != UNKNOWN)
    both = known & (a.kind == STATE) & (b.kind == STATE)
    same = both & (a.state == b.state)
    out.kind[same], out.state[same] = STATE, a.state[same]
    diagonal = np.diag(q)
    gain[same] = (diagonal[a.state] * (np.maximum(reach_a, 0) + np.maximum(reach_b, 0)))[same]
    mixed = known & ~same
    product = _moved(a, reach_a, q) * _moved(b, reach_b, q)
    total = product.sum(1)
    never = mixed & (total <= 0)
    gain[mixed] = np.log(np.maximum(total[mixed], 1e-300))
    gain[never] = IMPOSSIBLE
    vector = product / np.where(total > 0, total, 1)[:, None]
    single = (vector > THRESHOLD).sum(1) == 1
    out.kind[mixed] = np.where(single, STATE, VECTOR)[mixed]
    out.state[mixed] = vector.argmax(1)[mixed]
    out.vector[mixed] = vector[mixed]
    fixed = out.kind == STATE
    out.vector[fixed] = np.eye(4)[out.state[fixed]]
    return out, gain


def at_root(x: Sites, pi: np.ndarray) -> np.ndarray:
    """Log-likelihood of what lies below the root."""
    p = np.where(x.kind == STATE, pi[x.state], x.vector @ pi)
    return np.where(x.kind == UNKNOWN, 0.0, np.log(np.maximum(p, 1e-300)))


def tree_sites(nodes: pd.DataFrame, leaves: dict[int, np.ndarray], q: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Log-likelihood of each site. Nodes (node, parent, length) are of one tree; a node of more than two children is a
    chain of zero lengths."""
    kids: dict[int, list[tuple[int, float]]] = {}
    root = None
    for r in nodes.sort_values("node").itertuples():
        if pd.isna(r.parent):
            root = int(r.node)
        else:
            kids.setdefault(int(r.parent), []).append((int(r.node), 0.0 if pd.isna(r.length) else float(r.length)))
    width = len(next(iter(leaves.values())))
    total, done = np.zeros(width), {}
    stack = [(root, False)]
    while stack:
        x, ready = stack.pop()
        if x not in kids:
            done[x] = Sites.of(leaves.get(x, np.full(width, 15)))
        elif not ready:
            stack += [(x, True), *[(k, False) for k, _ in kids[x]]]
        else:
            (first, length), *rest = kids[x]
            own = done.pop(first)
            for k, t in rest:
                own, gain = merge_lowers(own, length, done.pop(k), t, q)
                total, length = total + gain, 0.0
            if not rest:  # an only child: its length stays with it
                own = Sites(own.kind, own.state, np.where(own.kind == UNKNOWN, -1, _reach(own, length)), own.vector)
            done[x] = own
    return total + at_root(done[root], pi)


def site_likelihoods(nodes: DataFrame, cells: DataFrame, q: list[list[float]], pi: list[float], block: int = 4096) -> DataFrame:
    """(tree, pos, lh) for nodes (tree, node, parent, length) and leaf sites (tree, node, pos, bits).

    Trees are co-grouped with blocks of their sites; a tree is copied once per block."""
    q_, pi_ = np.array(q), np.array(pi)
    cells = cells.withColumn("block", F.floor(F.col("pos") / block))
    blocks = cells.select("tree", "block").distinct()
    copies = nodes.join(blocks, "tree").select("tree", "block", "node", "parent", "length").toDF("in_tree", "in_block", "node", "parent", "length")

    def run(key: tuple, sites: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if sites.empty or tree.empty:
            return pd.DataFrame({"tree": [], "pos": [], "lh": []}).astype({"tree": "int64", "pos": "int64", "lh": "float64"})
        where = np.sort(sites["pos"].unique())
        leaves = {}
        for node, own in sites.groupby("node"):
            bits = np.full(len(where), 15)
            bits[np.searchsorted(where, own["pos"].to_numpy())] = own["bits"].to_numpy()
            leaves[int(node)] = bits
        return pd.DataFrame({"tree": key[0], "pos": where.astype("int64"), "lh": tree_sites(tree, leaves, q_, pi_)})

    return cells.groupBy("tree", "block").cogroup(copies.groupBy("in_tree", "in_block")).applyInPandas(run, "tree long, pos long, lh double")

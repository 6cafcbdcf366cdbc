"""A path-compressed prefix tree over ordered sets, and Jaccard search in it."""

from __future__ import annotations

import numpy as np


class PrefixTree:
    """Sets of small integers, each in ascending order, stored with common beginnings shared.

    Every node has the run of elements that leads to it (flat[begin:end]), its depth after that run, the range of
    sets below it in lexicographic order, and the sizes of the smallest and largest of those sets.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = np.array(sorted(range(len(sets)), key=keys.__getitem__))
        ordered = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in ordered])
        common = [0]
        for x, y in zip(ordered, ordered[1:], strict=False):
            n = min(len(x), len(y))
            differ = np.flatnonzero(x[:n] != y[:n])
            common.append(int(differ[0]) if len(differ) else n)
        # nodes as (first set, depth above, depth, parent); a stack holds the path to the last set
        first, above, depth, parent, last = [0], [0], [0], [-1], [0]
        path = [0]
        for i in range(len(ordered)):
            d = common[i]
            popped = -1
            while depth[path[-1]] > d:
                popped = path.pop()
                last[popped] = i
            if depth[path[-1]] < d:  # split the run of the node popped last
                first.append(first[popped])
                above.append(above[popped])
                depth.append(d)
                parent.append(parent[popped])
                last.append(0)
                above[popped], parent[popped] = d, len(first) - 1
                path.append(len(first) - 1)
            top = path[-1]
            first.append(i)
            above.append(d)
            depth.append(len(ordered[i]))
            parent.append(top)
            last.append(0)
            path.append(len(first) - 1)
        for node in path:
            last[node] = len(ordered)
        # in preorder, the nodes, sets and elements below a node are each one range
        order = np.lexsort((depth, first))
        self.lo, self.hi, self.depth = np.array(first)[order], np.array(last)[order], np.array(depth)[order]
        self.length = self.depth - np.array(above)[order]
        runs = [ordered[f][d - n : d] for f, d, n in zip(self.lo, self.depth, self.length, strict=True)]
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.concatenate(runs)
        self.node_end = np.searchsorted(self.lo, self.hi, side="left")
        self.flat_end = np.append(self.begin, len(self.flat))[self.node_end]
        edges = np.stack([self.lo, self.hi], 1).ravel()
        padded = np.append(self.size, self.size[-1])
        self.smallest, self.largest = np.minimum.reduceat(padded, edges)[::2], np.maximum.reduceat(padded, edges)[::2]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        up = np.where(np.array(parent)[order] < 0, -1, place[np.array(parent)[order]])
        self.children = np.argsort(up, kind="stable")
        counts = np.bincount(up + 1, minlength=len(up) + 1)
        self.child_end = np.cumsum(counts)[1:]
        self.child_begin = self.child_end - counts[1:]

    @staticmethod
    def _spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        total = int(length.sum())
        return np.repeat(begin - np.cumsum(length) + length, length) + np.arange(total)

    def similar(self, query: np.ndarray, inside: np.ndarray, percent: int, skip: np.ndarray) -> np.ndarray:
        """Places (in lexicographic order) of the sets whose Jaccard similarity with `query` is at least `percent` / 100.

        inside: for every element, whether the query holds it. Sets at places where `skip` is true need not be found.
        The walk goes down from the root level by level and carries the overlap on each path, so sets with a common
        beginning share it. A subtree is left when the overlap so far and all that may remain cannot reach what its
        smallest set needs. Below LEVELS, what is left of the tree is finished in one sweep: each node adds its own
        overlap, counted once, to the range of sets below it.
        """
        wanted = np.concatenate([[0], np.cumsum(~skip)])
        nodes, before = np.array([0]), np.array([0])
        found = []
        n = len(query)
        for level in range(LEVELS + 1):
            if level == LEVELS or self.flat_end[nodes].sum() - self.begin[nodes].sum() <= SWEEP:
                found.append(self._sweep(nodes, before, n, inside, percent))
                break
            length = self.length[nodes]
            counts = np.concatenate([[0], np.cumsum(inside[self.flat[self._spread(self.begin[nodes], length)]])])
            ends = np.cumsum(length)
            overlap = before + counts[ends] - counts[ends - length]
            depth = self.depth[nodes]
            hit = (depth == self.smallest[nodes]) & (length > 0) & ((100 + percent) * overlap >= percent * (n + depth))
            for node in nodes[hit]:
                own = np.arange(self.lo[node], self.hi[node])
                found.append(own[self.size[own] == self.depth[node]])
            tail = self.flat[np.maximum(self.begin[nodes] + length - 1, 0)]
            rest = np.where(nodes == 0, n, n - np.searchsorted(query, tail, side="right"))
            most = overlap + np.minimum(rest, self.largest[nodes] - depth)
            alive = (100 + percent) * most >= percent * (n + np.maximum(self.smallest[nodes], most))
            alive &= wanted[self.hi[nodes]] > wanted[self.lo[nodes]]
            nodes, overlap = nodes[alive], overlap[alive]
            fan = self.child_end[nodes] - self.child_begin[nodes]
            nodes, before = self.children[self._spread(self.child_begin[nodes], fan)], np.repeat(overlap, fan)
            if not len(nodes):
                break
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def _sweep(self, roots: np.ndarray, before: np.ndarray, n: int, inside: np.ndarray, percent: int) -> np.ndarray:
        """The similar sets below some nodes, given the overlap above each."""
        below = self.node_end[roots] - roots
        nodes = self._spread(roots, below)
        counts = np.concatenate([[0], np.cumsum(inside[self.flat[self._spread(self.begin[roots], self.flat_end[roots] - self.begin[roots])]])])
        ends = np.cumsum(self.length[nodes])
        gain = counts[ends] - counts[ends - self.length[nodes]]
        gain[np.cumsum(below) - below] += before
        change = np.zeros(len(self.size) + 1, np.int64)
        np.add.at(change, self.lo[nodes], gain)
        np.add.at(change, self.hi[nodes], -gain)
        overlap = np.cumsum(change[:-1])
        return np.flatnonzero((overlap > 0) & ((100 + percent) * overlap >= percent * (n + self.size)))


#: Levels that are walked one by one, and the number of elements left from which one sweep is cheaper.
LEVELS, SWEEP = 6, 2048


def link_forest(sets: list[np.ndarray], percent: int, probes: list[int] | None = None, stored: list[int] | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect the same sets as all links do, at most one less than there are sets. Sets of equal labels in `known` are
    connected already; then there are fewer links than labels.

    Elements are ordered by how many of these sets hold them, most common first, which is one order for all sets here
    and lets similar sets share long beginnings. Only `probes` are looked up among `stored` (default: all).
    """
    probes = list(range(len(sets))) if probes is None else probes
    stored = list(range(len(sets))) if stored is None else stored
    if not probes or not stored or (known is not None and (known == known[0]).all()):
        return []
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(values))
    ends = np.cumsum([len(s) for s in sets])
    ranked = [np.sort(rank[place[e - len(s) : e]]) for s, e in zip(sets, ends, strict=True)]
    tree = PrefixTree([ranked[i] for i in stored])
    owner = np.array(stored)[tree.order]
    group = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    inside = np.zeros(len(values), bool)
    links = []
    for i in probes:
        skip = group[owner] == group[i]
        if skip.all():
            continue
        inside[ranked[i]] = True
        for j in owner[tree.similar(ranked[i], inside, percent, skip)]:
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                links.append((i, int(j)))
        inside[ranked[i]] = False
    return links

"""An R-tree over count vectors, for joins on a bound of the overlap.

A point holds the number of a set's tokens in each hash group. Two sets share at most the sum
of the coordinate minima, and a set shares at most that sum with the upper corner of a node
that holds the other's point. Nodes whose bound stays below the overlap that the similarity
asks for are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 32
FAN = 16


def least_overlap(first: np.ndarray, second: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap of sets of these sizes whose similarity reaches ``percent`` / 100."""
    # 100 * o >= percent * (a + b - o)
    return -(-(percent * (first + second)) // (100 + percent))


def overlap_bound(point: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.minimum(point, others).sum(axis=-1)


class CountTree:
    """A packed tree: leaves of ``LEAF`` points, nodes of ``FAN`` children, over (sizes, points)."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray) -> None:
        spread = points.std(axis=0)
        widest = np.argsort(-spread)[:2]
        self.order = np.lexsort((points[:, widest[-1]], points[:, widest[0]], sizes))
        self.sizes, self.points = sizes[self.order], points[self.order]
        #: From leaves to root: upper corners, smallest and largest set size of each node.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        corners, low, high, step = self.points, self.sizes, self.sizes, LEAF
        while True:
            cuts = np.arange(0, len(low), step)
            corners = np.maximum.reduceat(corners, cuts, axis=0)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((corners, low, high))
            step = FAN
            if len(low) == 1:
                break

    def search(self, size: int, point: np.ndarray, percent: int) -> np.ndarray:
        """Places (of the input order) of all points that may reach the similarity."""
        nodes = np.zeros(1, dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            corners, low, high = self.levels[depth]
            fits = (high[nodes] * 100 >= percent * size) & (low[nodes] * percent <= 100 * size)
            nodes = nodes[fits]
            # The least overlap grows with the other set, so a node is judged by its smallest.
            need = least_overlap(np.maximum(low[nodes], -(-percent * size // 100)), size, percent)
            nodes = nodes[overlap_bound(point, corners[nodes]) >= need]
            if not len(nodes):
                return nodes
            width, count = (FAN, len(self.levels[depth - 1][1])) if depth else (LEAF, len(self.sizes))
            nodes = (nodes[:, None] * width + np.arange(width)).ravel()
            nodes = nodes[nodes < count]
        sizes = self.sizes[nodes]
        fits = (sizes * 100 >= percent * size) & (sizes * percent <= 100 * size)
        nodes = nodes[fits]
        bound = overlap_bound(point, self.points[nodes])
        return self.order[nodes[bound >= least_overlap(self.sizes[nodes], size, percent)]]


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """Counts over fewer groups, from those over a multiple of them."""
    return point.reshape(-1, groups).sum(axis=0)


def partners(sizes: np.ndarray, points: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j) whose bound reaches the similarity, each pair once; points may differ in length."""
    lengths = np.array([len(p) for p in points])
    if len(points) == 2:  # the smallest tree is its one pair
        groups = int(lengths.min())
        fits = 100 * sizes.min() >= percent * sizes.max()
        if fits and overlap_bound(folded(points[0], groups), folded(points[1], groups)) >= least_overlap(*sizes, percent):
            yield 0, np.array([1])
        return
    for groups in sorted(set(lengths.tolist())):
        own = np.flatnonzero(lengths == groups)
        # Similar sets differ in size by less than two, so in groups by at most one step.
        near = np.flatnonzero((lengths == groups) | (lengths == 2 * groups))
        table = np.stack([folded(points[n], groups) for n in near]).astype(np.int32)
        tree = CountTree(sizes[near], table)
        for i, at in zip(own.tolist(), np.searchsorted(near, own).tolist(), strict=True):
            found = near[tree.search(int(sizes[i]), table[at], percent)]
            found = found[(lengths[found] > groups) | (found > i)]
            if len(found):
                yield i, found


def joined(sizes: np.ndarray, points: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """The pairs (i, j), i < j, of ``partners``."""
    for i, found in partners(sizes, points, percent):
        for j in found.tolist():
            yield (i, j) if i < j else (j, i)

"""BK-trees over 64-bit fingerprints: children keyed by their Hamming distance to the parent."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np


class BKTree:
    """A node is an index into ``points``; ``edges[i]`` maps a distance to the child of ``i``."""

    def __init__(self) -> None:
        self.points: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, point: int) -> int:
        """The node of ``point``, a new one unless it is there already."""
        points, edges = self.points, self.edges
        at = 0
        while points:
            d = (points[at] ^ point).bit_count()
            if not d:
                return at
            if (child := edges[at].get(d)) is None:
                edges[at][d] = len(points)
                break
            at = child
        points.append(point)
        edges.append({})
        return len(points) - 1

    def path(self, point: int) -> Iterator[tuple[int, int]]:
        """The nodes that adding ``point`` passes, each with its distance."""
        at = 0 if self.points else None
        while at is not None:
            d = (self.points[at] ^ point).bit_count()
            yield at, d
            at = self.edges[at].get(d) if d else None

    def within(self, point: int, radius: int) -> Iterator[int]:
        """Nodes at most ``radius`` from ``point``: only edges within the radius are followed."""
        if not self.points:
            return
        points, edges, stack = self.points, self.edges, [0]
        while stack:
            at = stack.pop()
            d = (points[at] ^ point).bit_count()
            if d <= radius:
                yield at
            children = edges[at]
            if len(children) > 2 * radius + 1:
                stack += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
            else:
                stack += [c for e, c in children.items() if d - radius <= e <= d + radius]

    def met(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """``within`` of many points: a row for each query, and a column for each node, true where it is met.

        The tree is searched level by level; a subtree is left when no query follows its edge.
        """
        points = np.array(self.points, np.uint64)
        found = np.zeros((len(queries), len(points)), bool)
        level, alive = np.arange(min(1, len(points))), np.ones((len(queries), min(1, len(points))), bool)
        while len(level):
            d = np.bitwise_count(queries[:, None] ^ points[level]).astype(np.int8)
            found[:, level] = alive & (d <= radius)
            below = [(child, k, e) for k, at in enumerate(level.tolist()) for e, child in self.edges[at].items()]
            level, parent, edge = np.array(below, np.int64).reshape(-1, 3).T
            alive = alive[:, parent] & (np.abs(d[:, parent] - edge.astype(np.int8)) <= radius)
            followed = alive.any(axis=0)
            level, alive = level[followed], alive[:, followed]
        return found


def tree_links(points: Iterable[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``points``: at most one link per point."""
    tree, up, out = BKTree(), [], []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for point in points:
        tops = {top(i) for i in tree.within(point, radius)}
        node = tree.add(point)
        if node < len(up):
            continue
        up.append(node)
        for t in tops:
            up[t] = node
            out.append((point, tree.points[t]))
    return out


def spread(points: np.ndarray) -> np.ndarray:
    """The same points in a fixed shuffled order, so that trees stay shallow."""
    with np.errstate(over="ignore"):
        return points[np.argsort(points * np.uint64(0x9E3779B97F4A7C15), kind="stable")]

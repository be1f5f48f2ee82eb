"""A geometric near-neighbour access tree over a small set of integer vectors, asked for many queries at once.

A node picks split points far from each other and gives every other entry to its nearest one. For each pair (split i,
child j) it stores the range of distances from i to the entries of child j. A query that is at distance d of split i and
has found an entry at distance r can leave child j out if the range lies wholly beyond [d - r, d + r]. Distances between
integer vectors are compared as exact squares; only ranges are floating point, and these are widened, so that a child
is left out only where its entries are strictly farther. Entries at equal distance therefore stay, and the lowest index wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Relative widening of every rounded distance, far above the error of a square root and a subtraction.
MARGIN = 1e-9
FAN_OUT = 16
LEAF = 8


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` to the rows of ``b``; exact where ``exact_type`` chose their type."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def exact_type(largest: int, columns: int) -> type:
    """The fastest type in which squared distances of integers up to ``largest`` are exact."""
    bound = 4 * max(1, columns) * (int(largest) + 1) ** 2
    return np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object


def largest(*values: np.ndarray) -> int:
    return max((max(abs(int(v.max())), abs(int(v.min()))) for v in values if v.size), default=0)


@dataclass
class Node:
    """at: the entries that are split points here, or all entries of a leaf."""

    at: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    children: list[Node | None] | None = None


class Gnat:
    def __init__(self, entries: np.ndarray, fan_out: int = FAN_OUT, leaf: int = LEAF) -> None:
        self.entries, self.fan_out, self.leaf = np.asarray(entries), fan_out, leaf
        self.top = largest(self.entries)
        self.kind = exact_type(self.top, self.entries.shape[1])
        self.root = self._node(np.arange(len(self.entries)))

    def _node(self, at: np.ndarray) -> Node:
        if len(at) <= max(self.leaf, self.fan_out):
            return Node(at)
        points = self.entries[at].astype(self.kind)
        chosen, gaps = [0], []
        while True:
            gaps.append(squares(points[chosen[-1:]], points)[0])
            nearest = np.min(gaps, axis=0)
            far = int(np.argmax(nearest))
            if len(chosen) == self.fan_out or nearest[far] == 0:
                break
            chosen.append(far)
        if len(chosen) == 1:  # all equal: no split tells them apart
            return Node(at)
        gaps = np.asarray(gaps)
        owner = np.argmin(gaps, axis=0)
        rest = np.ones(len(at), bool)
        rest[chosen] = False
        n = len(chosen)
        low, high, children = np.full((n, n), np.inf), np.full((n, n), -np.inf), []
        root = np.sqrt(gaps.astype(float))
        for j in range(n):
            mine = np.flatnonzero(rest & (owner == j))
            if len(mine):
                low[:, j] = root[:, mine].min(axis=1) * (1 - MARGIN)
                high[:, j] = root[:, mine].max(axis=1) * (1 + MARGIN)
            children.append(self._node(at[mine]) if len(mine) else None)
        return Node(at[chosen], low, high, children)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each query, the lowest index of those at equal distance."""
        kind = exact_type(max(self.top, largest(queries)), self.entries.shape[1])
        asked, entries = queries.astype(kind), self.entries.astype(kind)
        best = np.full(len(asked), -1, np.int64)
        gap = np.zeros(len(asked), kind)

        def visit(node: Node, rows: np.ndarray) -> None:
            found = squares(asked[rows], entries[node.at])
            order = np.argsort(node.at, kind="stable")  # the first of equal ones is the lowest index
            k = order[np.argmin(found[:, order], axis=1)]
            near, index = found[np.arange(len(rows)), k], node.at[k]
            better = (best[rows] < 0) | (near < gap[rows]) | ((near == gap[rows]) & (index < best[rows]))
            best[rows[better]], gap[rows[better]] = index[better], near[better]
            if node.children is None:
                return
            root = np.sqrt(found.astype(float))
            bound = np.full(root.shape, -np.inf)
            for i in range(root.shape[1]):
                d = root[:, i, None]
                np.maximum(bound, np.maximum(node.low[i] - d * (1 + MARGIN), d * (1 - MARGIN) - node.high[i]), out=bound)
            own = np.argmin(found, axis=1)
            for own_pass in (True, False):  # first the child of the nearest split, which shortens the reach for the others
                for j, child in enumerate(node.children):
                    if child is None:
                        continue
                    mine = np.flatnonzero((own == j) == own_pass)
                    reach = np.sqrt(gap[rows[mine]].astype(float)) * (1 + MARGIN)
                    mine = mine[bound[mine, j] <= reach]
                    if len(mine):
                        visit(child, rows[mine])

        if len(asked):
            visit(self.root, np.arange(len(asked)))
        return best, gap

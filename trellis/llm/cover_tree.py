"""A cover tree over norm-augmented vectors, for exact searches by inner product.

A vector x gets one more coordinate, sqrt(M^2 - |x|^2) for the largest norm M, and a query gets 0 there.  Then
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so a ball around c' with radius r bounds the inner products of everything in it
from both sides by the distance d of q' and c'::

    (|q|^2 + M^2 - (d + r)^2) / 2  <=  q.x  <=  (|q|^2 + M^2 - max(0, d - r)^2) / 2

Levels halve the covering radius: the children of a node are its own centre and points more than the child radius
apart, so that every point of the node is within that radius of one of them.  A node keeps the true covering radius
of its points, points that are alone under their centre stay with the parent, and small or point-like nodes are leaves.

Search.  Queries go down together, best bound first.  A node is skipped for every query whose windows lie outside its
bounds or whose results are all at least as good; what is left of its points is verified with exact integer scores.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

#: Points up to which a node is not divided.
LEAF = 64
#: Possible centres whose distances are computed together.
CENTRES = 256
#: Scores below this are exact as floating-point sums of products.
EXACT = 1 << 52
#: A hundred times a score must fit into a long.
LARGEST = 1 << 56


@dataclass
class Tree:
    """Points in the tree's order, and its nodes: centre, radius, own points, children."""

    points: np.ndarray
    order: np.ndarray
    largest: float
    centres: np.ndarray
    radii: np.ndarray
    own: np.ndarray
    below: np.ndarray


@dataclass
class _Node:
    centre: int
    radius: float
    points: np.ndarray
    children: list[_Node] = field(default_factory=list)


def augmented(points: np.ndarray) -> tuple[np.ndarray, float]:
    x = points.astype(np.float64)
    squares = np.einsum("ij,ij->i", x, x)
    largest = float(squares.max(initial=0.0))
    return np.column_stack([x, np.sqrt(np.maximum(largest - squares, 0))]), np.sqrt(largest)


def _spread(x: np.ndarray, squares: np.ndarray, members: np.ndarray, gaps: np.ndarray, centre: int, leaf: int, noise: float) -> _Node:
    """The node of ``members`` around ``centre``; ``gaps`` are their squared distances to it, exact up to ``noise``."""
    node = _Node(centre, float(np.sqrt(gaps.max() + noise)), members)
    if len(members) <= leaf or gaps.max() <= noise:
        return node
    reach = 4.0 ** (np.ceil(np.log2(gaps.max()) / 2) - 1)  # squared radius of the level below
    own, y = x[members], squares[members]
    free = np.ones(len(members), bool)
    next_centres = [int(np.flatnonzero(members == centre)[0])]
    alone = []
    while free.any():
        left = np.flatnonzero(free)
        table = y[left] + y[next_centres][:, None] - 2 * (own[next_centres] @ own[left].T)
        for at, row in zip(next_centres, table):
            if not free[at]:
                continue
            row[left == at] = 0
            near = free[left] & (row <= reach)
            group = left[near]
            free[group] = False
            if len(group) == 1:
                alone.append(members[at])
            else:
                node.children.append(_spread(x, squares, members[group], np.maximum(row[near], 0), members[at], leaf, noise))
        next_centres = np.flatnonzero(free)[:CENTRES].tolist()
    if len(node.children) == 1 and not alone:  # everything is close to the centre already
        return node.children[0]
    node.points = np.array(alone, np.int64)
    return node


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of integer vectors, at least one."""
    x, largest = augmented(points)
    squares = np.einsum("ij,ij->i", x, x)
    gaps = np.einsum("ij,ij->i", x - x[0], x - x[0])
    nodes = [_spread(x, squares, np.arange(len(x)), gaps, 0, leaf, 1e-12 * (largest * largest + 1))]
    order, own, below, count = [], [], [], 0
    for node in nodes:  # grows: level by level, so that a node's children follow each other
        own.append((count, len(node.points)))
        count += len(node.points)
        order.append(node.points)
        below.append((len(nodes), len(node.children)))
        nodes += node.children
    flat = np.concatenate(order)
    return Tree(points[flat], flat, largest, x[[n.centre for n in nodes]], np.array([n.radius for n in nodes]), np.array(own), np.array(below))


class Best:
    """The ``k`` best results of every slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.found: list[tuple[np.ndarray, ...]] = []
        self.least = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(slots):
            return
        touched = np.unique(slots)
        if self.found:
            old = self.found[0]
            mine = np.isin(old[0], touched)
            rest = tuple(c[~mine] for c in old)
            slots, scores, ids, rows = (np.concatenate([c[mine], new]) for c, new in zip(old, (slots, scores, ids, rows)))
        order = np.lexsort((rows, ids, -scores, slots))
        slots, scores, ids, rows = slots[order], scores[order], ids[order], rows[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(slots)) + 1])
        rank = np.arange(len(slots)) - np.repeat(first, np.diff(np.concatenate([first, [len(slots)]])))
        top = rank < self.k
        last = rank == self.k - 1
        self.least[slots[last]] = scores[last]
        kept = tuple(c[top] for c in (slots, scores, ids, rows))
        self.found = [tuple(np.concatenate([a, b]) for a, b in zip(rest, kept)) if self.found else kept]

    def all(self) -> tuple[np.ndarray, ...]:
        return self.found[0] if self.found else tuple(np.empty(0, np.int64) for _ in range(4))


def scores_of(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    size = np.sqrt(float((queries.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) * float((points.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    if size < EXACT:
        return (queries.astype(np.float64) @ points.T.astype(np.float64)).astype(np.int64)
    if size < LARGEST:
        return queries.astype(np.int64) @ points.T.astype(np.int64)
    raise ValueError(f"inner products are not below {LARGEST}")


def search(
    tree: Tree, queries: np.ndarray, low: np.ndarray, high: np.ndarray, accept, ids: np.ndarray, k: int
) -> tuple[tuple[np.ndarray, ...], int]:
    """The ``k`` best points of every (query, window): ``(slots, scores, ids, places)``, and how many points were scored.

    ``low`` and ``high`` (queries x windows) are inclusive bounds of the score; slot = query * windows + window.
    ``accept(queries, places)`` says which (query, point) pairs count; ``ids`` are the points' ids in tree order.
    """
    windows = low.shape[1]
    best = Best(len(queries) * windows, k)
    wide = np.column_stack([queries.astype(np.float64), np.zeros(len(queries))])
    squares = np.einsum("ij,ij->i", wide, wide)
    total = squares + tree.largest**2
    slack = 1e-6 + 1e-9 * total
    scored = 0

    def bounds(node: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = wide[q] - tree.centres[node]
        d, r = np.sqrt(np.einsum("ij,ij->i", gap, gap)), tree.radii[node]
        upper = (total[q] - np.maximum(d - r, 0) ** 2) / 2 + slack[q]
        return (total[q] - (d + r) ** 2) / 2 - slack[q], upper

    def open_windows(q: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Which queries may still find something between the bounds."""
        least = np.maximum(low[q], best.least.reshape(-1, windows)[q])  # equal scores may win by their id
        return ((upper[:, None] >= least) & (lower[:, None] <= high[q]) & (low[q] <= high[q])).any(axis=1)

    def enter(node: int, q: np.ndarray) -> None:
        lower, upper = bounds(node, q)
        keep = open_windows(q, lower, upper)
        if keep.any():
            heapq.heappush(heap, (-float(upper[keep].max()), node, q[keep], lower[keep], upper[keep]))

    heap: list = []
    enter(0, np.arange(len(queries)))
    while heap:
        _, node, q, lower, upper = heapq.heappop(heap)
        keep = open_windows(q, lower, upper)  # results since then may have closed windows
        q = q[keep]
        if not len(q):
            continue
        begin, n = tree.own[node]
        if n:
            places = np.arange(begin, begin + n)
            scores = scores_of(queries[q], tree.points[begin : begin + n])
            scored += scores.size
            ok = accept(q, places)
            for w in range(windows):
                slots = q * windows + w
                mine = ok & (scores >= low[q, w][:, None]) & (scores <= high[q, w][:, None]) & (scores >= best.least[slots][:, None])
                if n > k:  # only what may be among the k best of these points
                    ranked = np.where(mine, scores, np.iinfo(np.int64).min)
                    mine &= scores >= np.partition(ranked, n - k, axis=1)[:, n - k][:, None]
                a, b = np.nonzero(mine)
                best.add(slots[a], scores[a, b], ids[places[b]], places[b])
        first, n = tree.below[node]
        for child in range(first, first + n):
            enter(child, q)
    return best.all(), scored

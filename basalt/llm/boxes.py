"""Count vectors: points, boxes and the join of two leaves by the bound of summed minima.

A set's point counts its elements by hashed group; |A and B| <= sum of min(a_g, b_g).  A box holds the largest
count of each group over its points, and its smallest set's size; the same sum bounds the overlap of anything in it.
"""

from __future__ import annotations

import numpy as np

#: Groups of a point, points of a node of the tree, pairs whose minima are taken in one array.
GROUPS, NODE, FEW = 64, 64, 4096

#: The largest count; groups that reach it rule nothing out.
TOP = 65535


def point(hashes: np.ndarray) -> np.ndarray:
    """Counts by the hashes' lowest bits, at most TOP."""
    return np.minimum(np.bincount((hashes & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), TOP).astype(np.uint16)


def bounded(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether points (or boxes) a and b can hold a pair at Jaccard num / den: summed minima against the sizes, which
    are the smallest ones of boxes.  Sets whose counts reach TOP are never ruled out."""
    if len(a) * len(b) <= FEW:
        most = np.minimum(a[:, None], b[None, :]).sum(2, dtype=np.int64)
    else:
        most = np.zeros((len(a), len(b)), np.int64)
        for g in range(a.shape[1]):
            most += np.minimum(a[:, g, None], b[None, :, g])
    full = (a.max(1) >= TOP)[:, None] | (b.max(1) >= TOP)[None, :]
    return full | ((num + den) * most >= num * (size_a[:, None] + size_b[None, :]))


def tree(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bulk-loaded nodes of a leaf: (order of the points, starts of the nodes, corners, smallest sizes).

    Points are sorted by size, then tiled by their two most varied coordinates."""
    wide = np.argsort(-points.var(0))[:2] if len(points) else np.zeros(2, np.int64)
    slab = max(1, int(np.ceil(np.sqrt(len(points) / NODE)))) * NODE
    order = np.argsort(sizes, kind="stable")
    rank = np.empty(len(points), np.int64)
    rank[order] = np.arange(len(points)) // slab
    order = np.lexsort((points[:, wide[1]], points[:, wide[0]], rank))
    starts = np.arange(0, len(points), NODE)
    return order, starts, np.maximum.reduceat(points[order], starts), np.minimum.reduceat(sizes[order], starts)


def joined(points: np.ndarray, sizes: np.ndarray, n: int | None, num: int, den: int) -> np.ndarray:
    """Which points have a partner that no bound rules out: the first n against the others, or (n is None) all against all."""
    own = n is None
    if len(points) <= NODE:  # a tree of one node, or of one on each side
        a, b = (points, points) if own else (points[:n], points[n:])
        near = bounded(a, sizes if own else sizes[:n], b, sizes if own else sizes[n:], num, den)
        if own:
            np.fill_diagonal(near, False)
            return near.any(1)
        return np.concatenate([near.any(1), near.any(0)])
    halves = [np.arange(len(points))] if own else [np.arange(n), np.arange(n, len(points))]
    left = np.zeros(len(points), bool)
    trees = [tree(points[h], sizes[h]) for h in halves]
    (order_a, starts_a, corner_a, least_a), (order_b, starts_b, corner_b, least_b) = trees[0], trees[-1]
    a_all, b_all = halves[0][order_a], halves[-1][order_b]
    meet = bounded(corner_a, least_a, corner_b, least_b, num, den)
    for i, j in zip(*np.nonzero(np.triu(meet) if own else meet)):
        a, b = a_all[starts_a[i] : starts_a[i] + NODE], b_all[starts_b[j] : starts_b[j] + NODE]
        # Points against the other box, then against each other.
        a = a[bounded(points[a], sizes[a], corner_b[j, None], least_b[j, None], num, den)[:, 0]]
        b = b[bounded(points[b], sizes[b], corner_a[i, None], least_a[i, None], num, den)[:, 0]]
        if len(a) and len(b):
            near = bounded(points[a], sizes[a], points[b], sizes[b], num, den)
            if own and i == j:
                near &= a[:, None] != b[None, :]
            left[a[near.any(1)]] = True
            left[b[near.any(0)]] = True
    return left

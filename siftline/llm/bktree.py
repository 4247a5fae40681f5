"""A forest of BK-trees over 64-bit fingerprints, in flat arrays.

Every tree holds the fingerprints of one shard. ``child[node, d]`` is the child of ``node`` at Hamming distance
``d`` (-1: none). Trees are built and searched level by level, all shards of a block at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 64
#: (query, node) pairs that one step of a search holds.
FRONTIER = 1 << 18


class BKForest:
    def __init__(self, prints: np.ndarray, shards: np.ndarray):
        """prints: uint64, distinct within a shard; shards: the shard of each."""
        n = len(prints)
        self.prints = prints
        self.child = np.full((n, BITS + 1), -1, dtype=np.int32)
        self.root = np.zeros(n, dtype=np.int64)
        if not n:
            return
        _, first, of = np.unique(shards, return_index=True, return_inverse=True)
        self.root = first[of]
        waiting = np.flatnonzero(self.root != np.arange(n))
        node = self.root[waiting]
        while len(waiting):
            d = np.bitwise_count(prints[waiting] ^ prints[node]).astype(np.int64)
            _, leader, of = np.unique(node * (BITS + 1) + d, return_index=True, return_inverse=True)
            self.child[node[leader], d[leader]] = waiting[leader]
            under = waiting[leader][of]
            stay = under != waiting
            waiting, node = waiting[stay], under[stay]

    def within(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of (query, node), query > node, of one shard at most ``radius`` bits apart."""
        n = len(self.prints)
        for begin in range(0, n, FRONTIER):
            query = np.arange(begin, min(n, begin + FRONTIER))
            stack = [(query, self.root[query])]
            while stack:
                query, node = stack.pop()
                if len(query) > FRONTIER:
                    half = len(query) // 2
                    stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                    continue
                d = np.bitwise_count(self.prints[query] ^ self.prints[node]).astype(np.int64)
                hit = (d <= radius) & (query > node)
                if hit.any():
                    yield query[hit], node[hit]
                edges = d[:, None] + np.arange(-radius, radius + 1)
                inside = (edges >= 0) & (edges <= BITS)
                below = np.where(inside, self.child[node[:, None], np.clip(edges, 0, BITS)], -1)
                row, col = np.nonzero(below >= 0)
                if len(row):
                    stack.append((query[row], below[row, col].astype(np.int64)))


class Links:
    """Union of links between positions 0..n-1: every position learns the least one it is linked to."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            top = self.roots()
            x, y = top[a], top[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))

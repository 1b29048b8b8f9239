"""A packed R-tree over count vectors whose node bound is the sum of coordinate minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF, FAN = 64, 8


def needed(total: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least intersection of two sets whose sizes sum to ``total`` with den * intersection >= num * union."""
    return -(-num * total // (den + num))


class CountTree:
    """Points are rows of group counts, sizes their sums; nodes keep the coordinate maxima and the range of sizes."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        # packing: by size into slabs, then by the widest coordinate inside a slab
        order = np.argsort(sizes, kind="stable")
        if len(order) > LEAF:
            slab = max(LEAF, int(np.ceil(len(order) / np.sqrt(len(order) / LEAF))))
            wide = int(np.argmax(counts.astype(np.float32).var(0)))
            order = np.concatenate([part[np.argsort(counts[part, wide], kind="stable")] for part in (order[i : i + slab] for i in range(0, len(order), slab))])
        self.order, self.counts, self.sizes = order, counts, sizes
        starts = np.arange(0, len(order), LEAF)
        n = sizes[order]
        level = (np.maximum.reduceat(counts[order], starts), np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts))
        self.levels = [level]
        while len(level[1]) > 1:
            at = np.arange(0, len(level[1]), FAN)
            level = (np.maximum.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at))
            self.levels.append(level)

    def leaf_pairs(self, num: int, den: int) -> Iterator[tuple[int, int]]:
        """Pairs of leaves (first <= second) that may hold a linked pair."""
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            depth, a, b = todo.pop()
            top, low, high = self.levels[depth]
            small, large = (a, b) if low[a] <= low[b] else (b, a)
            if high[small] * den < num * low[large]:
                continue
            bound = min(int(np.minimum(top[a], top[b]).sum(dtype=np.int64)), int(min(high[a], high[b])))
            if bound < needed(low[a] + low[b], num, den):
                continue
            if depth == 0:
                yield a, b
                continue
            below = len(self.levels[depth - 1][1])
            for x in range(a * FAN, min(below, a * FAN + FAN)):
                for y in range(b * FAN if a != b else x, min(below, b * FAN + FAN)):
                    todo.append((depth - 1, x, y))

    def pairs(self, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row pairs (i, j) and their bound on the intersection, for all pairs that the bound lets through."""
        for a, b in self.leaf_pairs(num, den):
            p, q = self.order[a * LEAF : a * LEAF + LEAF], self.order[b * LEAF : b * LEAF + LEAF]
            bound = np.empty((len(p), len(q)), np.int64)
            for k, row in enumerate(self.counts[p]):
                bound[k] = np.minimum(row, self.counts[q]).sum(1, dtype=np.int64)
            ok = bound >= needed(self.sizes[p][:, None] + self.sizes[q][None, :], num, den)
            if a == b:
                ok &= np.arange(len(p))[:, None] < np.arange(len(q))[None, :]
            i, j = np.nonzero(ok)
            if len(i):
                yield p[i], q[j], bound[i, j]

"""Signature trees over sets of hashes: which pairs of a block are similar enough?

A set's signature is a bitmap of its hashes' low bits.  The tree's leaves hold a few sets in order of
size; every node holds the OR of its signatures, its smallest and largest set, and its largest excess
(elements beyond distinct bits).  Two sets share at most as many elements as their signatures share bits
plus the smaller excess, and what holds for the sets holds for the nodes above them.  The dual traversal
goes down from the pair (root, root) and drops every pair of nodes whose sizes are too different or
whose greatest possible overlap is too small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PERCENT = 75
LEAF, FANOUT = 16, 8
PAIRS_AT_ONCE = 512
#: Of the signatures that are compared in one step: wide ones go in smaller portions.
BYTES_AT_ONCE = 8 << 20
#: Of all signatures of a tree: with more sets they get narrower, which bounds fewer pairs but loses none.
TREE_BYTES = 16 << 20


def width_for(n: np.ndarray, per_element: int = 2) -> np.ndarray:
    """Bits of a signature: the power of two that is at least ``per_element`` times the set, from 256 on."""
    return (1 << np.ceil(np.log2(np.maximum(256, per_element * np.asarray(n, dtype=np.int64)))).astype(np.int64))


def signature(elements: np.ndarray, bits: int) -> np.ndarray:
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(elements & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def folded(sig: np.ndarray, bits: int) -> np.ndarray:
    """The same set's signature with fewer bits."""
    return np.bitwise_or.reduce(sig.reshape(-1, bits // 64), axis=0)


class Tree:
    """Levels of nodes over sets sorted by size; level 0 are the sets, each level above has fewer nodes."""

    def __init__(self, sizes: np.ndarray, sigs: np.ndarray, percent: int = PERCENT) -> None:
        self.percent = percent
        self.order = np.lexsort((sigs[:, 0], sizes))
        sizes, sigs = sizes[self.order].astype(np.int64), sigs[self.order]
        excess = sizes - np.bitwise_count(sigs).sum(1, dtype=np.int64)
        self.levels = [(sigs, sizes, sizes, excess)]
        self.fanouts = [1]
        fanout = LEAF
        while len(self.levels[-1][1]) > 1:
            bits, low, high, extra = self.levels[-1]
            at = np.arange(0, len(low), fanout)
            self.levels.append((
                np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)
            ))
            self.fanouts.append(fanout)
            fanout = FANOUT

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of nodes may hold a similar pair of sets."""
        bits, low, high, extra = self.levels[level]
        p = self.percent
        ok = (100 * high[a] >= p * low[b]) & (100 * high[b] >= p * low[a])
        left, step = np.flatnonzero(ok), max(1, BYTES_AT_ONCE // bits[0].nbytes)
        for k in range(0, len(left), step):
            at = left[k:k + step]
            x, y = a[at], b[at]
            shared = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64) + np.minimum(extra[x], extra[y])
            # overlap >= p% of the union means overlap >= p / (100 + p) of the sizes' sum.
            ok[at] = (100 + p) * shared >= p * (low[x] + low[y])
        return ok

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fanout, n = self.fanouts[level], len(self.levels[level - 1][1])
        i, j = np.divmod(np.arange(fanout * fanout), fanout)
        x, y = (a[:, None] * fanout + i).ravel(), (b[:, None] * fanout + j).ravel()
        keep = (x < n) & (y < n) & ((x < y) | ((x == y) if level > 1 else False))
        return x[keep], y[keep]

    def pairs(self, settled=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets that the bounds leave, as indices, in portions.

        ``settled(i, j)`` may tell for sets, by their indices, which pairs need no look any more; it is
        asked again for every portion, so what was found in between takes effect.
        """
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > PAIRS_AT_ONCE:
                stack += [(level, a[k:k + PAIRS_AT_ONCE], b[k:k + PAIRS_AT_ONCE]) for k in range(0, len(a), PAIRS_AT_ONCE)][::-1]
                continue
            if level == 0:
                continue
            x, y = self._children(level, a, b)
            if level == 1 and settled is not None and len(x):
                open_ = ~settled(self.order[x], self.order[y])
                x, y = x[open_], y[open_]
            ok = self._possible(level - 1, x, y) if len(x) else np.zeros(0, bool)
            x, y = x[ok], y[ok]
            if not len(x):
                continue
            if level == 1:
                yield self.order[x], self.order[y]
            else:
                stack.append((level - 1, x, y))


def tied(sizes: np.ndarray, sigs: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """A number per set of a block: sets that a chain of possible pairs connects share it, and sets without
    a possible partner have -1.  Signatures of their own widths are all it takes.

    Sets of one width are compared with each other and, folded to half, with those of half the width: no
    similar sets lie further apart, since sizes differ by a factor of two at most.
    """
    bits = np.array([64 * len(s) for s in sigs])
    label, found = np.arange(len(sizes)), np.zeros(len(sizes), bool)
    for w in np.unique(bits):
        at = np.flatnonzero((bits == w) | (bits == 2 * w))
        if len(at) < 2:
            continue
        wide = bits[at] > w
        matrix = np.stack([folded(sigs[i], w) if x else sigs[i] for i, x in zip(at, wide, strict=True)])
        for i, j in Tree(sizes[at], matrix, percent).pairs(lambda i, j: (label[at[i]] == label[at[j]]) | (wide[i] & wide[j])):  # noqa: B023
            found[at[i]] = found[at[j]] = True
            for x, y in zip(at[i].tolist(), at[j].tolist(), strict=True):
                if label[x] != label[y]:
                    label[label == label[y]] = label[x]
    return np.where(found, label, -1)


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Exact check on two sorted sets of hashes."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
    return 100 * both >= percent * (len(x) + len(y) - both)


def links(sets: list[np.ndarray], group: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Similar pairs of a block that join its ``group`` numbers into the components that all its similar
    pairs make; pairs already joined are not looked at."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    bits = int(width_for(sizes.max(), 4))
    while bits > 256 and bits // 8 * len(sets) > TREE_BYTES:
        bits //= 2
    label = np.unique(group, return_inverse=True)[1]
    tree = Tree(sizes, np.stack([signature(s, bits) for s in sets]), percent)
    out = []
    for i, j in tree.pairs(lambda i, j: label[i] == label[j]):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if label[a] != label[b] and similar(sets[a], sets[b], percent):
                out.append((a, b))
                label[label == label[b]] = label[a]
    return out

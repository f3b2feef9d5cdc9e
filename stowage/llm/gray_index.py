"""A hierarchical index over fingerprints in Gray order, and links through it.

Fingerprints are sorted by Gray rank, so that neighbours share most of their bits. Nodes stand over runs of
neighbours: a node's mask has the bits that all below it agree on, its pattern their values. The bits in which
two nodes' patterns differ, under both masks, are differences between any two fingerprints below them, and
they only accumulate further down. A pair of nodes that differ in too many is dropped with all below it.
"""

from __future__ import annotations

import numpy as np

#: Children of a node.
FANOUT = 8


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Where each 64-bit code stands in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(codes: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From the fingerprints up, (pattern, mask, first child, end of children) of each level's nodes.

    codes holds groups of the given sizes one after another; the nodes of the last level are the groups.
    """
    levels = []
    every = every_or = codes
    while True:
        counts = -(-sizes // FANOUT)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.repeat(first, counts) + FANOUT * within
        ends = np.append(starts[1:], len(every))
        every, every_or = np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(every_or, starts)
        levels.append((every, ~(every ^ every_or), starts, ends))
        sizes = counts
        if (sizes == 1).all():
            return levels


def close_pairs(codes: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a, b), a < b, of places in codes within a group that differ in at most `most` bits.

    codes holds groups one after another, each in Gray order.
    """
    levels = _levels(codes, sizes)
    a = b = np.arange(len(sizes))
    full = np.full(len(codes), ~np.uint64(0))
    for depth in range(len(levels) - 1, -1, -1):
        _, _, starts, ends = levels[depth]
        pattern, mask = (codes, full) if depth == 0 else levels[depth - 1][:2]
        wide, high = ends[a] - starts[a], ends[b] - starts[b]
        count = wide * high
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        high = np.repeat(high, count)
        x = np.repeat(starts[a], count) + place // high
        y = np.repeat(starts[b], count) + place % high
        keep = x < y if depth == 0 else x <= y
        x, y = x[keep], y[keep]
        keep = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= most
        a, b = x[keep], y[keep]
    return a, b

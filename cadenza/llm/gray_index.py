"""A hierarchical index over 64-bit fingerprints in Gray order, searched in numpy.

In order of Gray rank, neighbours differ in few bits, so runs of them share many. A node over a run holds the bits that all
of its members share, as a mask and a pattern, less those that a node above it holds already. A search walks down from
the top, adds up the bits in which the query differs from the patterns on its way, and drops a node with all that is below
it when the sum is over the limit; at a member only the bits that no node above shares are left to compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Members, or nodes, below one node.
FAN = 8
#: Queries that are walked down together.
QUERIES = 1 << 12
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each uint64 in the Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which run, place) of every place of the runs starts[i], starts[i] + 1, ... of counts[i] places."""
    run = np.repeat(np.arange(len(starts)), counts)
    return run, np.arange(len(run)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class GrayIndex:
    """``members`` (uint64) of several leaves, leaf l from offsets[l] to offsets[l + 1], each in Gray order; no leaf is empty."""

    def __init__(self, members: np.ndarray, offsets: np.ndarray):
        self.members = members
        sizes = np.diff(offsets)
        spans = [FAN]
        while spans[-1] < sizes.max(initial=1):
            spans.append(spans[-1] * FAN)
        self.levels = []  # from the members up: (first child, children, mask, pattern) of each node; nodes before each leaf
        below, lowest = offsets, None
        for _ in spans:
            per_leaf = np.diff(below)
            nodes = -(-per_leaf // FAN)
            leaf, child = _spread(np.zeros(len(nodes), dtype=np.int64), nodes)
            first = below[leaf] + child * FAN
            count = np.minimum(FAN, below[leaf + 1] - first)
            low, high = lowest if lowest else (members, members)
            lowest = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
            self.levels.append((first, count, ~(lowest[0] ^ lowest[1]), lowest[0]))
            below = np.concatenate([[0], np.cumsum(nodes)])
        self.roots = below[:-1]

    def search(self, queries: np.ndarray, leaves: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) numbers of all pairs that differ in ``most`` bits at most; query i is looked up in leaves[i]."""
        for at in range(0, len(queries), QUERIES):
            q = np.arange(at, min(at + QUERIES, len(queries)))
            node, off, above = self.roots[leaves[q]], np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.uint64)
            for first, count, mask, pattern in reversed(self.levels):
                off = off + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node] & ~above)
                near = off <= most
                q, node, off = q[near], node[near], off[near]
                above = mask[node]
                parent, child = _spread(first[node], count[node])
                q, node, off, above = q[parent], child, off[parent], above[parent]
            near = off + np.bitwise_count((queries[q] ^ self.members[node]) & ~above) <= most
            yield q[near], node[near]


def join_up(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``labels`` (each the least number of its group) after the groups of i[n] and j[n] have become one, for all n."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up

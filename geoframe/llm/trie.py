"""A prefix tree over ordered shingle sets, and the similarity join of a block with it.

Sets are sorted arrays of hashes, so hash order is the one global order.  Sets that begin
alike share a path, and a traversal computes the overlap of the query with a path once for
all sets below it.  It leaves a subtree when even the longest remainder of its sets and of
the query can't reach the overlap that its smallest set needs.  All open nodes advance
together, some labels' tokens at a time, as array operations.
"""

from __future__ import annotations

import numpy as np

#: Two sets link when LINK_A * overlap >= LINK_B * (their sizes added up), that is Jaccard >= 3/4.
LINK_A, LINK_B = 7, 3
STEP = 96


class Trie:
    def __init__(self, sets: list[np.ndarray]):
        """``sets``: sorted arrays of small integers (ranks in the block's vocabulary)."""
        self.order = np.array(sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes()), np.int64)
        self.sets = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self._build()

    def _build(self) -> None:
        """Nodes by a stack over what neighbours in sorted order share."""
        nodes: list[tuple] = []  # first set, end set, start depth, end depth, children
        open_: list[list] = [[0, 0, []]]  # end depth, first set, finished children

        def close(at: int, shared: int) -> None:
            while open_[-1][0] > shared:
                end, lo, below = open_.pop()
                nodes.append((lo, at, max(open_[-1][0], shared), end, below))
                if open_[-1][0] < shared:
                    open_.append([shared, lo, [len(nodes) - 1]])
                else:
                    open_[-1][2].append(len(nodes) - 1)

        for i, s in enumerate(self.sets):
            if i:
                m = min(len(s), len(self.sets[i - 1]))
                differ = np.flatnonzero(s[:m] != self.sets[i - 1][:m])
                close(i, int(differ[0]) if len(differ) else m)
            if open_[-1][0] < len(s):  # else it equals the set before and ends at the same node
                open_.append([len(s), i, []])
        close(len(self.sets), 0)
        self.roots = np.array(open_[0][2], np.int64)
        self.lo, self.hi, self.start, self.end = (np.array([x[k] for x in nodes], np.int64) for k in range(4))
        self.least = np.array([self.size[a:b].min() for a, b in zip(self.lo, self.hi, strict=True)], np.int64)
        self.most = np.array([self.size[a:b].max() for a, b in zip(self.lo, self.hi, strict=True)], np.int64)
        self.below = np.array([i for x in nodes for i in x[4]], np.int64)
        self.n_below = np.array([len(x[4]) for x in nodes], np.int64)
        self.at_below = np.cumsum(self.n_below) - self.n_below
        labels = [self.sets[x[0]][x[2] : x[3]] for x in nodes]
        self.length = self.end - self.start
        self.at_label = np.cumsum(self.length) - self.length
        self.labels = np.concatenate([*labels, np.zeros(STEP, np.uint32)])

    def matches(self, query: np.ndarray, present: np.ndarray, settled: np.ndarray) -> list[int]:
        """Indices of the sets that link with ``query``.  ``present``: its members as a mask
        over the vocabulary; ``settled``: mask over the sets, in sorted order, that needn't
        be compared."""
        q = len(query)
        low, high = -(-LINK_B * q // (LINK_A - LINK_B)), q * (LINK_A - LINK_B) // LINK_B
        found: list[int] = []
        node, pos, overlap = self.roots, np.zeros(len(self.roots), np.int64), np.zeros(len(self.roots), np.int64)
        steps = np.arange(STEP)
        fresh = True
        while len(node):
            if fresh:
                good = (self.most[node] >= low) & (self.least[node] <= high) & ~((self.hi[node] - self.lo[node] == 1) & settled[self.lo[node]])
                node, pos, overlap = node[good], pos[good], overlap[good]
                if not len(node):
                    break
            width = np.minimum(STEP, self.length[node] - pos)
            at = self.at_label[node] + pos
            hits = present[self.labels[at[:, None] + steps]]
            hits &= steps < width[:, None]
            overlap = overlap + hits.sum(axis=1)
            pos = pos + width
            rest = q - np.searchsorted(query, self.labels[at + width - 1], side="right")
            need = -(-LINK_B * (q + np.maximum(self.least[node], low)) // LINK_A)
            alive = overlap + np.minimum(rest, self.most[node] - self.start[node] - pos) >= need
            node, pos, overlap = node[alive], pos[alive], overlap[alive]
            done = pos == self.length[node]
            ends = node[done]
            for i, o in zip(ends[LINK_A * overlap[done] >= LINK_B * (q + self.end[ends])].tolist(), overlap[done][LINK_A * overlap[done] >= LINK_B * (q + self.end[ends])].tolist(), strict=True):
                k = int(self.lo[i])
                while k < self.hi[i] and self.size[k] == self.end[i]:  # the sets that end here come first
                    if not settled[k]:
                        found.append(int(self.order[k]))
                    k += 1
            counts = self.n_below[ends]
            total = int(counts.sum())
            fresh = total > 0
            if total:
                spread = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
                more = self.below[np.repeat(self.at_below[ends], counts) + spread]
                node = np.concatenate([node[~done], more])
                pos = np.concatenate([pos[~done], np.zeros(total, np.int64)])
                overlap = np.concatenate([overlap[~done], np.repeat(overlap[done], counts)])
            else:
                node, pos, overlap = node[~done], pos[~done], overlap[~done]
        return found


def join_block(sets: list[np.ndarray], queries: list[int] | None = None) -> list[int]:
    """The smallest index that each set is connected with, after uniting all that link.

    ``sets`` are sorted hash arrays, the first is the block's pivot.  With ``queries`` only
    pairs with one of them are compared.  Else all pairs count, but those within a group
    that is known to be connected aren't compared again: sets outside the pivot's group are
    the queries, each against all sets."""
    n = len(sets)
    if n < 2:
        return [0] * n
    if n == 2:  # a tree of two leaves
        overlap = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [0, 0 if LINK_A * overlap >= LINK_B * (len(sets[0]) + len(sets[1])) else 1]
    vocabulary, ranks = np.unique(np.concatenate(sets), return_inverse=True)
    ranked = np.split(ranks.astype(np.uint32), np.cumsum([len(s) for s in sets])[:-1])
    tree = Trie(ranked)
    present = np.zeros(len(vocabulary), bool)
    group = np.arange(n)
    for i in range(n) if queries is None else queries:
        if queries is None and i and group[i] == 0:
            continue
        settled = (group == group[i])[tree.order]
        if settled.all():
            break
        present[ranked[i]] = True
        for j in tree.matches(ranked[i], present, settled):
            a, b = sorted((int(group[i]), int(group[j])))
            if a != b:
                group[group == b] = a
        present[ranked[i]] = False
    return group.tolist()

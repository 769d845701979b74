"""A prefix tree of ordered sets, joined with itself by Jaccard similarity.

Sets are sorted arrays of 64-bit n-gram hashes: one order for all sets. Sets with a common beginning share a path, so the
overlap of a query with that path is counted once. Every node knows the smallest and largest set below it; a
subtree is left as soon as no set in it can still reach the overlap that the threshold needs. Nodes at the same stage of the
search are handled as one array.
"""

from __future__ import annotations

import numpy as np

#: Elements of a path that are compared before the bounds are tried for the first time; then twice as many, and so on.
PIECE = 64


class Threshold:
    """Jaccard similarity of at least num / den, in integers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def overlap(self, a: int, b: int) -> int:
        """Smallest intersection of sets of sizes a and b that are similar."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, n: int) -> int:
        """Of a set of size n: so many first elements, that a similar set has one of them among its own first ones."""
        return n - -(-self.num * n // self.den) + 1 if n else 0

    def lengths(self, a: int, b: int) -> bool:
        return self.den * min(a, b) >= self.num * max(a, b)


class Forest:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


class Trie:
    """A compressed prefix tree over sorted sets, held in arrays: the nodes of a level are visited together."""

    def __init__(self, sets: list[np.ndarray], limit: Threshold) -> None:
        self.limit = limit
        order = sorted(range(len(sets)), key=lambda k: sets[k].byteswap().tobytes())
        ends = np.cumsum([0, *(len(sets[k]) for k in order)])
        self.flat = np.concatenate([sets[k] for k in order]) if order else np.empty(0, np.uint64)
        size, number = np.diff(ends), np.array(order, np.int64)
        common = np.array([0, *(_shared(sets[a], sets[b]) for a, b in zip(order, order[1:], strict=False))], np.int64)
        # A node is a range of sets that agree up to its depth; children of one node are numbered in a row.
        todo, rows, children = [(0, len(order), 0)] if order else [], [], []
        at = 0
        while at < len(todo):
            lo, hi, depth = todo[at]
            at += 1
            if hi - lo == 1:
                rows.append((ends[lo] + depth, size[lo] - depth, depth, size[lo], size[lo], number[lo], number[lo]))
                children.append((0, 0))
                continue
            inner = common[lo + 1 : hi]
            m = int(inner.min())
            cuts = [lo, *(lo + 1 + np.flatnonzero(inner == m)), hi]
            rows.append((ends[lo] + depth, m - depth, depth, size[lo:hi].min(), size[lo:hi].max(), number[lo:hi].min(), -1))
            children.append((len(todo), len(cuts) - 1))
            todo += [(int(a), int(b), m) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        table = np.array(rows, np.int64).reshape(-1, 7).T
        self.start, self.length, self.depth, self.least, self.most, self.first, self.set = table
        self.child = np.array(children, np.int64).reshape(-1, 2)

    def linked(self, items: np.ndarray, before: int, labels: np.ndarray, label: int) -> np.ndarray:
        """Numbers of the sets similar to `items`, of those numbered under `before` and with another label.

        Nodes on the way carry the overlap of their paths; those that can't reach the needed overlap any more are left,
        with all below them.
        """
        n, num, den = len(items), self.limit.num, self.limit.den
        found: list[np.ndarray] = []
        node = np.zeros(min(1, len(self.start)), np.int64)
        pos, same, passed = np.zeros_like(node), np.zeros_like(node), np.zeros_like(node)
        step = PIECE
        while len(node) and n:
            # On entering a node: sizes, numbers and labels.
            keep = (pos > 0) | ((den * self.most[node] >= num * n) & (den * n >= num * self.least[node]) & (self.first[node] < before))
            leaf = self.set[node] >= 0
            keep &= ~leaf | (labels[self.set[node]] != label)
            node, pos, same, passed = node[keep], pos[keep], same[keep], passed[keep]
            if not len(node):
                break
            piece = np.minimum(self.length[node] - pos, step)
            ends = np.cumsum(piece)
            index = np.arange(ends[-1]) + np.repeat(self.start[node] + pos - (ends - piece), piece)
            values = self.flat[index]
            place = np.searchsorted(items, values)
            hits = np.r_[0, np.cumsum(items[np.minimum(place, n - 1)] == values)]
            same = same + hits[ends] - hits[ends - piece]
            pos = pos + piece
            last = self.flat[np.minimum(self.start[node] + np.maximum(pos - 1, 0), len(self.flat) - 1)]
            passed = np.where(piece > 0, np.searchsorted(items, last, "right"), passed)
            depth = self.depth[node] + pos
            # The size below at which the bound is most favourable.
            size = np.clip(depth + n - passed, self.least[node], self.most[node])
            alive = same + np.minimum(n - passed, size - depth) >= -(-num * (n + size) // (num + den))
            done = pos == self.length[node]
            ended = alive & done & (self.set[node] >= 0)
            if ended.any():
                found.append(self.set[node[ended]])
            down = alive & done & (self.set[node] < 0)
            on = alive & ~done
            count = self.child[node[down], 1]
            below = np.arange(count.sum()) + np.repeat(self.child[node[down], 0] - (np.cumsum(count) - count), count)
            node, pos = np.r_[node[on], below], np.r_[pos[on], np.zeros_like(below)]
            same, passed = np.r_[same[on], np.repeat(same[down], count)], np.r_[passed[on], np.repeat(passed[down], count)]
            step = min(2 * step, 1 << 20)
        return np.concatenate(found) if found else np.empty(0, np.int64)


def linked_forest(sets: list[np.ndarray], limit: Threshold, visitors: list[np.ndarray] | None = None, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect the sets as all similar pairs would; sets with one label count as connected already.

    Without visitors each set is looked up among those before it; else each visitor, numbered from len(sets) on, among the
    sets. labels: of the sets and then of the visitors.
    """
    trie = Trie(sets, limit)
    queries = sets if visitors is None else visitors
    first = 0 if visitors is None else len(sets)
    label = np.arange(first + len(queries)) if labels is None else labels.copy()
    edges = []
    for q, items in enumerate(queries, first):
        for x in trie.linked(items, min(q, len(sets)), label, label[q]):
            if label[x] != label[q]:
                edges.append((int(x), q))
                label[label == label[x]] = label[q]
    return edges

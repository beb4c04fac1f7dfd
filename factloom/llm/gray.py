"""Gray-ordered hierarchical index over 64-bit fingerprints.

Fingerprints are sorted by bucket and Gray rank; nodes over runs of neighbours keep the bits
that all their members share, and pairs of nodes are dropped or accepted whole by the
differences that those bits already show.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN_OUT = 8
PAIRS_AT_ONCE = 250_000


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray sequence."""
    rank = values.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


class GrayIndex:
    """Hierarchy over fingerprints sorted by bucket and Gray rank."""

    def __init__(self, bucket: np.ndarray, values: np.ndarray, sizes: np.ndarray | None = None, kinds: np.ndarray | None = None):
        """``sizes`` and ``kinds`` bound what ``pairs`` looks at: sets of like size and different kind."""
        self.order = order = np.lexsort((gray_rank(values), bucket))
        self.bucket, self.values = bucket[order], values[order]
        size = len(values)
        self.low, self.high = [self.values], [self.values]  # AND and OR of the members
        self.start = [np.arange(size)]
        self.sizes = None if sizes is None else [(sizes[order], sizes[order])]  # least and most of the members
        self.kinds = None if kinds is None else [(kinds[order], kinds[order])]
        group = self.bucket
        while len(group) and len(np.unique(group)) < len(group):
            opens = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            place = np.arange(len(group)) - np.repeat(opens, np.diff(np.r_[opens, len(group)]))
            heads = np.flatnonzero(place % FAN_OUT == 0)
            self.low.append(np.bitwise_and.reduceat(self.low[-1], heads))
            self.high.append(np.bitwise_or.reduceat(self.high[-1], heads))
            self.start.append(heads)
            for bounds in (self.sizes, self.kinds):
                if bounds is not None:
                    bounds.append((np.minimum.reduceat(bounds[-1][0], heads), np.maximum.reduceat(bounds[-1][1], heads)))
            group = group[heads]

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads = self.start[level]
        ends = np.r_[heads[1:], len(self.low[level - 1])]
        return heads[nodes], ends[nodes]

    def bounds(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most differing bits between members of two nodes."""
        low, high = self.low[level], self.high[level]
        shared = ~(low[a] ^ high[a]) & ~(low[b] ^ high[b])
        apart = (low[a] ^ low[b]) & shared
        least = np.bitwise_count(apart).astype(np.int64)
        return least, least + 64 - np.bitwise_count(shared)

    def classes(self, radius: int) -> np.ndarray:
        """For each value (in index order) the least position that it is linked with in its bucket."""
        label = np.arange(len(self.values))
        top = len(self.low) - 1
        spans = [np.arange(len(self.values))]
        for heads in self.start[1:]:
            spans.append(spans[-1][heads])
        step = max(1, PAIRS_AT_ONCE // FAN_OUT**2)
        stack: list[tuple[int, np.ndarray, np.ndarray]] = []  # undecided pairs, not yet expanded

        def visit(level: int, a: np.ndarray, b: np.ndarray) -> None:
            if level:
                one = np.minimum.reduceat(label, spans[level])
                uniform = one == np.maximum.reduceat(label, spans[level])
                keep = ~(uniform[a] & uniform[b] & (one[a] == one[b]))
            else:
                keep = label[a] != label[b]
            a, b = a[keep], b[keep]
            least, most = self.bounds(level, a, b)
            sure = most <= radius
            self._join(label, spans[level], level, a[sure], b[sure])
            undecided = (least <= radius) & ~sure
            a, b = a[undecided], b[undecided]
            if level:
                stack.extend((level, a[i : i + step], b[i : i + step]) for i in range(0, len(a), step))

        roots = np.arange(len(self.low[top]))
        if len(roots):
            visit(top, roots, roots)
        while stack:
            level, a, b = stack.pop()
            visit(level - 1, *self._expand(level, a, b))
        return label

    def pairs(self, radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of positions in one bucket within the radius, of different kinds and with sizes of at least that ratio."""

        def possible(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            least, _ = self.bounds(level, a, b)
            (small, large), (first, last) = self.sizes[level], self.kinds[level]
            near = (least <= radius) & (large[b] >= similarity * small[a] - 1e-6) & (large[a] >= similarity * small[b] - 1e-6)
            return near & ~((first[a] == last[a]) & (first[b] == last[b]) & (first[a] == first[b]))

        step = max(1, PAIRS_AT_ONCE // FAN_OUT**2)
        roots = np.arange(len(self.low[-1]))
        stack = [(len(self.low) - 1, roots[i : i + step], roots[i : i + step]) for i in range(0, len(roots), step)]
        while stack:
            level, a, b = stack.pop()
            if level < len(self.low) - 1 or not level:
                near = possible(level, a, b)
                a, b = a[near], b[near]
            if not level:
                if len(a):
                    yield a, b
            else:
                for i in range(0, len(a), step):
                    stack.append((level - 1, *self._expand(level, a[i : i + step], b[i : i + step])))

    def _expand(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first_a, end_a = self.children(level, a)
        first_b, end_b = self.children(level, b)
        i, j = np.divmod(np.arange(FAN_OUT * FAN_OUT), FAN_OUT)
        left, right = first_a[:, None] + i, first_b[:, None] + j
        fine = (left < end_a[:, None]) & (right < end_b[:, None]) & (left <= right)
        return left[fine], right[fine]

    def _join(self, label: np.ndarray, span: np.ndarray, level: int, a: np.ndarray, b: np.ndarray) -> None:
        """Merge the classes of all members of the node pairs."""
        if not len(a):
            return
        x, y = span[a], span[b]
        if level:  # members of one sure node are linked with its first
            ends = np.r_[span[1:], len(label)]
            whole = np.unique(np.r_[a, b])
            count = ends[whole] - span[whole]
            first = np.repeat(span[whole], count)
            member = first + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            x, y = np.r_[x, first], np.r_[y, member]
        while True:
            p, q = label[x], label[y]
            differ = p != q
            if not differ.any():
                return
            x, y, p, q = x[differ], y[differ], p[differ], q[differ]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while True:
                jump = label[label]
                if (jump == label).all():
                    break
                label[:] = jump

"""The median of the slopes of all pairs of points: exactly, without the pairs, in n log n steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs that are listed at once, and pairs that are drawn for the first bracket.
LIMIT, SAMPLE = 1 << 18, 1 << 15
#: What part of a bracket's pairs the next bracket leaves on either side of the median, if their slopes are even.
NARROW = 512


def inversions(p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a permutation of 0 to n - 1, bit by bit: values, start, count, order. A value's larger ones before it are order[start : start + count]."""
    at = np.arange(len(p), dtype=p.dtype)
    for s in range(max(len(p) - 1, 1).bit_length() - 1, -1, -1):
        first, one = (p >> (s + 1)) << (s + 1), (p >> s) & 1
        seen = np.cumsum(one, dtype=p.dtype) - one
        before = seen - seen[first]
        order = np.empty_like(p)
        order[np.where(one == 1, first + (1 << s) + before, at - before)] = p
        low = (one == 0) & (before > 0)
        yield p[low], first[low] + (1 << s), before[low], order
        p = order


class _Points:
    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        order = np.lexsort((y, x))
        self.x, self.y = x[order], y[order]
        same = lambda *v: sum(int(c) * (int(c) - 1) // 2 for c in np.unique(np.column_stack(v), axis=0, return_counts=True)[1])
        at_one_place = same(self.x)
        self.pairs = len(x) * (len(x) - 1) // 2 - at_one_place
        self.level = same(self.y) - same(self.x, self.y)

    def order(self, t: float) -> tuple[np.ndarray, np.ndarray]:
        """The points by what they have over a line of slope t, and each one's rank."""
        order = np.argsort(self.y - t * self.x, kind="stable")
        rank = np.empty(len(order), np.min_scalar_type(-2 * len(order)))
        rank[order] = np.arange(len(order))
        return order, rank

    def below(self, t: float) -> int:
        """How many slopes are less than t: pairs whose order over the line is not that of x."""
        return sum(int(count.sum()) for _, _, count, _ in inversions(self.order(t)[1]))

    def slopes(self, a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
        """The slopes from a to below b with their counts, ascending: of pairs that change places between the two lines."""
        ids, rank = self.order(b)
        values, counts = np.empty(0), np.empty(0, np.int64)
        for late, start, count, order in inversions(rank[self.order(a)[0]]):
            part = np.cumsum(count) // LIMIT
            for k in np.unique(part):
                own = part == k
                n = count[own]
                place = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                i, j = ids[order[place]], ids[np.repeat(late[own], n)]
                v, c = np.unique(np.concatenate([values, (self.y[j] - self.y[i]) / (self.x[j] - self.x[i])]), return_inverse=True)
                values, counts = v, np.bincount(c, np.concatenate([counts, np.ones(len(place))])).astype(np.int64)
        return values, counts

    def blur(self, *ts: float) -> float:
        """How near two slopes can be for rounding to confuse them."""
        size = np.abs(self.y).max() + max(map(abs, ts)) * np.abs(self.x).max()
        return 16 * np.finfo(float).eps * size / self.step

    def between(self, ranks: list[int], a: float, b: float) -> list[float]:
        """The slopes of these one or two ranks, which are at least a and less than b."""
        low, high, step = self.below(a), self.below(b), 0
        while high - low > LIMIT and b - a > self.blur(a, b):
            # shortly before the ranks, shortly after them, as if the slopes were even; then half way, as they need not be
            near = max(LIMIT // 4, (high - low) // NARROW)
            share = ((ranks[0] - near - low) / (high - low), (ranks[-1] + near - low) / (high - low), 0.5)[step % 3]
            step += 1
            middle = a + (b - a) * (share if 0 < share < 1 else 0.5)
            n = self.below(middle)
            if n <= ranks[0]:
                a, low = middle, n
            elif n > ranks[-1]:
                b, high = middle, n
            else:
                return self.between(ranks[:1], a, middle) + self.between(ranks[1:], middle, b)
        margin = self.blur(a, b)
        values, counts = self.slopes(a - margin, b + margin)
        return [float(values[np.searchsorted(np.cumsum(counts), k - self.below(a - margin), side="right")]) for k in ranks]

    def median(self) -> float:
        if not self.pairs:
            return float("nan")
        self.step = np.diff(np.unique(self.x)).min()
        ranks = sorted({(self.pairs - 1) // 2, self.pairs // 2})
        falling = self.below(0.0)
        rising = falling + self.level  # the ranks from here on; between them the slope is 0, which rounding does not blur
        most = float(np.ptp(self.y) / self.step)
        most += self.blur(most)
        found = [0.0] if any(falling <= k < rising for k in ranks) else []
        for side, a, b in (([k for k in ranks if k < falling], -most, 0.0), ([k for k in ranks if k >= rising], 0.0, most)):
            if side:
                found += self.between(side, *self.bracket(side, a, b))
        return (min(found) + max(found)) / 2

    def bracket(self, ranks: list[int], a: float, b: float) -> tuple[float, float]:
        """a and b, or nearer bounds by a sample of the pairs."""
        i, j = np.random.default_rng(0).integers(0, len(self.x), (2, SAMPLE))
        i, j = i[apart := self.x[i] != self.x[j]], j[apart]
        drawn = np.sort((self.y[j] - self.y[i]) / (self.x[j] - self.x[i]))
        for sign in (-1, 1) if len(drawn) else ():
            t = float(drawn[int(np.clip((ranks[0] / self.pairs + sign * 2 / np.sqrt(len(drawn))) * len(drawn), 0, len(drawn) - 1))])
            if a < t < b:
                n = self.below(t)
                a, b = (t, b) if n <= ranks[0] else (a, t) if n > ranks[-1] else (a, b)
        return a, b


def median_slope(x: np.ndarray, y: np.ndarray) -> float:
    """Of points with finite coordinates; NaN if all are at one place."""
    return _Points(np.asarray(x, float), np.asarray(y, float)).median()

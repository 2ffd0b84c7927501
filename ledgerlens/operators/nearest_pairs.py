"""The first pairs of a leader and a later follower, without building all pairs.

Rows of one account and one stretch of time are sorted by instant. For each
leader and each minute after it, the best follower with another id is read
from a table of range maxima; the best of these pairs are then followed up by
splitting their range at the follower found. Work is the number of rows times
its logarithm, plus the pairs asked for.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
from pyspark import cloudpickle

# Sent to Python workers by value, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class BestInRange:
    """The best place of a range, and the best one with another id than that, by rank (smallest first)."""

    def __init__(self, rank: np.ndarray, ids: np.ndarray):
        self.none = len(rank)
        self.rank = np.append(rank, np.iinfo(np.int64).max)
        self.ids = np.append(ids, -1)
        self.levels = [(np.arange(self.none), np.full(self.none, self.none))]
        size = 1
        while 2 * size <= self.none:
            best, other = self.levels[-1]
            self.levels.append(self._merge(best[:-size], other[:-size], best[size:], other[size:]))
            size *= 2

    def _merge(self, best_a, other_a, best_b, other_b):
        b_first = self.rank[best_b] < self.rank[best_a]
        best, loser = np.where(b_first, best_b, best_a), np.where(b_first, best_a, best_b)
        own, losers_other = np.where(b_first, other_b, other_a), np.where(b_first, other_a, other_b)
        theirs = np.where(self.ids[loser] == self.ids[best], losers_other, loser)
        return best, np.where(self.rank[theirs] < self.rank[own], theirs, own)

    def avoiding(self, start: np.ndarray, end: np.ndarray, own_id: np.ndarray) -> np.ndarray:
        """The best place of each range whose id is not `own_id`; `none` without one."""
        found = np.full(len(start), self.none)
        level = np.frexp(np.maximum(end - start, 1))[1] - 1
        for k in np.unique(level[end > start]):
            at = np.flatnonzero((level == k) & (end > start))
            best, other = self.levels[k]
            first, last = start[at], end[at] - (1 << int(k))
            best, other = self._merge(best[first], other[first], best[last], other[last])
            found[at] = np.where(self.ids[best] == own_id[at], other, best)
        return found


def first_pairs(
    lead: dict[str, np.ndarray], follow: dict[str, np.ndarray], count: int, minute: int, minutes: int
) -> list[tuple[int, int]]:
    """Places of the first `count` pairs by minutes apart, then larger combined value, then the two keys.

    Both sides have time, value, key and id; `follow` is sorted by time. A
    pair needs a gap above zero and below `minutes` whole minutes, and two ids.
    """
    if not len(lead["time"]) or not len(follow["time"]):
        return []
    rank = np.empty(len(follow["time"]), np.int64)
    rank[np.lexsort((follow["key"], -follow["value"]))] = np.arange(len(rank))
    table = BestInRange(rank, follow["id"])
    apart = np.repeat(np.arange(minutes), len(lead["time"]))
    leader = np.tile(np.arange(len(lead["time"])), minutes)
    begin = lead["time"][leader] + np.maximum(apart * minute, 1)
    start = np.searchsorted(follow["time"], begin)
    end = np.searchsorted(follow["time"], lead["time"][leader] + (apart + 1) * minute)
    partner = table.avoiding(start, end, lead["id"][leader])
    some = np.flatnonzero(partner != table.none)
    value = lead["value"][leader[some]] + follow["value"][partner[some]]
    order = np.lexsort((follow["key"][partner[some]], lead["key"][leader[some]], -value, apart[some]))[:count]

    def entry(a: int, l: int, p: int, s: int, e: int) -> tuple:
        combined = int(lead["value"][l]) + int(follow["value"][p])
        return a, -combined, int(lead["key"][l]), int(follow["key"][p]), l, p, s, e

    waiting = [entry(*(int(x[i]) for x in (apart, leader, partner, start, end))) for i in some[order]]
    heapq.heapify(waiting)
    pairs: list[tuple[int, int]] = []
    while waiting and len(pairs) < count:
        a, _, _, _, l, p, s, e = heapq.heappop(waiting)
        pairs.append((l, p))
        parts = np.array([[s, p], [p + 1, e]])
        for (s, e), p in zip(parts, table.avoiding(parts[:, 0], parts[:, 1], np.repeat(lead["id"][l], 2)), strict=True):
            if p != table.none:
                heapq.heappush(waiting, entry(a, l, int(p), int(s), int(e)))
    return pairs

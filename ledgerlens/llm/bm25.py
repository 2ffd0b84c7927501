"""A BM25 index of short texts, searched by block-max WAND for all entries above a threshold, for many queries in step."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence

import numpy as np

K1, B = 1.2, 0.75
BLOCK = 8  # entries that share one maximum per term
MOST_PARTS = 1_000_000  # postings or blocks looked at in one go, which bounds memory


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of runs, one run after another."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


class Index:
    """Postings by term, sorted by entry, and for each term and block of entries the largest weight, both stored.

    A term's weight in an entry is its BM25 weight as a share of the entry's
    own total, so a query that holds all of an entry's terms scores 1 there.
    Terms of a query count once. Inside, entries are numbered by length, so that
    weights in a block are alike; everything is held in arrays but the terms.
    """

    def __init__(self, entries: Sequence[Sequence[str]], frequency: Mapping[str, int], count: int, mean: float):
        """`frequency` and `count` are those of the whole collection, of which `entries` may be a part."""
        self.terms: dict[str, int] = {}
        self.original = np.array(sorted(range(len(entries)), key=lambda i: (len(entries[i]), i)), np.int32)
        term, entry, weight = [], [], []
        for place, number in enumerate(self.original.tolist()):
            words = entries[number]
            norm = K1 * (1 - B + B * len(words) / max(mean, 1.0))
            own = []
            for word, n in Counter(words).items():
                idf = math.log(1 + (count - frequency[word] + 0.5) / (frequency[word] + 0.5))
                term.append(self.terms.setdefault(word, len(self.terms)))
                own.append(idf * n * (K1 + 1) / (n + norm))
            entry += [place] * len(own)
            weight += [w / sum(own) for w in own]
        terms = np.array(term, np.int32)
        order = np.argsort(terms, kind="stable")  # entries rise within a term
        terms, self.entry, self.weight = terms[order], np.array(entry, np.int32)[order], np.array(weight, np.float64)[order]
        self.entries, self.blocks = len(entries), -(-len(entries) // BLOCK)
        # Postings of one term and block follow one another: a part, with its maximum.
        block = self.entry // BLOCK
        starts = np.flatnonzero(np.diff(terms, prepend=-1) | np.diff(block, prepend=-1))
        self.part_first, self.part_size = starts, np.diff(np.append(starts, len(terms)))
        self.part_block = block[starts]
        self.part_most = np.maximum.reduceat(self.weight, starts) if len(starts) else np.empty(0)
        parts_of = np.bincount(terms[starts], minlength=len(self.terms))
        self.first_part, self.parts = np.cumsum(parts_of) - parts_of, parts_of
        self.most = np.zeros(len(self.terms))  # of a whole list
        np.maximum.at(self.most, terms, self.weight)

    def search(self, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, score) of all entries that score at least `threshold`: a query is a row of term numbers, -1 for none.

        What WAND does for one query after another goes on here for all rows in step.
        First the pivot test: where the largest weights of all of a query's lists do not reach the
        threshold, no entry can. Then the block test: entries of a block are passed over
        unless the stored maxima of the query's lists there, added up, reach the
        threshold. Only postings in the blocks that are left are scored.
        """
        slack = threshold - 1e-9  # sums in another order differ in the last digits
        ordered = np.sort(queries, axis=1)
        fresh = ordered >= 0
        fresh[:, 1:] &= ordered[:, 1:] != ordered[:, :-1]
        query, term = np.nonzero(fresh)[0], ordered[fresh]
        pivots = np.bincount(query, self.most[term], len(queries)) >= slack
        some = pivots[query]
        query, term = query[some], term[some]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # As many queries at once as have a bounded number of parts, and one at least.
        work = np.bincount(query, self.parts[term], len(queries)) + self.blocks
        group = (np.cumsum(work) // MOST_PARTS).astype(np.int64)
        for first, last in zip(*self._runs(group), strict=True):
            inside = slice(*np.searchsorted(query, (first, last)))
            found.append(self._search(query[inside] - first, term[inside], last - first, slack))
            found[-1] = (found[-1][0] + first, *found[-1][1:])
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return tuple(np.concatenate(columns) for columns in zip(*found, strict=True))

    @staticmethod
    def _runs(group: np.ndarray) -> tuple[list[int], list[int]]:
        starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
        return starts, [*starts[1:], len(group)] if starts else []

    def _search(self, query: np.ndarray, term: np.ndarray, queries: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = _ranges(self.first_part[term], self.parts[term])
        at = np.repeat(query, self.parts[term]) * self.blocks + self.part_block[part]
        reached = np.bincount(at, self.part_most[part], queries * self.blocks) >= slack
        kept = reached[at]
        part, at = part[kept], at[kept]
        # Scores of the entries of these blocks only.
        blocks = np.flatnonzero(reached)
        place = (np.cumsum(reached) - 1)[at] * BLOCK
        size = self.part_size[part]
        posting = _ranges(self.part_first[part], size)
        score = np.bincount(np.repeat(place, size) + self.entry[posting] % BLOCK, self.weight[posting], len(blocks) * BLOCK)
        hits = np.flatnonzero(score >= slack)
        block = blocks[hits // BLOCK]
        return block // self.blocks, self.original[block % self.blocks * BLOCK + hits % BLOCK].astype(np.int64), score[hits]

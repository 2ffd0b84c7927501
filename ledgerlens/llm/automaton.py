"""Suffix automata of word sequences, and matching statistics against them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

NOBODY = 1 << 63


class SuffixAutomaton:
    """All word sequences that stand in a set of segments, each with its smallest owner.

    A state stands for the sequences that end at the same places; `link` leads
    to the state of their longest suffix that ends at more places. Memory is
    linear in the number of words.
    """

    def __init__(self, segments: Iterable[tuple[int, Sequence[str]]]):
        self.words: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owner = [NOBODY]
        for owner, segment in segments:
            last = 0
            for word in segment:
                last = self._extend(last, self.words.setdefault(word, len(self.words)), owner)
        # A sequence ends wherever a longer one that it is a suffix of does.
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            parent = self.link[state]
            self.owner[parent] = min(self.owner[parent], self.owner[state])

    def _state(self, moves: dict[int, int], link: int, length: int, owner: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A state for the sequences of `target` that one from `state` reaches, the shorter ones."""
        clone = self._state(dict(self.next[target]), self.link[target], self.length[state] + 1, NOBODY)
        self.link[target] = clone
        while state != -1 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int, owner: int) -> int:
        known = self.next[last].get(word)
        if known is not None:  # an earlier segment holds this prefix
            if self.length[known] != self.length[last] + 1:
                known = self._split(last, word, known)
            self.owner[known] = min(self.owner[known], owner)
            return known
        state = self._state({}, 0, self.length[last] + 1, owner)
        while last != -1 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last != -1:
            target = self.next[last][word]
            if self.length[target] != self.length[last] + 1:
                target = self._split(last, word, target)
            self.link[state] = target
        return state

    def owners(self, words: Iterable[str], window: int) -> Iterator[tuple[int, int]]:
        """For each place where a sequence of `window` words ends that stands in a segment: place and smallest owner.

        The longest match that ends at each place (the matching statistic) is
        followed from word to word, and cut to `window` words.
        """
        following, link, length, known = self.next, self.link, self.length, self.words.get
        state = matched = 0
        for place, word in enumerate(words):
            number = known(word)
            if number is None:
                state = matched = 0
                continue
            target = following[state].get(number)
            while target is None and state:
                state = link[state]
                matched = length[state]
                target = following[state].get(number)
            if target is None:
                continue
            state, matched = target, matched + 1
            if matched >= window:
                matched = window
                while length[link[state]] >= window:
                    state = link[state]
                yield place, self.owner[state]

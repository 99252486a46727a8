"""Suffix automaton over word sequences, with the smallest label of the sequences each of its substrings occurs in."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class SuffixAutomaton:
    """Add sequences with their labels, then finish(); matching() gives what each place of another sequence matches."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.label = [-1], [0], [None]

    def _state(self, length: int, follow: dict, link: int, label) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.label.append(label)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state of the longest string that ends the transition p -> q, apart from longer ones in q."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.label[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: Sequence, label) -> None:
        follow, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            q = follow[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            else:
                now, p = self._state(length[last] + 1, {}, 0, None), last
                while p >= 0 and (q := follow[p].get(word)) is None:
                    follow[p][word] = now
                    p = link[p]
                if p >= 0:
                    link[now] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                last = now
            if self.label[last] is None or label < self.label[last]:
                self.label[last] = label

    def finish(self) -> SuffixAutomaton:
        """Labels go from each state to those of its suffixes."""
        label, link = self.label, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            p = link[s]
            if p > 0 and (label[p] is None or label[s] < label[p]):
                label[p] = label[s]
        return self

    def matching(self, words: Sequence) -> Iterator[int]:
        """Matching statistics: length of the longest suffix at each word that occurs in a sequence."""
        at = size = 0
        for word in words:
            at, size = self._step(at, size, word)
            yield size

    def _step(self, at: int, size: int, word) -> tuple[int, int]:
        follow = self.next
        while at and word not in follow[at]:
            at = self.link[at]
            size = self.length[at]
        if word in follow[at]:
            return follow[at][word], size + 1
        return 0, 0

    def windows(self, words: Sequence, n: int) -> Iterator:
        """For each run of n words the smallest label of a sequence that holds it, else None."""
        at = size = 0
        for i, word in enumerate(words, 1):
            at, size = self._step(at, size, word)
            while at and self.length[self.link[at]] >= n:
                at = self.link[at]
                size = self.length[at]
            if i >= n:
                yield self.label[at] if size >= n else None

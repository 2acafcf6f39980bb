"""Levenshtein automata of all lexicon terms, intersected with their trie and
determinised: one table walk per word tells the nearest term."""

from __future__ import annotations

from collections import deque

import numpy as np


class Automaton:
    """Accepts words at most one edit (of bytes) from a term, or that start with a stem.

    ``terms``: bytes. Terms of fewer than ``fuzzy_from`` bytes must match
    exactly, and the first byte always does. ``stems``: bytes that any ending
    may follow. State 0 is dead; ``term``, ``errors`` describe a state that
    accepts (term -1: none; stems are numbered after the terms).

    ``wide``: an edit may also swap two neighbours, put one character of several
    bytes in or in place of a term's byte, and leave the first byte out or put a digit
    in its place.
    """

    def __init__(self, terms: list[bytes], stems: list[bytes], fuzzy_from: int = 5, wide: bool = False):
        self.terms, self.stems = terms, stems
        alphabet = sorted({b for t in (*terms, *stems) for b in t})
        self.classes = np.zeros(256, np.int64)
        for k, b in enumerate(alphabet):
            self.classes[b] = k + 1
        digit, later = len(alphabet) + 1, len(alphabet) + 2
        for b in (*range(0x30, 0x3A), *range(0x80, 0xC0)):
            if wide and not self.classes[b]:
                self.classes[b] = digit if b < 0x80 else later
        width = len(alphabet) + (3 if wide else 1)
        #: Classes of bytes that only go on with a character.
        inside = {int(c) for c in self.classes[0x80:0xC0]} if wide else set()
        digits = {int(c) for c in self.classes[0x30:0x3A]} if wide else set()
        children: list[dict[int, int]] = []
        word_at: dict[int, int] = {}
        stem_at: dict[int, int] = {}

        def trie() -> int:
            children.append({})
            return len(children) - 1

        def insert(root: int, text: bytes) -> int:
            node = root
            for b in text:
                c = int(self.classes[b])
                if c not in children[node]:
                    children[node][c] = trie()
                node = children[node][c]
            return node

        exact, fuzzy, prefix = trie(), trie(), trie()
        for i, t in enumerate(terms):
            word_at.setdefault(insert(fuzzy if len(t) >= fuzzy_from else exact, t), i)
        for i, t in enumerate(stems):
            stem_at.setdefault(insert(prefix, t), len(terms) + i)
        in_fuzzy = set()
        queue = deque([fuzzy])
        while queue:
            node = queue.popleft()
            in_fuzzy.add(node)
            queue.extend(children[node].values())

        def close(states: set[tuple[int, int]]) -> frozenset:
            """With the terms' bytes that may be left out; of a node only the fewest errors."""
            least: dict[int, int] = {}
            for node, e in states:
                least[node] = min(e, least.get(node, 9))
            for node, e in list(least.items()):
                if e == 0 and node in in_fuzzy and (wide or node != fuzzy):
                    for child in children[node].values():
                        least.setdefault(child, 1)
            return frozenset(least.items())

        swapped: dict[tuple[int, int, int], int] = {}

        def swap(before: int, c: int, after: int) -> int:
            """A node that only ``before`` leads on from, to ``after``; ``c`` came first."""
            if (before, c, after) not in swapped:
                swapped[before, c, after] = trie()
                children[swapped[before, c, after]][before] = after
            return swapped[before, c, after]

        start = close({(exact, 0), (fuzzy, 0), (prefix, 0)})
        number, rows, order = {frozenset(): 0, start: 1}, [np.zeros(width, np.int32)], deque([start])
        accepting: list[tuple[int, int, bool]] = [(-1, 0, False)]
        while order:
            state = order.popleft()
            stem = next((stem_at[n] for n, e in state if n in stem_at), None)
            hits = sorted((e, word_at[n]) for n, e in state if n in word_at)
            accepting.append((stem, 0, True) if stem is not None and not (hits and hits[0][0] == 0) else (hits[0][1], hits[0][0], False) if hits else (-1, 0, False))
            row = np.zeros(width, np.int32)
            if stem is None:
                for c in range(width):
                    to: set[tuple[int, int]] = set()
                    for node, e in state:
                        child = children[node].get(c)
                        if child is not None:
                            to.add((child, e))
                        if e == 0 and node in in_fuzzy and node != fuzzy:
                            to.add((node, 1))
                            to.update((x, 1) for x in children[node].values() if x != child)
                        if wide and e == 0 and node in in_fuzzy:
                            if node == fuzzy and c in digits:
                                to.update((x, 1) for x in children[node].values() if x != child)
                            to.update((swap(b, c, children[m][c]), 1) for b, m in children[node].items() if b != c and c in children[m])
                        if wide and e == 1 and node in in_fuzzy and c in inside:
                            to.add((node, 1))
                    target = close(to)
                    if target not in number:
                        number[target] = len(number)
                        order.append(target)
                    row[c] = number[target]
            rows.append(row)
        self.next = np.concatenate(rows)
        self.width = width
        self.term = np.array([a[0] for a in accepting], np.int32)
        self.errors = np.array([a[1] for a in accepting], np.int8)
        self.absorbs = np.array([a[2] for a in accepting], bool)
        self.longest = max(map(len, (*terms, *stems)), default=0) + (4 if wide else 1)

    def match(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, errors) of every word that is accepted."""
        words, found = [], []
        own, state = np.arange(len(starts)), np.ones(len(starts), np.int32)
        for k in range(self.longest + 1):
            done = size[own] == k
            stop = self.absorbs[state] | done
            if stop.any():
                words.append(own[stop])
                found.append(state[stop])
                own, state = own[~stop], state[~stop]
            if not len(own):
                break
            state = self.next[state * self.width + self.classes[data[starts[own] + k]]]
            alive = state > 0
            own, state = own[alive], state[alive]
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int8)
        word, state = np.concatenate(words), np.concatenate(found)
        keep = self.term[state] >= 0
        word, state = word[keep], state[keep]
        back = np.argsort(word)
        return word[back], self.term[state[back]], self.errors[state[back]]

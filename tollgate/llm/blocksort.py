"""Suffixes of a block of text in order, to a given depth, by a difference cover.

Positions on a difference cover modulo v (:func:`tollgate.llm.cover.difference_cover`)
are the block's *sample*. Its suffixes are ranked first, by doubling: two sample
positions stay on the cover when both move by a multiple of v, so ranks to depth
2h come from pairs of ranks to depth h. Any two suffixes i and j then have a
shift d < v that puts i + d and j + d on the sample: they are compared by v
bytes, by the ranks there, and by the few bytes that are left. All comparisons
are of bytes or of ranks, none of hashes, and memory is that of the block.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from tollgate.llm.cover import difference_cover


@lru_cache(maxsize=4)
def shifts(q: int) -> np.ndarray:
    """For each two residues the least shift that puts both on the cover."""
    v, cover = difference_cover(q)
    on = np.zeros(v, bool)
    on[cover] = True
    moved = on[(np.arange(v)[:, None] + np.arange(v)[None, :]) % v]
    return (moved[:, None, :] & moved[None, :, :]).argmax(axis=2).astype(np.int64)


class Runs:
    """Positions in order, in runs of those that are equal so far. ``slot`` is each
    one's place among all, also of those dropped."""

    def __init__(self, at: np.ndarray, slot: np.ndarray):
        self.at, self.slot = at, slot
        self.head = np.zeros(len(at), bool)
        self.head[:1] = True

    def lead(self) -> np.ndarray:
        """Index of the first of each position's run."""
        return np.maximum.accumulate(np.where(self.head, np.arange(len(self.at)), 0))

    def refine(self, key: np.ndarray) -> None:
        """Sort each run by a key and split it; runs with one key stay as they are."""
        run = np.cumsum(self.head) - 1
        if len(run) and run[-1] == 0:
            own, order = np.arange(len(run)), np.argsort(key)
        else:
            mixed = np.zeros(int(self.head.sum()), bool)
            mixed[run[key != key[self.lead()]]] = True
            own = np.flatnonzero(mixed[run])
            order = np.lexsort((key[own], run[own]))
        self.at[own], key = self.at[own[order]], key[own[order]]
        new = self.head[own]
        new[1:] |= key[1:] != key[:-1]
        self.head[own] = new

    def drop_alone(self) -> None:
        own = self.part(~(self.head & np.append(self.head[1:], True))) if len(self.at) else self
        self.at, self.slot, self.head = own.at, own.slot, own.head

    def part(self, keep: np.ndarray) -> Runs:
        """Some whole runs."""
        out = Runs(self.at[keep], self.slot[keep])
        out.head = self.head[keep]
        return out


class Block:
    """Text whose suffixes are compared to ``depth`` bytes; each suffix that is
    asked for has that many."""

    def __init__(self, text: np.ndarray, depth: int, q: int = 5):
        self.v, cover = difference_cover(q)
        if self.v >= depth:
            raise ValueError("the cover's period must be below the depth")
        self.depth, self.shift, self.words = depth, shifts(q), -(-self.v // 8)
        #: Bytes compared one by one at either end, v or more of a long enough suffix.
        self.head = min(8 * self.words, depth // 8 * 8)
        body = np.concatenate([text, np.zeros(depth + 8 * self.words + 8, np.uint8)])
        #: Eight bytes from each position, as a number that sorts like them.
        self.eight = np.ndarray((len(body) - 7,), ">u8", body, strides=(1,))
        self.rank = self._sample_ranks(len(text), cover)

    def word(self, at: np.ndarray) -> np.ndarray:
        return self.eight[at].astype(np.uint64)

    def _sample_ranks(self, size: int, cover: np.ndarray) -> np.ndarray:
        """Rank of each sample position's next depth - v + 1 bytes, equal for equal ones."""
        wanted = self.depth - self.v + 1
        at = (np.arange(0, size + 1, self.v)[:, None] + cover[None, :]).ravel()
        # Those near the end are ranked with zeros behind; no suffix asked for reaches there.
        at = at[at <= size]
        rank = np.zeros(size + self.depth + 1, np.int32)
        own = Runs(at, np.arange(len(at)))

        def refine(key) -> None:
            # A rank is the place of its run's first member, so ranks that are alone stay.
            own.refine(key(own.at))
            rank[own.at] = own.slot[own.lead()] + 1
            own.drop_alone()

        done = min(8 * self.words, wanted)
        for k in range(0, done, 8):
            if wanted >= 8:
                refine(lambda at, k=k: self.word(at + min(k, wanted - 8)))
            else:
                refine(lambda at: self.word(at) >> np.uint64(8 * (8 - wanted)))
        while done < wanted:
            step = min(done, wanted - done) // self.v * self.v
            if step:
                refine(lambda at, step=step: rank[at + step])
                done += step
            else:
                for k in range(8 * self.words, 0, -8):
                    refine(lambda at, k=k: self.word(at + wanted - k))
                done = wanted
        return rank

    def compare(self, i: np.ndarray, j: np.ndarray, head: bool = True) -> np.ndarray:
        """-1, 0 or 1 for each two suffixes: their order by ``depth`` bytes. Without
        ``head`` their first v bytes are known to be equal."""
        out = np.zeros(len(i), np.int8)
        rest = np.arange(len(i))

        def settle(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal rest
            out[rest] = (a > b).astype(np.int8) - (a < b)
            rest = rest[a == b]

        for k in range(0, self.head if head else 0, 8):
            settle(self.word(i[rest] + k), self.word(j[rest] + k))
        d = self.shift[i[rest] % self.v, j[rest] % self.v]
        settle(self.rank[i[rest] + d], self.rank[j[rest] + d])
        # What the ranks don't reach, v - 1 bytes at most.
        for k in range(self.head, 0, -8):
            settle(self.word(i[rest] + self.depth - k), self.word(j[rest] + self.depth - k))
        return out

    def _merge_sort(self, at: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each run at[start : start + size], equal in the first v bytes, in order; all runs advance together."""
        run = np.repeat(np.arange(len(start)), size)
        place = np.arange(len(at)) - start[run]
        width = 1
        while width < int(size.max(initial=0)):
            own = np.flatnonzero(size[run] > width)
            base, n, x = start[run[own]], size[run[own]], place[own]
            block = x // width
            other = base + np.minimum((block ^ 1) * width, n)
            lo, hi = other.copy(), base + np.minimum(((block ^ 1) + 1) * width, n)
            right = block % 2 == 1
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                middle = (lo[open_] + hi[open_]) // 2
                sign = self.compare(at[middle], at[own[open_]], False)
                after = (sign < 0) | (sign == 0) & right[open_]
                lo[open_[after]] = middle[after] + 1
                hi[open_[~after]] = middle[~after]
                open_ = open_[lo[open_] < hi[open_]]
            to = base + (block & ~1) * width + x % width + lo - other
            moved = at.copy()
            moved[to] = at[own]
            at = moved
            width *= 2
        return at

    def classes(self, at: np.ndarray, bucket: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes at ``at`` that may have an equal one, and the number of each
        one's class of equal ones; those left out are alone. Equal ones are known to
        be in the same ``bucket`` (a number below 2^24), if that is given."""
        first = self.word(at) >> np.uint64(24)
        if bucket is not None:
            first |= bucket.astype(np.uint64) << np.uint64(40)
        own = Runs(at.copy(), np.arange(len(at)))
        own.refine(first)
        own.drop_alone()
        for k in range(0, self.head, 8):
            own.refine(self.word(own.at + k))
            own.drop_alone()
        # Where all of a run have one residue, so that one shift fits, ranks are plain keys.
        residue = own.at % self.v
        run = np.cumsum(own.head) - 1
        odd = np.zeros(int(own.head.sum()), bool)
        odd[run[residue != residue[own.lead()]]] = True
        rest = own.part(odd[run])
        own = own.part(~odd[run])
        residue = own.at % self.v
        own.refine(self.rank[own.at + self.shift[residue, residue]])
        own.drop_alone()
        for k in range(self.head, 0, -8):
            own.refine(self.word(own.at + self.depth - k))
            own.drop_alone()
        # The others: those that aren't all equal anyway are sorted by comparison.
        run = np.cumsum(rest.head) - 1
        mixed = np.zeros(int(rest.head.sum()), bool)
        mixed[run[self.compare(rest.at, rest.at[rest.lead()], False) != 0]] = True
        some = np.flatnonzero(mixed[run])
        if len(some):
            n = np.bincount(run)[mixed]
            rest.at[some] = self._merge_sort(rest.at[some], np.cumsum(n) - n, n)
            follows = some[~rest.head[some]]
            rest.head[follows] = self.compare(rest.at[follows - 1], rest.at[follows], False) != 0
        return np.concatenate([own.at, rest.at]), np.cumsum(np.concatenate([own.head, rest.head])) - 1

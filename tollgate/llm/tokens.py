"""Token ids of whole texts by the tokenizers library, with a memo of words."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from tollgate.llm.symbols import hash_words

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
# UTF-8 of white space beyond ASCII, as (first bytes, last bytes).
_WIDE = ((b"\xc2", (0x85, 0xA0)), (b"\xe1\x9a", (0x80,)), (b"\xe2\x80", (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (b"\xe2\x81", (0x9F,)), (b"\xe3\x80", (0x80,)))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Memo:
    """Ids of words by a 64-bit hash, checked by size and first eight bytes; all arrays."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.n, self.used = 0, 0
        self.keys, self.heads = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)
        self.size, self.start, self.count = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.uint32)
        self._table(1 << 13)

    def _table(self, size: int) -> None:
        self.table = np.full(size, -1, np.int32)
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self._place(np.arange(self.n, dtype=np.int32))

    def _place(self, own: np.ndarray) -> None:
        slot = (self.keys[own] >> self.shift).astype(np.int64)
        while len(own):
            free = self.table[slot] < 0
            self.table[slot[free]] = own[free]
            lost = self.table[slot] != own
            own, slot = own[lost], (slot[lost] + 1) & (len(self.table) - 1)

    def find(self, key: np.ndarray, size: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Number of each word in the memo; -1 where it isn't there."""
        slot = (key >> self.shift).astype(np.int64)
        out = self.table[slot]
        held = np.flatnonzero(out >= 0)
        while len(held):
            i = out[held]
            wrong = (self.keys[i] != key[held]) | (self.size[i] != size[held]) | (self.heads[i] != head[held])
            held = held[wrong]
            slot[held] = (slot[held] + 1) & (len(self.table) - 1)
            out[held] = self.table[slot[held]]
            held = held[out[held] >= 0]
        return out

    def add(self, key: np.ndarray, size: np.ndarray, head: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        n, m = self.n, len(key)
        for name in ("keys", "heads", "size", "start", "count"):
            a = getattr(self, name)
            if len(a) < n + m:
                setattr(self, name, np.concatenate([a, np.zeros(max(len(a), m), a.dtype)]))
        if len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.keys[n : n + m], self.heads[n : n + m], self.size[n : n + m], self.count[n : n + m] = key, head, size, count
        self.start[n : n + m] = self.used + np.cumsum(count) - count
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = n + m, self.used + len(ids)
        if 2 * self.n > len(self.table):
            self._table(1 << (4 * self.n - 1).bit_length())
        else:
            self._place(np.arange(n, n + m, dtype=np.int32))


class Encoder:
    """Encodes with a byte-level BPE file; each distinct word is encoded once.

    The pre-tokenizer never joins what stands before a single space with what
    follows it, so a text's ids are those of its space-separated words (with the
    space in front), one after the other. Words not in the memo are encoded in
    one call; a token that starts with a space marks where each one begins. The
    memo is emptied when it is full. Texts with white space beyond ASCII or with
    a special token's string, and files of another kind, are encoded plainly.
    """

    def __init__(self, path: str, memo: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before = kind.get("pre_tokenizer") or {}
        self.splits = not kind.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.special = [t["content"].encode() for t in kind.get("added_tokens", ())]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.spaced = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.spaced[i] = token.startswith("Ġ")
        self.memo = Memo(memo)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of words, in order; ``spaced``: each has one space, in front of something."""
        if spaced:
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(words):
                return np.diff(starts, append=len(ids)).astype(np.int32), ids
        own = self._plain([w.decode() for w in words])
        return np.array([len(x) for x in own], np.int32), np.concatenate(own)

    def _odd(self, raw: bytes, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which documents must be encoded plainly."""
        places = []
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                places.append(at)
                at = raw.find(s, at + 1)
        for first, last in _WIDE:
            if first in raw:
                at = np.flatnonzero(data[: len(data) - len(first)] == first[0])
                if len(first) == 2:
                    at = at[data[at + 1] == first[1]]
                at = at[at + len(first) < len(data)]
                places += at[np.isin(data[at + len(first)], last)].tolist()
        out = np.zeros(len(offsets) - 1, bool)
        if places:
            out[np.searchsorted(offsets, np.array(places), "right") - 1] = True
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block one after the other, and each one's first (with the total)."""
        n, raw = len(offsets) - 1, data.tobytes()
        if not self.splits:
            own = self._plain([raw[a:b].decode() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)])
            return np.concatenate([np.zeros(0, np.uint32), *own]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        odd = self._odd(raw, data, offsets)
        white = np.ones(len(data) + 2, bool)
        white[1:-1] = _WHITE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        # Words begin at documents and at single spaces that stand between other characters.
        begin = np.zeros(len(data) + 1, bool)
        begin[:-1] = (data == 32) & ~white[:-2] & ~white[2:] & ~edge[:-1] & ~edge[1:]
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        word_of = np.searchsorted(starts, offsets)
        if odd.any():
            keep = ~np.repeat(odd, np.diff(word_of))
            starts, ends = starts[keep], ends[keep]
            word_of = np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(word_of)))])
        size = (ends - starts).astype(np.int32)
        key = hash_words(data, starts, ends)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        head = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[starts] if len(starts) else np.zeros(0, np.uint64)
        short = size < 8
        head[short] &= (np.uint64(1) << (np.uint64(8) * size[short].astype(np.uint64))) - np.uint64(1)
        if self.memo.n > self.memo.limit:
            self.memo.clear()
        which = self.memo.find(key, size, head)
        miss = np.flatnonzero(which < 0)
        if len(miss):
            _, first = np.unique(key[miss], return_index=True)
            new = miss[np.sort(first)]
            spaces = np.concatenate([[0], np.cumsum(data == 32)])
            one = (data[starts[new]] == 32) & (size[new] > 1) & (spaces[ends[new]] - spaces[starts[new]] == 1)
            for spaced in (True, False):
                own = new[one == spaced]
                for lo in range(0, len(own), 50_000):
                    part = own[lo : lo + 50_000]
                    count, ids = self._learn([raw[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)], spaced)
                    self.memo.add(key[part], size[part], head[part], count, ids)
            which[miss] = self.memo.find(key[miss], size[miss], head[miss])
        count = self.memo.count[which].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.memo.ids[np.repeat(self.memo.start[which] - total[:-1], count) + np.arange(total[-1])]
        first = total[word_of]
        if not odd.any():
            return ids, first
        own = dict(zip(np.flatnonzero(odd).tolist(), self._plain([raw[offsets[i] : offsets[i + 1]].decode() for i in np.flatnonzero(odd)]), strict=True))
        parts = [own[i] if i in own else ids[first[i] : first[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path)

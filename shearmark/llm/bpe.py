"""Byte-pair merging of many words at once, on ragged numpy arrays.

``RankMerger`` holds one vocabulary file of the ``tokenizers`` library (byte-level alphabet, with or without a
word-end suffix).  All words of a batch lie in one flat symbol array; every round finds the lowest-ranked pair
of *each* word and applies it at all its places simultaneously, so the number of numpy calls depends on the
longest chain of merges, not on the number of words.
"""

from __future__ import annotations

import json

import numpy as np

NO_PAIR = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class RankMerger:
    """Merge table of a vocabulary file; ``merge`` turns words (bytes) into token ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_alphabet()
        self.first = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self._fill(left, right)

    def _fill(self, left: np.ndarray, right: np.ndarray, bits: int = 19) -> None:
        """Open-addressing table of the pairs: slot -> key, rank.  Earlier (lower) ranks win a repeated pair."""
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        keys, ranks = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NO_PAIR, dtype=np.int32)
        waiting, key = np.arange(len(left)), (left << 20) | right
        waiting = np.sort(np.unique(key, return_index=True)[1])
        slot, probes = self._slot(key[waiting]), 0
        while len(waiting):
            probes += 1
            free = keys[slot] == -1
            taken, where = np.unique(slot[free], return_index=True)
            chosen = waiting[free][where]
            keys[taken], ranks[taken] = key[chosen], chosen
            stay = keys[slot] != key[waiting]
            waiting, slot = waiting[stay], (slot[stay] + 1) & self.mask
        self.keys, self.ranks, self.probes = keys, ranks, probes

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_PAIR where the vocabulary has no such merge."""
        key = (left.astype(np.int64) << 20) | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NO_PAIR)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):  # a few collisions probe on
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all words in order, number of tokens of each word)."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.first[raw]
        ends = np.cumsum(sizes)
        full = np.flatnonzero(sizes)
        symbols[ends[full] - 1] = self.last[raw[ends[full] - 1]]
        # word: of each live symbol; a word leaves the arrays as soon as no pair of it can merge
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        done_ids, done_words = [], []
        ranks = np.full(len(symbols), NO_PAIR, dtype=np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(word)])
            lowest = np.minimum.reduceat(ranks, starts)
            live = lowest != NO_PAIR
            if not live.all():
                stays = np.repeat(live, lengths)
                done_ids.append(symbols[~stays])
                done_words.append(word[~stays])
                symbols, word, ranks = symbols[stays], word[stays], ranks[stays]
                lowest, lengths = lowest[live], lengths[live]
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == np.repeat(lowest, lengths))
            near = np.flatnonzero(np.diff(at) == 1)
            if len(near):  # a run like "aaa": every second place, from the left
                head = np.r_[True, np.diff(at) != 1]
                begin = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            ranks[at] = -1
            symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
            marked = ranks == -1
            marked[:-1] |= marked[1:]  # the pair on the left has changed as well
            stale = np.flatnonzero(marked)
            inside = stale[stale < len(word) - 1]
            inside = inside[word[inside] == word[inside + 1]]
            ranks[stale] = NO_PAIR
            ranks[inside] = self.rank(symbols[inside], symbols[inside + 1])
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, dtype=np.int32)
        owner = np.concatenate(done_words) if done_words else np.zeros(0, dtype=np.int32)
        ids = ids[np.argsort(owner, kind="stable")]
        return ids, np.bincount(owner, minlength=len(words)).astype(np.int64)

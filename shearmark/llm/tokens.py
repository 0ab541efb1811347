"""Token ids of whole texts, with each distinct space-delimited unit encoded once per batch.

Both vocabularies used here never join characters across a single space, so a text is cut at its spaces by Arrow,
the distinct units of a batch are merged together (``bpe.RankMerger``) and the ids are gathered back to the texts.
A bounded cache keeps units over batches.  Ids equal those of the ``tokenizers`` library, which itself encodes
whatever falls outside the plain rules (see ``ByteBpe`` and ``WordBpe``).
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .bpe import RankMerger

CACHE_UNITS = 300_000
SLICE_BYTES = 16 << 20
_SPECIAL = re.compile(r"<\|(?:endoftext|startoftext)\|>")
# Characters on which Python's and the library's lower-casing, composition and white space agree by construction.
_NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xff]")
_encoders: dict[str, "UnitEncoder"] = {}


def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class UnitEncoder:
    """Encodes texts unit by unit; subclasses say what a unit's words are."""

    leads = False  # whether a unit takes the space before it along

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        self.merger, self.path, self.limit, self._library = RankMerger(path), path, cache_units, None
        self._reset()

    def _reset(self) -> None:
        self.slots: dict[str, int] = {}
        self.lens, self.starts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        self.joined = np.zeros(0, bool)  # units whose text must be encoded whole

    def words(self, unit: str) -> list[bytes] | None:
        """The unit's words in order, or None if only the library may encode it."""
        raise NotImplementedError

    def whole(self, key: str) -> bool:
        """Whether a text that holds this unit must be encoded in one piece."""
        return False

    def encode_alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of texts or units, without the cache: distinct words are merged once."""
        gc.disable()  # hundreds of thousands of short-lived lists, none of them in a cycle
        found = list(map(self.words, texts))
        gc.enable()
        strange = [i for i, words in enumerate(found) if words is None]
        for i in strange:
            found[i] = ()
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(texts))
        distinct = pc.dictionary_encode(pa.array(chain.from_iterable(found), type=pa.binary()))
        ids, lens = self.merger.merge(distinct.dictionary.to_pylist())
        starts = np.cumsum(lens) - lens
        picked = distinct.indices.to_numpy()
        sizes = sums(lens[picked], np.cumsum(counts) - counts, counts)
        out = gather(ids, starts[picked], lens[picked]).astype(np.uint16)
        if strange:
            out, sizes = self._with_library(texts, strange, out, sizes)
        return out, sizes

    def _with_library(self, texts, strange, ids, sizes):
        if self._library is None:
            self._library = library(self.path)
        found = self._library.encode_batch_fast([texts[i] for i in strange], add_special_tokens=False)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for i, e in zip(strange, found, strict=True):
            parts[i] = np.array(e.ids, dtype=np.uint16)
            sizes[i] = len(parts[i])
        return np.concatenate(parts), sizes

    def _slots_of(self, units: list[str], keys: list[str]) -> np.ndarray:
        """Cache slots of units, encoding those not met before."""
        slots = np.fromiter((self.slots.get(k, -1) for k in keys), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(slots < 0)
        for at in range(0, len(new), 50_000):
            part = new[at:at + 50_000]
            ids, lens = self.encode_alone([units[i] for i in part])
            base = len(self.lens)
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lens) - lens]
            self.lens, self.flat = np.r_[self.lens, lens], np.r_[self.flat, ids]
            self.joined = np.r_[self.joined, np.fromiter((self.whole(keys[i]) for i in part), dtype=bool, count=len(part))]
            slots[part] = np.arange(base, base + len(part))
            self.slots.update((keys[i], base + n) for n, i in enumerate(part))
        return slots

    def _text_slots(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot of every unit, first unit of every text, texts to be encoded whole)."""
        if len(self.slots) > self.limit:
            self._reset()
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        units = pc.dictionary_encode(lists.values)
        codes = units.indices.to_numpy().astype(np.int64)
        distinct = units.dictionary.to_pylist()
        rest = [" " + u for u in distinct] if self.leads else distinct
        slots = self._slots_of(rest, rest)[codes]
        odd = np.zeros(len(texts), dtype=bool)
        if self.leads:  # the first unit of a text has no space before it
            heads, inverse = np.unique(codes[offsets[:-1]], return_inverse=True)
            names = [distinct[c] for c in heads]
            slots[offsets[:-1]] = self._slots_of(names, ["\0" + n for n in names])[inverse]
            if self.joined.any():
                odd = np.logical_or.reduceat(self.joined[slots], offsets[:-1])
        return slots, offsets, odd

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text."""
        if not len(texts):
            return np.zeros(0, dtype=np.int64)
        slots, offsets, odd = self._text_slots(texts)
        out = np.add.reduceat(self.lens[slots], offsets[:-1])
        if odd.any():
            out[odd] = self.encode_alone(texts.filter(pa.array(odd)).to_pylist())[1]
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if not len(texts):
            return np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.int64)
        slots, offsets, odd = self._text_slots(texts)
        sizes = np.add.reduceat(self.lens[slots], offsets[:-1])
        ids = gather(self.flat, self.starts[slots], self.lens[slots])
        if odd.any():
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            own, lens = self.encode_alone(texts.filter(pa.array(odd)).to_pylist())
            for i, part in zip(np.flatnonzero(odd), np.split(own, np.cumsum(lens)[:-1]), strict=True):
                parts[i] = part
            ids, sizes[odd] = np.concatenate(parts), lens
        return ids, sizes


class ByteBpe(UnitEncoder):
    """byte_bpe_50k.json: nothing is normalised; a special string inside a text is its own token."""

    leads = True
    # Fixed value: the pattern that splits text before the merges.
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def words(self, unit: str) -> list[bytes] | None:
        if unit[1:].isalpha() and unit[:1] == " ":
            return [unit.encode()]
        if "<|endoftext|>" in unit:
            return None
        return [w.encode() for w in self.pattern.findall(unit)]

    def whole(self, key: str) -> bool:
        # a space beside more white space is not a cut: "\s+(?!\S)" looks over it
        unit = key[1:]
        return unit == "" and key[0] == " " or unit[:1].isspace() and key[0] == " " or unit[-1:].isspace()


class WordBpe(UnitEncoder):
    """word_bpe_49k.json: composed, lower-cased, white space dropped; other than plain characters by the library."""

    # Fixed value: the pattern that splits text before the merges.
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def words(self, unit: str) -> list[bytes] | None:
        if _NOT_PLAIN.search(unit) or _SPECIAL.search(unit):
            return None
        unit = unit.lower()
        if unit.isalpha():
            return [unit.encode()]
        return [w.encode() for w in self.pattern.findall(unit)]


def sums(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each slice of ``values``; empty slices give 0."""
    total = np.r_[0, np.cumsum(values)]
    return total[starts + counts] - total[starts]


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + len], one after the other."""
    ends = np.cumsum(lens)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1])]


def encoder(kind: str, path: str, cache_units: int = CACHE_UNITS) -> UnitEncoder:
    """The worker's encoder of a file; Python workers keep it, and its bounded cache, over tasks."""
    key = f"{kind}:{path}:{cache_units}"
    if key not in _encoders:
        _encoders[key] = {"byte": ByteBpe, "word": WordBpe}[kind](path, cache_units)
    return _encoders[key]


def pieces_of(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes, so that memory does not grow with text length."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # idle workers would keep it beside the next stage's


def texts_of(batch: pa.RecordBatch, text: str) -> pa.Array:
    return pc.fill_null(batch.column(text), "")

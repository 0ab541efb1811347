import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import array
from pyspark.sql import functions as F

from shearmark.llm import packing, token_counts, token_files
from shearmark.llm.bpe import RankMerger
from shearmark.llm.tokens import encoder, library

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
FILES = {"byte": BYTE, "word": WORD}
TEXTS = ["", " ", "  ", "a", "a b", " a", "a  b", "a ", "a \nb", "a\n b", "\n a", "  a", "it's they're I'LL", "x<|endoftext|> y",
         "<|startoftext|>", "a  <|endoftext|> b", "É È é", "ﬁ İ ǅ ΑΣ", "日本語 テスト", "a" * 3000, "a\x1cb", "x \x85 y", "q\tr\t s",
         "12 345, 6.7!", "naïve café", " x 　y", "ab" * 700 + " " + "xyz " * 900]
ROWS = [(i, t, "n", "s") for i, t in enumerate(TEXTS)] + [(100, None, None, None), (7, "twice", "", ""), (7, "twice", "", ""),
                                                         (None, "no key", "", ""), (101, "long " * 60000, "", "")]
SCHEMA = "doc_id long, text string, n_tokens string, start string"


@pytest.fixture(scope="module")
def libraries():
    return {k: library(p) for k, p in FILES.items()}


def ids_of(tool, text):
    return tool.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_ids_equal_the_library(kind, libraries):
    ids, sizes = encoder(kind, FILES[kind]).ids(array(TEXTS))
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    for text, part in zip(TEXTS, parts, strict=True):
        assert part.tolist() == ids_of(libraries[kind], text), repr(text[:50])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abeèß'st ABC01 \n\t.,!-<|>", "<|endoftext|>", "e\u0301", "é", "日", "\u3000", "ſ", "½"]),
                         max_size=40).map("".join), min_size=1, max_size=8))
def test_ids_equal_the_library_for_any_text(texts):
    for kind, path in FILES.items():
        tool = encoder(kind, path)
        want = [e.ids for e in library_of(path).encode_batch_fast(texts, add_special_tokens=False)]
        ids, sizes = tool.ids(array(texts))
        assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == want
        assert tool.counts(array(texts)).tolist() == [len(w) for w in want]


_open = {}


def library_of(path):
    return _open.setdefault(path, library(path))


def test_merging_equals_one_pair_at_a_time():
    merger = RankMerger(BYTE)
    rank = {}
    for slot in np.flatnonzero(merger.keys >= 0):
        rank[int(merger.keys[slot]) >> 20, int(merger.keys[slot]) & (1 << 20) - 1] = int(merger.ranks[slot])

    def slow(word):
        out = [int(merger.first[b]) for b in word]
        while True:
            found = [(rank[p], i) for i, p in enumerate(zip(out, out[1:])) if p in rank]
            if not found:
                return out
            r, i = min(found)
            out[i:i + 2] = [int(merger.made[r])]

    words = [b"", b"a", b"aaaaaaa", b" there", b"banana", b"\xff\xfe", b"thththe", b"abcabcabc"]
    ids, sizes = merger.merge(words)
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [slow(w) for w in words]


def test_counts(spark, libraries):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted(map(tuple, token_counts.token_counts(frame, BYTE, limit=100).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(ids_of(libraries["byte"], t)), n > 100) for i, t, *_ in ROWS]
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(frame.limit(0), BYTE).count() == 0


@pytest.mark.parametrize("values", [[], [5], [7] * 3000, list(range(5000)), [0] * 1000 + [4000000000], [1, 2**32 - 1] * 700])
def test_blocks_round_trip(values):
    values = np.array(values, dtype=np.int64)
    data, starts = token_files.pack(values)
    assert token_files.unpack(data, starts).tolist() == values.tolist()
    for first, count in ((0, len(values)), (len(values) // 3, len(values) // 2), (0, 0)):
        assert token_files.read_slice(data, starts, first, count).tolist() == values[first:first + count].tolist()


def test_files_hold_all_documents_in_order(spark, libraries):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    out = token_files.write_token_files(frame, WORD, shards=3, chunk_ids=500)
    got = token_files.read_token_files(spark.read.parquet(out)).orderBy("start").collect()
    assert [g.doc_id for g in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i))
    at, left = 0, [(r[0], ids_of(libraries["word"], r[1]) + [2]) for r in ROWS]
    for g in got:
        ids = np.frombuffer(bytes(g.ids), "<u4").tolist()
        left.remove((g.doc_id, ids))
        assert (g.start, g.n_tokens) == (at, len(ids))
        at += len(ids)
    assert not left
    empty = token_files.write_token_files(frame.limit(0), WORD)
    assert token_files.read_token_files(spark.read.parquet(empty)).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return sorted(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=200))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    used = {}
    for length, a, b, first, each, base in packing.best_fit(counts, 30):
        for r in range(b - a):
            used.setdefault(first + r // each, []).append((base + r % each * length, length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 30
    assert sorted(30 - sum(n for _, n in s) for s in used.values()) == best_fit_decreasing(lengths, 30)


def test_packing_of_documents(spark, libraries):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    pieces = packing.token_pieces(frame, BYTE, limit=64)
    placed = packing.pack(pieces.withColumn("crc", F.crc32("ids")).withColumn("offset", F.lit("old")).drop("ids"), 64).collect()
    want = []
    for key, text, *_ in ROWS:
        ids = ids_of(libraries["byte"], text) + [2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(key, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted([(p.doc_id, p.piece, p.start, p.length, p.crc) for p in placed], key=str) == sorted(want, key=str)
    rows = {}
    for p in placed:
        rows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all(sum(n for _, n in r) <= 64 for r in rows.values())
    for r in rows.values():
        assert [o for o, _ in sorted(r)] == [sum(n for _, n in sorted(r)[:i]) for i in range(len(r))]


def test_packing_of_odd_lengths(spark):
    frame = spark.createDataFrame([(1, None), (2, 0), (3, -4), (4, 99), (5, 10), (5, 10)], "k long, length int")
    got = {(r.k, r.offset, r.sequence_id is None) for r in packing.pack(frame, 20).collect()}
    assert got == {(1, None, True), (2, None, True), (3, None, True), (4, 0, False), (5, 0, False), (5, 10, False)}
    assert packing.pack(frame.limit(0), 20).count() == 0

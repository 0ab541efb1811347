"""Removal of long word sequences that repeat anywhere in the corpus, by suffix automata over reference shards.

A window is ``window`` words in a row.  Its anchor is the first of its runs of ``ANCHOR`` words with the smallest hash, so
equal windows have equal anchors.  Consecutive windows with their anchor in one place form a context; a document is cut into contexts, each
window lying in exactly one.  Only contexts whose anchor occurs at least twice can hold a repeated window: their
different texts, weighted by the number of their occurrences, are the reference.  It is sharded by anchor, which makes
one shard enough for any passage: a task builds the suffix automaton of a bounded shard and streams the shard's
passages through it for their matching statistics, the longest suffix at every word that occurs at least twice.  A
window is repeated where that length reaches ``window``.  Sending each passage to its shard takes the place of
sending every shard to every document, which would be quadratic.

An anchor of very many different contexts (the edge of a passage that much of the corpus quotes) is no shard: its
windows are counted one by one, equal ones before the shuffle, and go to shards by their own hash.

Rows are known by the MD5 of their text, since equal texts lose the same words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import settle
from .tokens import pieces_of

WINDOW = 35
ANCHOR = 8
HEAVY = 512  # different contexts of one anchor
SHARD_WORDS = 50_000
SLICE = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that minima and remainders of the numbers look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of some texts, one after the other: ``hashes``, and where each text's words start."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        parents, flat = pc.list_parent_indices(lists), lists.flatten()
        real = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty string
        self.flat = flat.filter(real)
        self.starts = np.r_[0, np.cumsum(np.bincount(parents.filter(real).to_numpy(), minlength=len(texts)))]
        coded = self.flat.dictionary_encode()
        each = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64,
                           len(coded.dictionary))
        self.hashes = each[coded.indices.to_numpy()] if len(each) else each
        n = len(self.hashes)
        self._sums = np.r_[np.zeros(1, np.uint64), np.cumsum(self.hashes * powers(_BASE, n), dtype=np.uint64)]
        self._back = powers(_INVERSE, n + 1)

    def digest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words from a to before b."""
        return mixed((self._sums[b] - self._sums[a]) * self._back[a] + (b - a).astype(np.uint64)).view(np.int64)


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """Where the first least of every ``width`` values in a row lies."""
    have, at = 1, np.arange(len(values))
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        have += step
    return at


def contexts(words: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor hash, content hash) of the contexts of all texts."""
    n, width = len(words.hashes), window - anchor + 1
    sizes = np.diff(words.starts)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none
    grams = np.zeros(n - anchor + 1, np.uint64)
    for i in range(anchor):
        grams = grams * np.uint64(_BASE) + words.hashes[i:n - anchor + 1 + i]
    grams = mixed(grams)
    least = minima(grams, width)
    ends = np.repeat(words.starts[1:], sizes)[:len(least)]
    at = np.flatnonzero(np.arange(len(least)) + window <= ends)  # windows inside one text
    if not len(at):
        return none, none, none, none, none
    low, end = least[at], ends[at]
    new = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (end[1:] != end[:-1])])
    count = np.diff(np.r_[new, len(at)])  # at most ``width``: the anchor lies in all of them
    text = np.searchsorted(words.starts, at[new], "right") - 1
    return text, at[new] - words.starts[text], count, grams[low[new]].view(np.int64), words.digest(at[new], at[new] + count + window - 1)


def anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """t, at, n, a, c of every context; ``docs``: t, _text."""
    def scan(batches):
        for batch in batches:
            for part in pieces_of(batch, "_text", SLICE):
                text, at, n, a, c = contexts(Words(part.column("_text")), window, anchor)
                yield pa.RecordBatch.from_arrays(
                    [part.column("t").take(pa.array(text)), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(a), pa.array(c)],
                    names=["t", "at", "n", "a", "c"])

    return docs.mapInArrow(scan, "t binary, at int, n int, a long, c long")


class Automaton:
    """Suffix automaton of several weighted word sequences."""

    def __init__(self):
        self.next, self.link, self.length, self.weight = [{}], [-1], [0], [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.weight.append(0)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state for the strings of q that fit behind p."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int], weight: int) -> None:
        last = 0
        for word in words:
            known = self.next[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
            else:
                p, last = last, self._state(self.length[last] + 1, {}, 0)
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = last
                    p = self.link[p]
                if p >= 0:
                    self.link[last] = self._split(p, word, self.next[p][word])
            self.weight[last] += weight

    def close(self) -> None:
        """Occurrences of every state's strings: those of the states that extend them to the left count too."""
        link, weight = self.link, self.weight
        for state in np.argsort(-np.array(self.length), kind="stable").tolist()[:-1]:
            weight[link[state]] += weight[state]

    def statistics(self, words: list[int]):
        """At every word the length of the longest sequence ending there that occurs at least twice."""
        state, length, following, link, lengths, weight = 0, 0, self.next, self.link, self.length, self.weight
        for word in words:
            to = following[state].get(word)
            while state and (to is None or weight[to] < 2):
                state = link[state]
                length = lengths[state]
                to = following[state].get(word)
            if to is not None and weight[to] >= 2:
                state, length = to, length + 1
            yield length


def repeated(passages: DataFrame, window: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """a, c, n and mask (bit i: window i of the passage occurs at least twice) of passages g, a, c, n, m, text.

    Equal windows must have equal g.  A shard is whole groups of g until it has ``shard_words`` words.
    """
    def shard(rows):
        automaton, known, coded = Automaton(), {}, []
        for *_, m, text in rows:
            words = [known.setdefault(w, len(known)) for w in text.split(b" ")]
            coded.append(words)
            automaton.add(words, m)
        automaton.close()
        masks = []
        for words in coded:
            mask = 0
            for at, length in enumerate(automaton.statistics(words)):
                if length >= window:
                    mask |= 1 << at - window + 1
            masks.append(mask)
        a, c, n = ([r[i] for r in rows] for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int32()),
                                           pa.array(masks, pa.int64())], names=["a", "c", "n", "mask"])

    def scan(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for g, *row in zip(*[batch.column(x).to_pylist() for x in ("g", "a", "c", "n", "m", "text")], strict=True):
                if g != last and size >= shard_words:
                    yield shard(rows)
                    rows, size = [], 0
                last = g
                rows.append(row)
                size += window + max(row[2], 1)
        if rows:
            yield shard(rows)

    count = int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = passages.repartition(count, "g").sortWithinPartitions("g")
    return dealt.mapInArrow(scan, "a long, c long, n int, mask long")


def cut_out(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Texts of the wanted contexts (t, marks), of heavy ones window by window: g, a, c, n, off, m, text."""
    def scan(batches):
        for batch in batches:
            for part in pieces_of(batch, "_text", SLICE):
                out = [[] for _ in range(7)]
                for text, marks in zip(part.column("_text").cast(pa.binary()).to_pylist(), part.column("marks").to_pylist(), strict=True):
                    own = text.split()
                    for m in marks:
                        first, count, rest = m["at"], m["n"], (m["a"], m["c"], m["n"])
                        if m["heavy"]:
                            cuts = [b" ".join(own[first + k:first + k + window]) for k in range(count)]
                            spans = [(xxhash.xxh3_64_intdigest(cut) - (1 << 63), k, cut) for k, cut in enumerate(cuts)]
                        else:
                            spans = [(m["a"], -1, b" ".join(own[first:first + count + window - 1]))]
                        for g, off, cut in spans:
                            for column, value in zip(out, (g, *rest, off, m["m"], cut), strict=True):
                                column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)],
                                                 names=["g", "a", "c", "n", "off", "m", "text"])

    found = docs.join(wanted.hint("merge"), "t").select("_text", "marks").mapInArrow(
        scan, "g long, a long, c long, n int, off int, m long, text binary")
    # copies of a text give the same passages
    return found.groupBy("g", "a", "c", "n", "off").agg(F.first("m").alias("m"), F.first("text").alias("text"))


def marks(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, heavy: int = HEAVY) -> DataFrame:
    """t and marks (at, n, mask) of the texts with a repeated window; ``docs``: t, _text."""
    every = settle(anchors(docs, window, anchor), "anchors")
    twice = settle(every.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("a"), "repeated_anchors")
    some = settle(every.join(twice.hint("merge"), "a"), "candidates")
    place = F.min(F.struct("t", "at"))
    different = settle(some.groupBy("a", "c", "n").agg(F.count(F.lit(1)).alias("m"), place.alias("_p")), "contexts")
    large = settle(different.groupBy("a").agg(F.count(F.lit(1)).alias("_d")).filter(F.col("_d") > heavy).select("a"), "heavy")
    flagged = different.join(large.withColumn("_heavy", F.lit(True)).hint("merge"), "a", "left")
    wanted = settle(flagged.groupBy("_p.t").agg(F.collect_list(F.struct(
        F.col("_p.at").alias("at"), "n", "a", "c", "m", F.coalesce("_heavy", F.lit(False)).alias("heavy"))).alias("marks")), "wanted")
    passages = settle(cut_out(docs, wanted, window), "passages")
    whole = passages.filter("off < 0").select("g", "a", "c", "n", "m", "text")
    single = passages.filter("off >= 0").groupBy("g", "a", "text").agg(F.sum("m").alias("m")).select(
        "g", "a", F.col("g").alias("c"), F.lit(0).alias("n"), "m", "text")
    found = settle(repeated(whole.unionByName(single), window).filter("mask <> 0"), "masks")
    hot = found.filter("n = 0").select("a", F.col("c").alias("g")).distinct()
    hot = passages.filter("off >= 0").select("g", "a", "c", "n", "off").join(hot.hint("merge"), ["a", "g"]).groupBy(
        "a", "c", "n").agg(F.expr("bit_or(shiftleft(1L, off))").alias("mask"))
    masks = settle(found.filter("n > 0").unionByName(hot), "all_masks")
    return settle(some.join(masks.hint("merge"), ["a", "c", "n"]).select("t", "at", "n", "mask").distinct().groupBy("t").agg(
        F.collect_list(F.struct("at", "n", "mask")).alias("marks")), "marks")


def null_name(docs: DataFrame) -> str:
    """A name that no column has."""
    return max(docs.columns, key=len) + "_"


def with_spans(docs: DataFrame, text: str, window: int = WINDOW, whole: bool = True, **how) -> DataFrame:
    """_doc (the other columns), _spans (start, end in words: the maximal runs to remove), _n_words, _n_removed, _sha (of the
    kept words) and, if ``whole``, the text and the words _kept."""
    def spans_of(found, n):
        cover = np.zeros(n + 1, np.int64)
        for m in found:
            at = m["at"] + np.flatnonzero((m["mask"] >> np.arange(m["n"])) & 1)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
        inside = np.cumsum(cover)[:-1] > 0
        return inside, np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8))).reshape(-1, 2)

    def scan(batches):
        for batch in batches:
            for part in pieces_of(batch, "_text", SLICE):
                spans, n_words, removed, kept, digest = [], [], [], [], []
                for t, found in zip(part.column("_text").cast(pa.binary()).to_pylist(), part.column("marks").to_pylist(), strict=True):
                    own, runs = t.split(), []
                    n_words.append(len(own))
                    if found:
                        inside, runs = spans_of(found, len(own))
                        own = [w for w, gone in zip(own, inside.tolist(), strict=True) if not gone]
                    removed.append(n_words[-1] - len(own))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in runs])
                    left = b" ".join(own)
                    digest.append(hashlib.sha256(left).hexdigest())
                    if whole:
                        kept.append(left)
                columns = {"_doc": part.column("_doc"), "_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                           "_n_words": pa.array(n_words, pa.int64()), "_n_removed": pa.array(removed, pa.int64()), "_sha": pa.array(digest)}
                if whole:
                    columns |= {"_text": part.column("_text"), "_kept": pa.array(kept, pa.binary()).cast(pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    own, null = F.coalesce(F.col(text), F.lit("")), null_name(docs)
    rows = docs.select(F.unhex(F.md5(own)).alias("t"), own.alias("_text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.col(text).isNull().alias(null)).alias("_doc"))
    found = marks(rows.select("t", "_text"), window, **how)
    kind = rows.schema["_doc"].dataType.simpleString()
    return rows.join(found.hint("merge"), "t", "left").select("_doc", "_text", "marks").mapInArrow(
        scan, f"_doc {kind}, _spans array<struct<start:int,end:int>>, _n_words long, _n_removed long, _sha string"
        + ", _text string, _kept string" * whole)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, **how) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 and spans of every row.

    A word goes if a window of ``window`` words covers it whose words also start anywhere else, in the same text or
    another; all windows are judged on the input.  Null and empty texts have no words, texts shorter than a window lose
    none, very long ones are treated like any other.  Repeated rows repeat each other, so their windows all go.  Other
    columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = with_spans(rows, "text", window, False, **how)
    return out.select(F.col("_doc.key").alias(key), F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
                      F.col("_sha").alias("kept_sha256"), F.col("_spans").alias("spans"))


def without_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, **how) -> DataFrame:
    """``docs`` whose texts have lost their repeated words; texts that lose none stay as they are, null stays null."""
    out = with_spans(docs, text, window, True, **how)
    left = F.when(F.col("_doc").getField(null_name(docs)), None).when(F.col("_n_removed") == 0, F.col("_text")).otherwise(F.col("_kept"))
    return out.select(*[(left if c == text else F.col("_doc").getField(c)).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
w AS (SELECT row, unnest(range(len(w))) AS i, unnest(w) AS w FROM d),
g AS (SELECT row, i, w, md5(string_agg(w, ' ') OVER s) AS h, count(*) OVER s AS k FROM w
      WINDOW s AS (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
t AS (SELECT h FROM g WHERE k = 35 GROUP BY h HAVING count(*) > 1),
c AS (SELECT row, i, w, max((k = 35 AND h IN (SELECT h FROM t))::INT) OVER (PARTITION BY row ORDER BY i ROWS 34 PRECEDING) AS gone FROM g),
r AS (SELECT row, sum(gone)::BIGINT AS gone, string_agg(w, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (row)
"""

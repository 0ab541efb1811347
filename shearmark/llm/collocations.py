"""Phrases that occur together more than their parts would, from a multikey three-way quicksort of suffix pointers.

Every word starts a suffix, whose keys are its language and its next words within the piece, up to the longest phrase.
A slice of texts is sorted by splitting all open partitions at once into less than, equal to and greater than a pivot
key; an equal partition goes on with the next key, and its size is the count of the words it has in common.  Equal
suffixes of a slice leave it as one row with a count.  Merged over slices, the weighted suffixes are routed by their
leading words and sorted again, and there a partition below the least count is abandoned: no phrase in it can reach it.

Most suffixes need not travel.  Hashes of all words, pairs and triples are counted first, as packed numbers of 32 bits
within segments of the hash range.  Those that can be frequent set bits in a map of at most ``FILTER_BITS`` bits, and a
suffix is cut where its words are not among them.  A bit set by chance costs one row; when the map fills up, fewer
suffixes are cut.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import settle
from .substrings import mixed
from .tokens import pieces_of

LEAST = 10
TOP = 2000
LONGEST = 3
SLICE = 4 << 20
FILTER_BITS = 1 << 29
SEGMENT_BITS = 1 << 19
TASK_ROWS = 500_000
HASH_SEGMENTS = 4096
PARTS = 64
_BREAK = "\n"
# bytes of a text: A-Z lower-cased, a tab as a space, everything that ends a piece as a line break
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[9] = 32
_BYTES[[*b".,;:!?\n\x0b\x0c\r"]] = 10


def multikey(keys: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth, pointer, weight) of every set of at least ``least`` pointers that share their first ``depth`` keys.

    ``keys`` [depth, pointer].  All open partitions are split in the same pass; the pointer is one of the set.
    """
    order, total = np.arange(keys.shape[1]), np.r_[0, np.cumsum(weights)]
    lo, hi, depth = np.zeros(1, np.int64), np.array([keys.shape[1]]), np.zeros(1, np.int64)
    if not keys.shape[1] or total[-1] < least:
        lo, hi, depth = lo[:0], hi[:0], depth[:0]
    found: list[tuple[np.ndarray, ...]] = []
    while len(lo):
        size = hi - lo
        first = np.cumsum(size) - size
        part = np.repeat(np.arange(len(lo)), size)
        place = np.arange(len(part)) + np.repeat(lo - first, size)
        pointer = order[place]
        key = keys[depth[part], pointer]
        pivot = key[first + size // 2]
        side = (key > pivot[part]).astype(np.int64) + (key >= pivot[part])  # 0 less, 1 equal, 2 greater
        sums = np.zeros((len(lo), 3), np.int64)
        counts = np.zeros((len(lo), 3), np.int64)
        target = np.empty(len(part), np.int64)
        start = lo.copy()
        for s in range(3):
            mine = side == s
            run = np.cumsum(mine)
            before = np.r_[0, run][first]
            counts[:, s] = np.r_[0, run][first + size] - before
            at = np.flatnonzero(mine)
            target[at] = start[part[at]] + run[at] - 1 - before[part[at]]
            sums[:, s] = np.bincount(part[at], weights=weights[pointer[at]], minlength=len(lo)).astype(np.int64)
            start = start + counts[:, s]
        order[target] = pointer
        bounds = np.c_[lo, lo + counts[:, 0], lo + counts[:, 0] + counts[:, 1], hi]
        live = (counts > 0) & (sums >= least)
        equal = live[:, 1]
        found.append((depth[equal] + 1, order[bounds[equal, 1]], sums[equal, 1]))
        deeper = equal & (depth + 1 < keys.shape[0])
        picks = [(live[:, 0], 0, 0), (deeper, 1, 1), (live[:, 2], 2, 0)]
        lo, hi, depth = (np.concatenate(x) for x in zip(*[
            (bounds[p, s], bounds[p, s + 1], depth[p] + more) for p, s, more in picks], strict=True))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, a line break as a word of its own between pieces, and the text of each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_BYTES[data]))
    lists = pc.split_pattern(pc.replace_substring(plain, _BREAK, f" {_BREAK} "), " ")
    flat, parents = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(real), parents.filter(real).to_numpy()


class Suffixes:
    """The words of some texts: ``ids`` (-1: a break) and ``lang`` of every word, ``after`` (the next word of its piece, else
    -1), and hashes of the word alone, with the next one and with the next two, by language."""

    def __init__(self, part: pa.RecordBatch):
        flat, parents = words_of(part.column("_text"))
        coded = flat.dictionary_encode()
        self.words, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        langs = part.column("lang").dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy().astype(np.int64)[parents]
        digest = lambda a: np.fromiter(map(xxhash.xxh3_64_intdigest, a.cast(pa.binary()).to_pylist()), np.uint64, len(a))
        self.ids = np.where(ids == pc.index(self.words, _BREAK).as_py(), -1, ids)
        n = len(ids)
        near = np.r_[parents[1:] == parents[:-1], np.zeros(min(n, 1), bool)]
        self.after = np.where(near, np.r_[self.ids[1:], np.full(min(n, 1), -1)], -1)
        paired = (self.ids >= 0) & (self.after >= 0)
        h = digest(self.words)[ids]
        one = mixed(h * np.uint64(3) + digest(self.langs)[self.lang])
        two = mixed(one + np.r_[h[1:], h[:1]])
        three = mixed(two * np.uint64(5) + np.r_[h[2:], h[:2]][:n])
        self.grams = [one, two, three]
        self.real = [self.ids >= 0, paired, paired & np.r_[paired[1:], paired[:1]]]


def gram_counts(texts: DataFrame, bits: int) -> DataFrame:
    """s (the leading bits of the hash) and m (the next 32 bits of different hashes, and their counts) of every slice."""
    def scan(batches):
        for batch in batches:
            for part in pieces_of(batch, "_text", SLICE):
                s = Suffixes(part)
                h, c = np.unique(np.concatenate([g[r] for g, r in zip(s.grams, s.real, strict=True)]) >> np.uint64(32 - bits), return_counts=True)
                segment = (h >> np.uint64(32)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(h) else np.zeros(0, np.int64)
                low, count = h.astype("<u4"), c.astype("<u4")
                blobs = [low[a:b].tobytes() + count[a:b].tobytes() for a, b in zip(first, [*first[1:], len(h)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(segment[first]), pa.array(blobs, pa.binary())], names=["s", "m"])

    return texts.mapInArrow(scan, "s long, m binary")


def frequent_hashes(counts: DataFrame, least: int) -> DataFrame:
    """h of the grams whose counts add up to at least ``least``."""
    def merged(segment, blobs):
        tables = [np.frombuffer(b, "<u4").reshape(2, -1) for b in blobs]
        low, count = np.concatenate(tables, axis=1)
        order = np.argsort(low, kind="stable")
        low, count = low[order], count[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        often = low[first][np.add.reduceat(count, first) >= least]
        return pa.RecordBatch.from_arrays([pa.array((segment << 32) + often.astype(np.int64))], names=["h"])

    def scan(batches):
        last, blobs = None, []
        for batch in batches:
            for segment, blob in zip(batch.column("s").to_pylist(), batch.column("m").to_pylist(), strict=True):
                if segment != last and blobs:
                    yield merged(last, blobs)
                    blobs = []
                last = segment
                blobs.append(blob)
        if blobs:
            yield merged(last, blobs)

    count = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counts.repartition(count, "s").sortWithinPartitions("s").mapInArrow(scan, "h long")


def bit_map(hashes: DataFrame, limit: int) -> np.ndarray:
    """A map with the bits of the given hashes (h) set: sixteen bits a hash, but no more than ``limit``, put together by segments."""
    bits = min(limit, max(SEGMENT_BITS, 1 << math.ceil(math.log2(16 * max(1, hashes.count())))))

    def segments(batches):
        last, held = None, None
        for batch in batches:
            at, bit = batch.column("s").to_numpy(), batch.column("b").to_numpy()
            for s in np.unique(at):
                if s != last:
                    if held is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([np.packbits(held).tobytes()])], names=["s", "m"])
                    last, held = s, np.zeros(SEGMENT_BITS, np.uint8)
                held[bit[at == s]] = 1
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([np.packbits(held).tobytes()])], names=["s", "m"])

    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    rows = hashes.select(F.shiftright(place, 19).alias("s"), place.bitwiseAND(F.lit(SEGMENT_BITS - 1)).alias("b"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.repartition("s").sortWithinPartitions("s").mapInArrow(segments, "s long, m binary").collect():
        out[r["s"] * SEGMENT_BITS // 8:(r["s"] + 1) * SEGMENT_BITS // 8] = np.frombuffer(r["m"], np.uint8)
    return out


def suffixes(texts: DataFrame, frequent: np.ndarray, bits: int) -> DataFrame:
    """depth, lang, w1, w2, w3 and c of the different suffixes of every slice, as far as they may be frequent: single words
    (depth 1), and two or three words (depth 3).  Depth 0 has the number of all words."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)  # at most FILTER_BITS bits

    def scan(batches):
        table = shared.value
        last = np.uint64(len(table) * 8 - 1)
        for batch in batches:
            for part in pieces_of(batch, "_text", SLICE):
                s = Suffixes(part)
                may = []
                for h, real in zip(s.grams, s.real, strict=True):
                    at = (h >> np.uint64(32 - bits)) & last
                    may.append(real & ((table[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0))
                own = np.flatnonzero(may[0])
                second = np.where(may[1], s.after, -1)
                third = np.where(may[1] & may[2], np.r_[s.after[1:], s.after[:1]], -1)
                keys = np.stack([s.lang[own], s.ids[own], second[own], third[own]])
                depth, at, c = multikey(keys, np.ones(len(own), np.int64), 1)
                pick = (depth == 2) | ((depth == 4) & (keys[2, at] >= 0))
                depth, at, c = depth[pick], at[pick], c[pick]
                word, n = depth == 2, np.bincount(s.lang[s.real[0]], minlength=len(s.langs))
                take = lambda k, gone: s.words.take(pa.array(keys[k, at], mask=gone | (keys[k, at] < 0)))
                rows = [pa.array(depth - 1, pa.int32()), s.langs.take(pa.array(keys[0, at])), take(1, np.zeros(len(at), bool)),
                        take(2, word), take(3, word), pa.array(c, pa.int64())]
                none = pa.nulls(len(n), pa.string())
                names = ["depth", "lang", "w1", "w2", "w3", "c"]
                yield pa.RecordBatch.from_arrays(rows, names=names)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n)), pa.int32()), s.langs, none, none, none, pa.array(n, pa.int64())], names=names)

    return texts.mapInArrow(scan, "depth int, lang string, w1 string, w2 string, w3 string, c long")


def phrase_counts(weighted: DataFrame, least: int) -> DataFrame:
    """lang, w1, w2, w3 (null: two words) and f of the phrases that occur at least ``least`` times."""
    def scan(batches):
        parts = list(batches)  # TASK_ROWS and the followers of one pair of words
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        n = table.num_rows
        one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        words = pa.concat_arrays([one(table.column(w)) for w in ("w1", "w2", "w3")]).dictionary_encode()
        ids = pc.fill_null(words.indices, -1).to_numpy().astype(np.int64)
        langs = one(table.column("lang")).dictionary_encode()
        keys = np.stack([langs.indices.to_numpy().astype(np.int64), *ids.reshape(3, n)])
        depth, at, f = multikey(keys, table.column("c").to_numpy(), least)
        pick = (depth == 3) | ((depth == 4) & (keys[3, at] >= 0))
        depth, at, f = depth[pick], at[pick], f[pick]
        take = lambda k, gone: words.dictionary.take(pa.array(keys[k, at], mask=gone))
        every = np.zeros(len(at), bool)
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(keys[0, at])), take(1, every), take(2, every), take(3, depth == 3), pa.array(f, pa.int64())],
            names=["lang", "w1", "w2", "w3", "f"])

    count = int(weighted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(count, math.ceil(weighted.count() / TASK_ROWS))
    return weighted.repartition(parts, "lang", "w1", "w2").mapInArrow(scan, "lang string, w1 string, w2 string, w3 string, f long")


def ratio(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts of up to 15 digits."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    names = F.struct((F.lit(1000000).cast("decimal(7,0)") * a * a).alias("p"), (left * right).alias("q"))
    return F.transform(F.array(names), lambda x: F.call_function("div", x["p"], x["q"]))[0]


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang",
                 filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` best phrases of two and three words of every language.

    Texts are lower-cased (A-Z) and cut at ``.,;:!?`` and line ends into pieces, those at spaces and tabs into words.
    Null and empty texts have no words, a null language is ``und``; a language without a frequent phrase has no rows.
    Repeated rows count as often as they are there; very long texts and words are treated like any other.  Ties go by a
    and then by the bytes of the phrase.  Other columns are not read; an empty table gives no rows.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    segments = max(HASH_SEGMENTS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bits = math.ceil(math.log2(segments))
    often = settle(frequent_hashes(gram_counts(texts, bits), least), "frequent_hashes")
    rows = suffixes(texts, bit_map(often, filter_bits), bits).groupBy("depth", "lang", "w1", "w2", "w3").agg(F.sum("c").alias("c"))
    rows = settle(rows, "suffixes")
    totals = settle(rows.filter("depth = 0").groupBy("lang").agg(F.sum("c").alias("n")), "totals")
    words = settle(rows.filter("depth = 1").filter(F.col("c") >= least).select("lang", F.col("w1").alias("w"), F.col("c").alias("f")), "words")
    counts = settle(phrase_counts(rows.filter("depth = 3").drop("depth"), least), "phrases")
    two = counts.filter("w3 is null").select("lang", "w1", "w2", F.col("f").alias("a"))
    three = counts.filter("w3 is not null").withColumnRenamed("f", "a")

    def single(w: str, as_: str) -> DataFrame:
        return words.select(F.col("lang"), F.col("w").alias(w), F.col("f").alias(as_))

    def double(first: str, second: str, as_: str) -> DataFrame:
        return two.select("lang", F.col("w1").alias(first), F.col("w2").alias(second), F.col("a").alias(as_))

    inside = three.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    inside = inside.groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longer"))
    pairs = two.join(inside, ["lang", "w1", "w2"], "left").filter("longer is null or 100 * longer < 50 * a")
    pairs = pairs.join(single("w1", "l"), ["lang", "w1"]).join(single("w2", "r"), ["lang", "w2"])
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", ratio(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    triples = three.join(double("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(double("w2", "w3", "r1"), ["lang", "w2", "w3"])
    triples = triples.join(single("w1", "l1"), ["lang", "w1"]).join(single("w3", "r2"), ["lang", "w3"])
    cuts = [F.struct(ratio(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"),
                     F.col(f"r{k}").alias("r")) for k in (1, 2)]
    triples = triples.withColumn("_c", F.least(*cuts)).select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "_c.l", "_c.r", "_c.score")
    # the best of every part of a language first, so that none sends all its phrases to one task
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    found = pairs.unionByName(triples).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    best = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = found.withColumn("rank", best).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(unnest(p), '[\x20\x09]+'), lambda w: w <> '') AS w FROM d),
g AS (SELECT lang, unnest(list_concat(list_transform(range(1, len(w) + 1), lambda i: w[i:i]), list_transform(range(1, len(w)),
      lambda i: w[i:i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))) AS g FROM p),
f AS (SELECT lang, g, len(g) AS k, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
s AS (SELECT c.lang, c.g, c.k, c.f AS a, x.f AS l, y.f AS r, ((1000000 * c.f::HUGEINT * c.f) // (x.f::HUGEINT * y.f))::BIGINT AS score,
      row_number() OVER (PARTITION BY c.lang, c.g ORDER BY (1000000 * c.f::HUGEINT * c.f) // (x.f::HUGEINT * y.f), x.k) AS first
      FROM c JOIN f x ON x.lang = c.lang AND x.k < c.k AND x.g = c.g[1:x.k]
      JOIN f y ON y.lang = c.lang AND y.k = c.k - x.k AND y.g = c.g[x.k + 1:c.k]),
t AS (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, f FROM c WHERE k = 3),
o AS (SELECT lang, g, max(f) AS f FROM t GROUP BY ALL),
z AS (SELECT s.lang, array_to_string(s.g, ' ') AS phrase, a, l, r, score FROM s LEFT JOIN o ON o.lang = s.lang AND o.g = s.g
      WHERE first = 1 AND (o.f IS NULL OR 100 * o.f < 50 * a)),
q AS (SELECT z.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000
"""

"""Exact duplicates by composable polynomial fingerprints and a chunkwise comparison of equal ones.

A text is cut into chunks.  A chunk's fingerprint is its bytes as a polynomial in ``base`` modulo a prime, together
with the shift base**bytes; two neighbours combine as left * shift(right) + right, so chunks of a huge document are
hashed independently and folded afterwards.  Two primes and the length in bytes make the document's fingerprint.
Rows of equal fingerprint are compared chunk by chunk with the first of them; whoever differs (a collision) goes
through another round among its like, so the result does not rest on the hash.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, settle

CHUNK = 1 << 16  # code points
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
BLOCK = 1024
TABLE_BLOCKS = 512  # blocks multiplied at once: 4 MB of doubles
SLICE_BYTES = 4 << 20
PRINT = ["h1", "h2", "n_bytes"]


@cache
def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo a prime below 2**31."""
    out = np.ones(1, dtype=np.int64)
    while len(out) < n:
        out = np.r_[out, out * (int(out[-1]) * base % prime) % prime]
    return out[:n]


def polynomial(data: np.ndarray, ends: np.ndarray, base: int, prime: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, shift) of the byte slices that end at ``ends``; all blocks of all slices in one product."""
    sizes = np.diff(np.r_[0, ends])
    blocks = -(-sizes // BLOCK)
    last = np.cumsum(blocks)
    padded = np.zeros(int(last[-1]) * BLOCK if len(last) else 0, dtype=np.uint8)
    for a, b, z in zip(ends - sizes, ends, last * BLOCK, strict=True):  # leading zeros change no polynomial
        padded[z - (b - a):z] = data[a:b]
    weights = powers(base, prime, BLOCK)[::-1].astype(np.float64)
    table = padded.reshape(-1, BLOCK)
    # below 2**8 * 2**31 * 2**10: exact in doubles
    value = np.concatenate([np.zeros(0), *[table[i:i + TABLE_BLOCKS].astype(np.float64) @ weights for i in range(0, len(table), TABLE_BLOCKS)]])
    value = value.astype(np.int64) % prime
    shift, out, first = int(powers(base, prime, BLOCK + 1)[-1]), np.zeros(len(sizes), dtype=np.int64), last - blocks
    live = np.flatnonzero(blocks)
    for k in range(int(blocks.max()) if len(blocks) else 0):
        live = live[blocks[live] > k]
        out[live] = (out[live] * shift + value[first[live] + k]) % prime
    return out, powers(base, prime, int(sizes.max()) + 1 if len(sizes) else 1)[sizes]


def hasher(primes: tuple[int, int]):
    @F.arrow_udf("struct<h1:long,s1:long,h2:long,s2:long>")
    def chunk_hash(chunk: pa.Array) -> pa.Array:
        parts = []
        sizes = pc.binary_length(chunk).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes, dtype=np.int64) - sizes) // SLICE_BYTES)) + 1
        for at, end in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            if at == end:
                continue
            texts = chunk.slice(at, end - at).cast(pa.binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
            both = [polynomial(data, offsets[1:] - offsets[0], b, p) for b, p in zip(BASES, primes, strict=True)]
            parts.append(pa.StructArray.from_arrays(
                [pa.array(x) for pair in both for x in pair], names=["h1", "s1", "h2", "s2"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(n, pa.int64()) for n in ("h1", "s1", "h2", "s2")]))

    return chunk_hash


def normal(text: str) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), " \t\n\x0b\x0c\r", "")


def chunk_table(docs: DataFrame, key: str, text: str, row: str | None, chunk: int, primes: tuple[int, int]) -> DataFrame:
    """Settled chunks of the normalised texts: _row, key, chars, sha (first chunk only), k, n, chunk, bytes and hashes."""
    rows = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("_row"), F.col(key).alias("_key"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"), normal(text).alias("_norm"))
    rows = rows.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.length("_norm") / chunk)).cast("int"))
    cut = F.when(F.col("_n") == 1, F.array("_norm")).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.substring(F.col("_norm"), k * chunk + 1, F.lit(chunk))))
    rows = rows.select("_row", "_key", "chars", F.sha2("_norm", 256).alias("_sha"), "_n", F.posexplode(cut).alias("k", "chunk"))
    hashed = rows.withColumn("_h", hasher(primes)("chunk"))
    return settle(hashed.select(
        "_row", "_key", "chars", F.when(F.col("k") == 0, F.col("_sha")).alias("sha"), "k", F.col("_n").alias("n"), "chunk",
        F.octet_length("chunk").cast("long").alias("bytes"), "_h.*"), "chunks")


def combine(parts: Column, primes: tuple[int, int]) -> Column:
    """Fold of an array of chunk hashes in order: left * shift(right) + right, for both primes."""
    start = F.struct(F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
    return F.aggregate(F.array_sort(parts), start, lambda a, x: F.struct(
        ((a["h1"] * x["s1"] + x["h1"]) % primes[0]).alias("h1"), ((a["h2"] * x["s2"] + x["h2"]) % primes[1]).alias("h2")))


def fingerprints(chunks: DataFrame, primes: tuple[int, int]) -> DataFrame:
    """One row per document: _row, _key, chars, sha, h1, h2, n_bytes.  Only documents of several chunks are grouped."""
    one = chunks.filter("n = 1").select("_row", "_key", "chars", "sha", "h1", "h2", F.col("bytes").alias("n_bytes"))
    many = chunks.filter("n > 1").groupBy("_row").agg(
        F.first("_key").alias("_key"), F.first("chars").alias("chars"), F.max("sha").alias("sha"),
        combine(F.collect_list(F.struct("k", "h1", "s1", "h2", "s2")), primes).alias("_f"), F.sum("bytes").alias("n_bytes"))
    return one.unionByName(many.select("_row", "_key", "chars", "sha", "_f.h1", "_f.h2", "n_bytes"))


def classes(chunks: DataFrame, prints: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """_row and _class (a row of the same text) of every row that has an equal; the comparison behind it is exact."""
    found, todo = None, prints.select("_row", *PRINT)
    while True:
        # written tables on both sides: a large group's rows can then be split over tasks
        groups = settle(todo.groupBy(*PRINT).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_class")).filter(
            "_n > 1").drop("_n"), "groups")
        links = settle(todo.join(groups.hint("merge"), PRINT).select("_row", "_class"), "links")
        # the same plan at every size; a group's first row is among its links
        texts = settle(links.join(chunks.select("_row", "k", "chunk").hint("merge"), "_row"), "equal_prints")
        spent.append(texts)
        first = texts.filter("_row = _class").select("_class", "k", F.col("chunk").alias("_other"))
        differ = texts.filter("_row <> _class").join(first.hint("merge"), ["_class", "k"], "left").filter(
            ~F.col("chunk").eqNullSafe(F.col("_other"))).select("_row").distinct()
        differ = settle(differ, "collisions")
        if differ.isEmpty():
            return links if found is None else found.unionByName(links)
        equal = links.join(differ, "_row", "left_anti")
        found = equal if found is None else found.unionByName(equal)
        todo = prints.select("_row", *PRINT).join(differ, "_row", "left_semi")


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None, chunk: int = CHUNK,
               primes: tuple[int, int] = PRIMES, spent: list[DataFrame] | None = None) -> DataFrame:
    """_row, key, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal when they are after deletion of ASCII white space; null is empty, and all empty texts are equal.
    Of equal texts the one with the most code points stays, then the smallest key (null last), then the first row:
    of repeated rows exactly one stays.  ``row`` names a column that numbers the rows; without it they are numbered
    here.  No other column is read.  A large group is counted map-side; its rows meet one row of the group only.
    ``spent`` takes the tables that hold texts, for a caller that writes the result and discards them.
    """
    spent = [] if spent is None else spent
    chunks = chunk_table(docs, key, text, row, chunk, primes)
    spent.append(chunks)
    prints = fingerprints(chunks, primes)
    found = classes(chunks, prints, spent)
    rows = prints.join(found, "_row", "left").withColumn("_class", F.coalesce("_class", "_row"))
    best = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("_key").isNull().alias("no_key"), F.col("_key").alias("key"),
                          F.col("_row").alias("row")))
    groups = settle(rows.groupBy("_class").agg(F.count(F.lit(1)).alias("group_size"), best.alias("_best")), "best")
    return rows.join(groups, "_class").select(
        "_row", F.col("_key").alias(key), F.col("_best.key").alias("keep_id"), "group_size",
        (F.col("_row") == F.col("_best.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of equal texts, with the columns of ``docs``, whatever their names."""
    rows = settle(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"),
                              F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_doc")), "documents")
    spent: list[DataFrame] = []
    dropped = settle(duplicates(rows, "_key", "_text", "_row", spent=spent).filter(~F.col("kept")).select("_row"), "copies")
    discard(spent)
    left = rows.join(dropped.hint("merge"), "_row", "left_anti")  # the same plan at every size
    return left.select(*[(F.col("_text") if c == text else F.col("_doc").getField(c)).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, ''))::BIGINT AS chars,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
g AS (SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
      first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
      row_number() OVER (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST) = 1 AS kept FROM d)
SELECT doc_id, keep_id, group_size, kept, sha256(body) AS text_sha256 FROM g
"""

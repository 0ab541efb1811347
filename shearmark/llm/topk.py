"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to whole numbers.  A block of rows keeps, for every dimension, its values minus their
minimum as bit slices: one bitmap over the rows per binary digit.  A query's score is a sum of slices, each shifted
by the digits of the query's own component (with the complement of the slices where that is negative), and is added
up for all rows of the block at once by carry-save bitmap arithmetic.  The top rows are then selected from the most
significant score slice downward; rows that tie at the boundary are resolved by id, exactly.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import settle

NARROW, NARROW_DIM = 1 << 22, 1 << 18  # products and their sums stay below 2**63
WIDE_PART = 64  # a block of wide vectors has so many times fewer rows


def finite(vector: str) -> Column:
    """The components as doubles; null where the vector takes no part."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)), wide)


def narrow(values: np.ndarray, scale: float) -> np.ndarray:
    """Whether each vector [rows, dim] can be reckoned in 64 bits."""
    return (np.abs(values).max(axis=1, initial=0) < NARROW / scale) & (values.shape[1] < NARROW_DIM)


def quantised(values: np.ndarray, scale: float, wide: bool) -> np.ndarray:
    """floor(scale * x): 64-bit numbers, or Python's own."""
    if not wide:
        return np.floor(values * scale).astype(np.int64)
    out = np.empty(values.size, dtype=object)
    out[:] = [math.floor(Fraction(x) * Fraction(scale)) for x in values.ravel().tolist()]
    return out.reshape(values.shape)


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(bitmaps [dim, digit, words], minimum per dimension, digits) of a block's values [rows, dim]."""
    low = values.min(axis=0)
    above = (values - low).T
    digits = max(1, int(above.max()).bit_length()) if above.size else 1
    words = -(-values.shape[0] // 64)
    out = np.zeros((values.shape[1], digits, words * 64), dtype=np.uint8)
    for d in range(digits):
        out[:, d, :values.shape[0]] = ((above >> d) & 1).astype(np.uint8)
    return np.packbits(out, axis=2, bitorder="little").view(np.uint64), low, digits


def add_up(columns: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Binary digits of the sum of bitmaps [n, words] given by significance: full adders take three to two."""
    out, place = [], 0
    while columns and place <= max(columns):
        stack = np.concatenate(columns.pop(place)) if place in columns else np.zeros((0, words), np.uint64)
        while len(stack) > 1:
            third = len(stack) // 3
            if third:
                a, b, c = stack[:third], stack[third:2 * third], stack[2 * third:3 * third]
                half = a ^ b
                carry = (a & b) | (c & half)
                stack = np.concatenate([half ^ c, stack[3 * third:]])
            else:
                carry = stack[:1] & stack[1:]
                stack = stack[:1] ^ stack[1:]
            columns.setdefault(place + 1, []).append(carry)
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        place += 1
    return out


def scored(query: np.ndarray, slices: np.ndarray, low: np.ndarray, digits: int) -> tuple[list[np.ndarray], int]:
    """(digits of every row's score as bitmaps, what to add to them)."""
    top = (1 << digits) - 1
    size = abs(query)
    shift = int((query * low).sum()) - int(size[query < 0].sum()) * top
    columns: dict[int, list[np.ndarray]] = {}
    for sign in (1, -1):
        dims = np.flatnonzero(query > 0 if sign > 0 else query < 0)
        for bit in range(int(size.max()).bit_length() if len(size) else 0):
            picked = dims[((size[dims] >> bit) & 1).astype(bool)]
            if not len(picked):
                continue
            for d in range(digits):  # (2**digits - 1) - x has the complement of the slices of x
                part = slices[picked, d]
                columns.setdefault(bit + d, []).append(part if sign > 0 else ~part)
    return add_up(columns, slices.shape[2]), shift


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def select(score: list[np.ndarray], valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap of rows surely among the top k, bitmap of the rows that tie at the boundary)."""
    sure, tied = np.zeros_like(valid), valid
    count = lambda b: int(np.bitwise_count(b).sum(dtype=np.int64))
    for digit in reversed(score):
        both = sure | (tied & digit)
        n = count(both)
        if n > k:
            tied = tied & digit
        else:
            sure, tied = both, tied & ~digit
            if n == k:
                return sure, np.zeros_like(valid)
    return sure, tied


def values_at(score: list[np.ndarray], rows: np.ndarray, wide: bool) -> np.ndarray:
    out = np.zeros(len(rows), dtype=object if wide else np.int64)
    for place, digit in enumerate(score):
        bits = ((digit[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
        out = out + bits.astype(object) * (1 << place) if wide else out | bits << place
    return out


def beyond(score: int) -> tuple[int, int, bytes | None]:
    """(class, score, key) by which scores of any size are in order: 1 for 64 bits, above it 2 and below it 0 with a key."""
    if -(1 << 63) <= score < 1 << 63:
        return 1, score, None
    size = abs(score)
    n = (size.bit_length() + 7) // 8
    key = n.to_bytes(4, "big") + size.to_bytes(n, "big")
    return (2, 0, key) if score > 0 else (0, 0, bytes(255 - b for b in key))


def build_index(vectors: DataFrame, block_rows: int, scale: float) -> DataFrame:
    """One row per block of rows of one dimension count: block, dim, wide, ids, slices, low, digits.  ``vectors``: _id, _v."""
    count = vectors.count()
    parts = max(1, math.ceil(count / block_rows))

    def block(held, wide):
        ids = np.concatenate([h[0] for h in held])
        values = np.concatenate([h[1] for h in held])
        step = max(1, block_rows // WIDE_PART) if wide else block_rows
        for at in range(0, len(ids), step):
            part, own = quantised(values[at:at + step], scale, wide), ids[at:at + step]
            order = np.argsort(own, kind="stable")
            bitmaps, low, digits = slices_of(part[order])
            yield pa.RecordBatch.from_arrays(
                [pa.array([values.shape[1]], pa.int32()), pa.array([wide]), pa.array([own[order].astype("<i8").tobytes()], pa.binary()),
                 pa.array([bitmaps.tobytes()], pa.binary()), pa.array([list(map(str, low.tolist()))], pa.list_(pa.string())),
                 pa.array([digits], pa.int32())], names=["dim", "wide", "ids", "slices", "low", "digits"])

    def build(batches):
        held: dict[tuple[int, bool], list] = {}  # by dimension and kind; written out whenever a block is full
        for batch in batches:
            rows = batch.column("_v")
            ids = batch.column("_id").to_numpy()
            sizes = np.diff(rows.offsets.to_numpy())
            flat = rows.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                values = flat[starts[own][:, None] + np.arange(dim)] if dim else np.zeros((len(own), 0))
                small = narrow(values, scale)
                for wide, pick in ((False, small), (True, ~small)):
                    if pick.any():
                        key = (int(dim), wide)
                        held.setdefault(key, []).append((ids[own[pick]], values[pick]))
                        if sum(len(h[0]) for h in held[key]) >= block_rows:
                            yield from block(held.pop(key), wide)
        for (_, wide), part in held.items():
            yield from block(part, wide)

    dealt = vectors.repartitionByRange(parts, "_id")
    return settle(dealt.mapInArrow(build, "dim int, wide boolean, ids binary, slices binary, low array<string>, digits int").withColumn(
        "block", F.monotonically_increasing_id()), "slices")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, block_rows: int = 8192,
          query_rows: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, key and score: the ``k`` best rows of every row whose key is divisible by ``every``.

    A vector that is null or holds null or non-finite components takes no part, nor does one without key; any finite
    component does.  Scores are exact whatever their size; one that does not fit into 64 bits is ranked by its value and
    given as null.  Vectors meet those of their own length only.  A query does not find rows of its own key; a repeated row asks once and is found as
    often as it is there.  Ties go to the smaller key.  Other columns are not read.
    Every query block meets every index block, as the search is exact; each pair keeps k rows a query, merged at the end.
    """
    usable = vectors.select(F.col(key).cast("long").alias("_id"), finite(vector).alias("_v")).filter(
        "_id is not null and _v is not null")
    usable = settle(usable, "finite")
    index = build_index(usable, block_rows, scale)
    asked = usable.filter(F.pmod("_id", F.lit(every)) == 0).distinct()  # a repeated row asks once
    groups = max(1, math.ceil(asked.count() / query_rows))
    queries = asked.groupBy(F.size("_v").alias("dim"), F.pmod(F.xxhash64("_id"), F.lit(groups)).alias("_g")).agg(
        F.collect_list(F.struct("_id", "_v")).alias("_q"))
    blocks = index.groupBy("dim").agg(F.collect_list("block").alias("_blocks"))  # one number per block
    cells = queries.join(blocks, "dim").select("_q", F.explode("_blocks").alias("block"))

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                words = -(-len(ids) // 64)
                slices = np.frombuffer(row["slices"], np.uint64).reshape(row["dim"], row["digits"], words)
                lows = {w: np.array(list(map(int, row["low"])), dtype=object if w else np.int64) for w in {row["wide"], True}}
                valid = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
                asked, found, kind, scores, keys = [], [], [], [], []
                for q in row["_q"]:
                    own = np.array([q["_v"]], dtype=np.float64).reshape(1, row["dim"])
                    wide = row["wide"] or not narrow(own, scale)[0]
                    score, shift = scored(quantised(own, scale, wide)[0], slices, lows[wide], row["digits"])
                    a, b = np.searchsorted(ids, q["_id"]), np.searchsorted(ids, q["_id"], "right")
                    others = valid
                    if b > a:
                        mine = np.zeros(words * 64, dtype=np.uint8)
                        mine[a:b] = 1
                        others = valid & ~np.packbits(mine, bitorder="little").view(np.uint64)
                    sure, tied = select(score, others, k)
                    rows = positions(sure)
                    if len(rows) < k:  # rows stand in order of their ids
                        rows = np.r_[rows, positions(tied)[:k - len(rows)]]
                    asked.append(np.full(len(rows), q["_id"]))
                    found.append(ids[rows])
                    values = (values_at(score, rows, wide) + shift).tolist()
                    for c, v, key in map(beyond, values) if wide else ((1, v, None) for v in values):
                        kind.append(c)
                        scores.append(v)
                        keys.append(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(asked), pa.int64()), pa.array(np.concatenate(found), pa.int64()), pa.array(kind, pa.int32()),
                     pa.array(scores, pa.int64()), pa.array(keys, pa.binary())], names=["query_id", "_id", "kind", "score", "wide_score"])

    # few bytes but much work: the number of tasks must not follow the bytes
    parts = max(index.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = cells.repartition(parts, "block").join(index.hint("merge"), "block").select("_q", "dim", "wide", "ids", "slices", "low", "digits")
    found = pairs.mapInArrow(search, "query_id long, _id long, kind int, score long, wide_score binary")
    order = Window.partitionBy("query_id").orderBy(F.col("kind").desc(), F.col("score").desc(), F.col("wide_score").desc(), "_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("_id").alias(key), F.when(F.col("kind") == 1, F.col("score")).alias("score"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
      list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

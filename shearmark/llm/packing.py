"""Best-fit packing of token pieces into sequences of a fixed capacity, in bulk-synchronous rounds.

Pieces of equal length are interchangeable, and so are gaps of equal size.  Both therefore stay range-sorted as
runs (length, count) and (free, sequences): a run table has at most ``capacity`` lengths, whatever the number of
documents.  A round takes all pieces of the longest unplaced length at once; a sweep finds the successor gaps (the
smallest that are large enough), pieces get them by rank, gaps shrink, and the next round follows.  That is
best-fit decreasing, exactly.  The plan says which ranks of a length go where; ranks of the rows are computed in
parallel (a row number inside a partition and prefix sums over partitions) and rows find their place by a join.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, settle
from .tokens import CACHE_UNITS, SLICE_BYTES, encoder, pieces_of, texts_of


def token_pieces(docs: DataFrame, path: str, limit: int = 1024, end_id: int = 2, kind: str = "byte",
                 key: str = "doc_id", text: str = "text", slice_bytes: int = SLICE_BYTES,
                 cache_units: int = CACHE_UNITS) -> DataFrame:
    """key, piece, start, length and ids (little-endian u4 bytes) of every document's pieces of at most ``limit``.

    A document is its ids and ``end_id``, so a null or empty text is one piece of one id.  Longer documents are cut
    into pieces of ``limit``, of which only the first may be shorter.  Repeated rows give repeated pieces.
    Smaller slices and caches save memory and cost time.
    """
    def cut(batches):
        tool = encoder(kind, path, cache_units)
        for batch in batches:
            for part in pieces_of(batch, "text", slice_bytes):
                ids, lens = tool.ids(texts_of(part, "text"))
                total = lens + 1
                ends = np.cumsum(total)
                flat = np.full(int(ends[-1]), end_id, dtype="<u4")
                body = np.ones(len(flat), dtype=bool)
                body[ends - 1] = False
                flat[body] = ids
                n = -(-total // limit)
                doc = np.repeat(np.arange(len(total)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                first = total - (n - 1) * limit
                length = np.where(piece == 0, first[doc], limit)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * limit)
                marks = np.r_[0, np.cumsum(length) * 4].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()),
                     pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(marks), pa.py_buffer(flat)])],
                    names=["key", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind_of_key = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(cut, f"key {kind_of_key}, piece int, start long, length long, ids binary")
    return out.withColumnRenamed("key", key)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """The plan of best-fit decreasing over runs of equal length.

    Rows (length, from rank, to rank, first sequence, pieces per sequence, offset of the first piece): the pieces of
    these ranks fill sequences from ``first sequence`` on, so many in each, one after the other.
    """
    plan, opened = [], 0
    frees: list[int] = []  # sorted sizes of the open gaps
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs (first sequence, number of sequences)

    def leave(free: int, first: int, number: int) -> None:
        if free and number:
            if free not in gaps:
                gaps[free] = []
                insort(frees, free)
            gaps[free].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(frees, length)
            if at < len(frees):
                free = frees[at]
                first, number = gaps[free].pop()
                if not gaps[free]:
                    del gaps[free], frees[at]
            else:
                free, first, number = capacity, opened, -(-left // (capacity // length))
                opened += number
            each = free // length
            full = min(number, left // each)
            part = min(left - full * each, each) if full < number else 0
            plan.append((length, rank, rank + full * each + part, first, each, capacity - free))
            leave(free - each * length, first, full)
            if part:
                leave(free - part * length, first + full, 1)
            leave(free, first + full + bool(part), number - full - bool(part))
            left, rank = left - full * each - part, rank + full * each + part
    return plan


def pack(pieces: DataFrame, capacity: int = 1024, length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset; sequences are gapless from offset 0.

    A piece without length (null or not positive) has neither.  One longer than ``capacity`` gets a sequence of its
    own.  Columns of the same names are replaced, all others kept, repeated rows are separate pieces, an empty table
    stays empty.  Only one count per length, at most ``capacity`` of them, reaches the driver.
    """
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    size = F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0))
    items = settle(pieces.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_item"), F.greatest(size, F.lit(0)).alias("_size"),
        F.least(F.greatest(size, F.lit(0)), F.lit(capacity)).alias("_len"),
        F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "pieces")
    runs = settle(items.groupBy("_part", "_len").agg(F.count(F.lit(1)).alias("_n")), "runs")
    counts = {r["_len"]: r["n"] for r in runs.groupBy("_len").agg(F.sum("_n").alias("n")).collect() if r["_len"]}
    plan = spark.createDataFrame(
        best_fit(counts, capacity) or [(0, 0, 0, 0, 1, 0)],
        "_plen long, _from long, _to long, _first long, _each long, _base long")
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    before = Window.partitionBy("_len").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select("_part", "_len", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", "_len").orderBy("_row")
    ranked = items.withColumn("_rank", F.row_number().over(inside) - 1).join(bases, ["_part", "_len"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(plan, (F.col("_len") == F.col("_plen")) & (F.col("_rank") >= F.col("_from"))
                         & (F.col("_rank") < F.col("_to")), "left")
    at = F.col("_rank") - F.col("_from")
    return placed.select(
        *[F.col("_item").getField(c).alias(c) for c in kept],
        (F.col("_first") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_base") + at % F.col("_each") * F.col("_len")).cast("long").alias("offset"))

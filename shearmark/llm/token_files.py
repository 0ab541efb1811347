"""Token ids in patched frame-of-reference blocks: written in document order, read back block by block.

A shard is one range of document ids and one or more Parquet part files; Parquet is only the container, so that
Spark's committer keeps writes whole when executors are lost.  A row is a chunk: whole documents of about
``chunk_ids`` ids, as a byte string of blocks of ``BLOCK`` ids.  A block is

    minimum u4 | width u1 | unused u1 | values u2 | exceptions u2
    values minus the minimum, the low ``width`` bits each, packed little-endian
    positions of the exceptions u2 ... | their whole differences u4 ...

with the width that ``percentile`` of the block's differences fit in.  ``block_starts`` is the byte index of the
blocks, ``doc_starts`` the place of every document in the chunk, ``start`` the chunk's place in its shard.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, settle, shared_folder
from .tokens import encoder, pieces_of, texts_of

BLOCK = 1024
HEAD = struct.Struct("<IBxHH")


def pack(values: np.ndarray, percentile: float = 0.95) -> tuple[bytes, list[int]]:
    """(bytes of all blocks, byte offset of each block) for unsigned ids below 2**32."""
    n = len(values)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, dtype=np.int64)
    padded[:n] = values
    padded[n:] = values[-1] if n else 0
    table = padded.reshape(blocks, BLOCK)
    low = table.min(axis=1)
    diff = table - low[:, None]
    place = min(BLOCK - 1, int(percentile * BLOCK))
    widths = np.ceil(np.log2(np.partition(diff, place, axis=1)[:, place] + 1)).astype(np.int64)
    kept = diff & ((1 << widths) - 1)[:, None]
    over = (diff >> widths[:, None]) > 0
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        if w == 0:
            continue
        bits = np.empty((len(rows), BLOCK, w), dtype=np.uint8)
        for b in range(w):
            bits[:, :, b] = (kept[rows] >> b) & 1
        for r, line in zip(rows, np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little"), strict=True):
            packed[r] = line.tobytes()
    out, starts, at = [], [], 0
    for r in range(blocks):
        where = np.flatnonzero(over[r])
        body = b"".join((HEAD.pack(int(low[r]), int(widths[r]), min(BLOCK, n - r * BLOCK), len(where)), packed[r],
                         where.astype("<u2").tobytes(), diff[r, where].astype("<u4").tobytes()))
        starts.append(at)
        at += len(body)
        out.append(body)
    return b"".join(out), starts


def unpack(data: bytes, starts: list[int]) -> np.ndarray:
    """All ids of the blocks that begin at ``starts``."""
    heads = [HEAD.unpack_from(data, s) for s in starts]
    out = np.zeros((len(starts), BLOCK), dtype=np.uint32)
    raw = np.frombuffer(data, dtype=np.uint8)
    widths = np.array([h[1] for h in heads], dtype=np.int64)
    begins = np.asarray(starts, dtype=np.int64) + HEAD.size
    for w in np.unique(widths):
        if w == 0:
            continue
        rows, size = np.flatnonzero(widths == w), BLOCK // 8 * int(w)
        bits = np.unpackbits(raw[begins[rows][:, None] + np.arange(size)], axis=1, bitorder="little")
        bits = bits.reshape(len(rows), BLOCK, w)
        for b in range(w):
            out[rows] |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
    for r, (low, w, _, odd) in enumerate(heads):
        if odd:
            at = int(begins[r]) + BLOCK // 8 * w
            where = np.frombuffer(data, "<u2", odd, at)
            out[r, where] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
        out[r] += np.uint32(low)
    return np.concatenate([out[r, :h[2]] for r, h in enumerate(heads)]) if heads else out.reshape(-1)


def read_slice(data: bytes, block_starts: list[int], first: int, count: int) -> np.ndarray:
    """Ids [first, first + count) of a chunk, decoding only the blocks that hold them."""
    if count <= 0:
        return np.zeros(0, dtype=np.uint32)
    a, b = first // BLOCK, (first + count - 1) // BLOCK
    return unpack(data, block_starts[a:b + 1])[first - a * BLOCK:first - a * BLOCK + count]


def write_token_files(docs: DataFrame, path: str, out: str | None = None, kind: str = "word", end_id: int = 2,
                      shards: int | None = None, chunk_ids: int = 1 << 16, percentile: float = 0.95,
                      key: str = "doc_id", text: str = "text") -> str:
    """Encode every text, append ``end_id``, write the ids in ascending ``key`` order; returns the folder.

    Null and empty texts are a single end id.  Null keys come first.  Repeated keys follow each other, ordered by
    a hash of the text; a range of equal (key, text) rows stays in one shard.  Other columns are not read.
    """
    spark = docs.sparkSession
    out = out or shared_folder(spark, "token_ids")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def chunk(shard, number, start, keys, sizes, ids):
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        data, blocks = pack(flat, percentile)
        ends = np.cumsum(sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()),
             pa.array([len(flat)], pa.int64()), pa.array([pa.concat_arrays(keys).to_pylist()], pa.list_(keys[0].type)),
             pa.array([(ends - sizes).tolist()], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.int32())),
             pa.array([data], pa.binary())],
            names=["shard", "chunk", "start", "n_ids", "keys", "doc_starts", "block_starts", "data"])

    def write(batches):
        tool, shard = encoder(kind, path), TaskContext.get().partitionId()
        number, start, held, keys, sizes, ids = 0, 0, 0, [], [], []
        for batch in batches:
            for part in pieces_of(batch, "text"):
                flat, lens = tool.ids(texts_of(part, "text"))
                total = lens + 1
                ends = np.cumsum(total)
                marked = np.full(int(ends[-1]) if len(ends) else 0, end_id, dtype=np.uint32)
                body = np.ones(len(marked), dtype=bool)
                body[ends - 1] = False
                marked[body] = flat
                group = (held + ends - 1) // chunk_ids
                cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(total)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if held and (held + int(total[a:b].sum())) > chunk_ids:
                        yield chunk(shard, number, start, keys, np.concatenate(sizes), ids)
                        number, start, held, keys, sizes, ids = number + 1, start + held, 0, [], [], []
                    keys.append(part.column("key").slice(a, b - a))
                    sizes.append(total[a:b])
                    ids.append(marked[ends[a] - total[a]:ends[b - 1]])
                    held += int(total[a:b].sum())
        if held:
            yield chunk(shard, number, start, keys, np.concatenate(sizes), ids)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind_of_key = rows.schema["key"].dataType.simpleString()
    ranged = rows.repartitionByRange(shards, F.col("key").asc_nulls_first(), F.xxhash64("text"))
    ranged = ranged.sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"))
    ranged.mapInArrow(write, f"shard int, chunk int, start long, n_ids long, keys array<{kind_of_key}>, "
                      "doc_starts array<long>, block_starts array<int>, data binary").write.option(
        "compression", "none").parquet(out)
    return out


def shard_starts(files: DataFrame) -> DataFrame:
    """First id of every shard: ``shard``, ``base``.  One row per shard, so a window over all of them is small."""
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("base"))


def read_token_files(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document, decoded from the blocks: key, start, n_tokens, ids (little-endian u4 bytes)."""
    kind_of_key = files.schema["keys"].dataType.elementType.simpleString()
    bases = settle(shard_starts(files), "shard_starts")
    if bases.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    placed = files.join(bases, "shard").withColumn("start", F.col("start") + F.col("base"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["data"], row["block_starts"]).astype("<u4")
                places = [*row["doc_starts"], row["n_ids"]]
                raw = [ids[a:b].tobytes() for a, b in zip(places, places[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], batch.schema.field("keys").type.value_type),
                     pa.array([row["start"] + p for p in places[:-1]], pa.int64()),
                     pa.array(np.diff(places), pa.int64()), pa.array(raw, pa.binary())],
                    names=["key", "start", "n_tokens", "ids"])

    return placed.select("start", "n_ids", "keys", "doc_starts", "block_starts", "data").mapInArrow(
        read, f"key {kind_of_key}, start long, n_tokens long, ids binary").withColumnRenamed("key", key)

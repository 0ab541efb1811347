"""Sharding by a permutation-filled lookup table: shards take turns claiming slots by their own preference order."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65537  # a prime, at least a hundred times the number of shards


def preference(shard: str, slots: int) -> tuple[int, int]:
    """(first slot, step): with a prime number of slots every step walks over all of them."""
    digest = hashlib.md5(shard.encode()).digest()
    return int.from_bytes(digest[:8], "little") % slots, int.from_bytes(digest[8:], "little") % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Shard number of every slot.  Shard sizes differ by one slot at most, and few slots move when a shard leaves."""
    if not 0 < len(shards) <= slots or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number, not below the number of shards")
    table, filled = [-1] * slots, 0
    walks = [preference(s, slots) for s in shards]
    at = [first for first, _ in walks]
    while True:
        for n, (_, step) in enumerate(walks):
            while table[at[n]] >= 0:
                at[n] = (at[n] + step) % slots
            table[at[n]] = n
            filled += 1
            if filled == slots:
                return table


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard), at most ``slots`` of them."""
    values = ",".join(map(str, lookup_table(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(values), ",")).alias("slot", "_n")).select(
        "slot", F.col("_n").cast("int").alias("shard"))


def slot_of(key: str, text: str, slots: int = SLOTS) -> Column:
    """Slot of a row by its key; rows without key spread by their text."""
    spread = F.when(F.col(key).isNull(), F.col(text))
    return F.pmod(F.xxhash64(F.col(key), spread), F.lit(slots)).cast("int")


def assign_shards(docs: DataFrame, shards: list[str], slots: int = SLOTS, key: str = "doc_id", text: str = "text",
                  columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all by default) of every row with its slot and shard number, without a shuffle.

    Equal keys share a shard; repeated rows stay.  Columns named slot or shard are replaced, all others kept.  The
    broadcast table has ``slots`` rows whatever the data.  An empty table gives no rows.
    """
    kept = [c for c in columns or docs.columns if c not in ("slot", "shard")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), slot_of(key, text, slots).alias("_slot"))
    table = F.broadcast(table_frame(docs.sparkSession, shards, slots))
    return rows.join(table, F.col("_slot") == F.col("slot")).select(
        *[F.col("_row").getField(c).alias(c) for c in kept], "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: list[str], slots: int = SLOTS, tasks_per_shard: int = 4,
                 key: str = "doc_id", text: str = "text") -> str:
    """Write every shard to a folder of its own; a shard is written by several tasks, so a large one holds none up."""
    placed = assign_shards(docs, shards, slots, key, text)
    salted = placed.withColumn("_salt", F.pmod(F.xxhash64(text), F.lit(tasks_per_shard)))
    salted.repartition(len(shards) * tasks_per_shard, "shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)
    return path

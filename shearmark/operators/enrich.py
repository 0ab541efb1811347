"""Pre-ranked gene-set enrichment as joins and running sums over hit rows only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, settle, small_side
from ..schemas import MIN_RANKED_GENES, SET_SIZE
from .ordering import rank_list


RANK_CELLS = 10_000_000  # of four bytes
PERM_CHUNK = 25


def set_members(ranked: DataFrame, sets: DataFrame) -> DataFrame:
    """Ranked genes joined to the sets they belong to; the set table is broadcast if its count allows."""
    return ranked.join(small_side(sets.select(F.col("set_name").alias("pathway"), "gene")), "gene")


def running_score(hits: DataFrame, by: list[str]) -> DataFrame:
    """Enrichment score per (by, pathway) from hit rows with pos, weight and n_genes.

    The running sum peaks right after a hit and bottoms right before one, so
    only those two values per hit are looked at.  A window spans one set's
    members.
    """
    group = Window.partitionBy(*by, "pathway")
    upto = group.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.withColumns({
        "cum": F.sum("weight").over(upto), "i": F.count(F.lit(1)).over(upto),
        "nr": F.sum("weight").over(group), "nh": F.count(F.lit(1)).over(group)})
    miss = F.try_divide((F.col("pos") - F.col("i")).cast("double"), (F.col("n_genes") - F.col("nh")).cast("double"))
    after = F.try_divide("cum", "nr") - miss
    before = F.try_divide(F.col("cum") - F.col("weight"), F.col("nr")) - miss
    ends = rows.groupBy(*by, "pathway").agg(F.max(after).alias("up"), F.min(before).alias("down"))
    return ends.select(*by, "pathway", _peak(F.col("up"), F.col("down")).alias("es"))


def _peak(up: Column, down: Column) -> Column:
    """The end of larger size; the upper one when they agree to nine decimals."""
    return F.when(F.round(up + down, 9) >= 0, up).otherwise(down)


def _sized(hits: DataFrame, by: list[str], size: tuple[int, int]) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, "pathway"))
    return hits.withColumn("_n", n).filter(F.col("_n").between(*size)).drop("_n")


def permutation_ranks(genes: DataFrame, n_perm: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(gene, gid) with numbers from 0, and (chunk, ranks): the place of every gid in each permutation of all genes, PERM_CHUNK
    permutations to a row.

    Permutation b orders the genes by md5(gene|b|seed), so it is the same on every run and in every engine.  All tests
    share this table; the genes of a test keep their order in it.  A window spans the gene catalogue.
    """
    numbered = settle(genes.select("gene").filter(F.col("gene").isNotNull()).distinct().withColumn(
        "gid", (F.row_number().over(Window.orderBy("gene")) - 1).cast("int")), "gene_numbers")
    keyed = numbered.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm)))).withColumn(
        "key", F.md5(F.concat(F.col("gene"), F.lit("|"), F.col("perm").cast("string"), F.lit(f"|{seed}"))))
    place = (F.row_number().over(Window.partitionBy("perm").orderBy("key", "gene")) - 1).cast("int")
    ranked = keyed.select("perm", "gid", place.alias("rank"))
    ranks = ranked.groupBy("perm").agg(F.sort_array(F.collect_list(F.struct("gid", "rank"))).alias("_r"))
    chunks = ranks.groupBy(F.floor((F.col("perm") - 1) / PERM_CHUNK).cast("int").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("perm", F.col("_r.rank").alias("ranks")))).alias("_c"))
    return numbered, settle(chunks.select("chunk", F.col("_c.ranks").alias("ranks")), "permutations")


def null_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums and numbers of the positive and negative null scores of every set, for the permutations of each row.

    ``rows``: by, gids and weights of the test's genes by position, sets (pathway, members: positions), ranks.  Permutation
    b puts the genes in the order of their ranks over the fixed weights.
    """
    names = [*by, "pathway", "up", "n_up", "down", "n_down"]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in by}

    def scan(batches):
        for batch in batches:
            keys, out = [], {c: [] for c in names[len(by):]}
            for i in range(batch.num_rows):
                gids, weights = (batch.column(c)[i].values.to_numpy() for c in ("gids", "weights"))
                table, n = batch.column("ranks")[i].values, len(gids)
                ranks = table.flatten().to_numpy().reshape(len(table), -1)[:, gids]
                place = np.argsort(np.argsort(ranks, axis=1), axis=1)
                for s in batch.column("sets")[i].as_py():
                    members = np.array(s["members"]) - 1
                    pos = np.sort(place[:, members], axis=1)
                    weight = weights[pos]
                    cum, m = np.cumsum(weight, axis=1), len(members)
                    total = cum[:, -1:]
                    if m < n:
                        with np.errstate(all="ignore"):
                            miss = (pos - np.arange(m)) / (n - m)
                            high = (cum / total - miss).max(axis=1)
                            low = ((cum - weight) / total - miss).min(axis=1)
                        score = np.where(np.round(high + low, 9) >= 0, high, low)[total[:, 0] > 0]
                    else:
                        score = np.zeros(0)
                    keys.append(i)
                    for c, v in zip(names[len(by):], (s["pathway"], score[score > 0].sum(), (score > 0).sum(), -score[score < 0].sum(),
                                                      (score < 0).sum()), strict=True):
                        out[c].append(v)
            at = pa.array(keys, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(at) for c in by], pa.array(out["pathway"], pa.string()), pa.array(out["up"], pa.float64()),
                 pa.array(out["n_up"], pa.int64()), pa.array(out["down"], pa.float64()), pa.array(out["n_down"], pa.int64())], names=names)

    return rows.mapInArrow(scan, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", pathway string, up double, n_up long, down double, n_down long")


def enrich_prerank(results: DataFrame, sets: DataFrame, by: list[str], n_perm: int = 100, seed: int = 42,
                   size: tuple[int, int] = SET_SIZE, min_genes: int = MIN_RANKED_GENES,
                   table_cells: int = RANK_CELLS) -> DataFrame:
    """ES and NES of every set in every test (``by``) with enough non-zero statistics.

    Null: the genes of a test in the order of ``permutation_ranks``.  NES = ES over the mean absolute null ES of the
    same sign.

    A test's rank list (bounded by the gene catalogue) becomes one row of arrays.  The rank table of all tests is
    attached to it, some permutations at a time, by broadcast while it has at most ``table_cells`` numbers, and all sets
    are scored for them in one batch of array operations.
    """
    ranked = settle(rank_list(results.select(*by, "gene", "stat"), by, min_genes=min_genes)
                    .withColumn("weight", F.abs("stat")).drop("stat"), "ranked")
    members = small_side(sets.select(F.col("set_name").alias("pathway"), "gene"))
    hits = settle(_sized(ranked.join(members, "gene"), by, size).select(
        *by, "pathway", "pos", "n_genes", "weight"), "hits")
    observed = running_score(hits, by)

    numbers, ranks = permutation_ranks(ranked, n_perm, seed)
    n_genes = numbers.count()
    numbers = F.broadcast(numbers) if n_genes <= BROADCAST_ROWS else numbers
    lists = ranked.join(numbers, "gene").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "gid", "weight"))).alias("r"))
    per_set = hits.groupBy(*by, "pathway").agg(F.collect_list("pos").alias("members"))
    per_test = per_set.groupBy(*by).agg(F.collect_list(F.struct("pathway", "members")).alias("sets"))
    # The array work outweighs the bytes by far.  Hashing an expression asks for a partitioning of its own,
    # which is neither dropped as redundant nor coalesced by size.
    parts = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lists.join(per_test, by).repartition(parts, F.xxhash64(*by)).select(
        *by, "sets", F.col("r.gid").alias("gids"), F.col("r.weight").alias("weights"))
    ranks = F.broadcast(ranks) if n_genes * n_perm <= table_cells else ranks.hint("merge")
    chunks = F.sequence(F.lit(0), F.lit((n_perm - 1) // PERM_CHUNK))
    scored = null_scores(rows.withColumn("chunk", F.explode(chunks)).join(ranks, "chunk"), by)
    null = scored.groupBy(*by, "pathway").agg(F.try_divide(F.sum("up"), F.sum("n_up")).alias("up"),
                                              F.try_divide(F.sum("down"), F.sum("n_down")).alias("down"))
    scale = F.when(F.col("es") >= 0, F.col("up")).otherwise(F.col("down"))
    return observed.join(null, [*by, "pathway"], "left").select(
        *by, "pathway", "es", F.try_divide(F.col("es"), scale).alias("nes"))

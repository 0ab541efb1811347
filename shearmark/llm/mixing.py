"""Mixing sources to target weights: tokens per source, repetition rates, floor(rate) copies and one by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import join_groups, settle

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"


def word_count(text: str = "text") -> Column:
    """Words of a text, separated by ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target and rate from rows (source, size); one row per source, the null source included.

    Weights repeat over the sources in code point order, null last.  Targets share ``share`` of all sizes by weight
    and stop at ``cap`` times the source's size; what is beyond is shared again, which ends where every open source
    gets the same amount per weight.  Sources are ordered by the amount per weight at which they stop: the first one
    that does not reach it gives that amount.  A source without words has target 0 and rate 1.
    """
    total = settle(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = total.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = numbered.withColumns({
        "_w": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")),
        "_cap": F.col("source_size") * F.lit(float(cap)),
        "_all": F.sum("source_size").over(everything) * F.lit(float(share))})
    ranked = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    capped = ranked.rowsBetween(Window.unboundedPreceding, -1)
    swept = weighed.withColumns({
        "_rank": F.row_number().over(ranked),
        "_rest": F.col("_all") - F.coalesce(F.sum("_cap").over(capped), F.lit(0.0)),
        "_open": F.sum("_w").over(ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    stop = F.min(F.when(F.col("_rest") * F.col("_w") <= F.col("_cap") * F.col("_open"), F.col("_rank"))).over(everything)
    found = swept.withColumn("_stop", stop).withColumn(
        "_level", F.min(F.when(F.col("_rank") == F.col("_stop"), F.col("_rest") / F.col("_open"))).over(everything))
    target = F.when(F.col("_rank") >= F.col("_stop"), F.least(F.col("_w") * F.col("_level"), F.col("_cap"))).otherwise(F.col("_cap"))
    return found.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0)))


def chance(key: str, text: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from a row's key; a row without key takes its text."""
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text), F.lit(""))))
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def copies(rate: Column, draw: Column) -> Column:
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
        key: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED) -> DataFrame:
    """One row per document: key, size, source_size, target, taken (size times copies), copies.

    The draw depends on key and seed alone, so reruns agree and repeated rows share a decision.  Null source is a
    source, null text has size 0, an empty table gives none.  The sources are joined back as one row each, after a
    count, never by moving the documents of a large source to one task.
    """
    rows = settle(docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), word_count(text).alias("size"),
                              chance(key, text, seed).alias("_draw")), "sizes")
    targets = settle(source_targets(rows, weights, share, cap), "targets")
    n = copies(F.col("rate"), F.col("_draw"))
    return join_groups(rows, targets, ["source"]).select(
        F.col("_key").alias(key), "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
                    key: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is drawn, with the columns of ``docs``."""
    sizes = docs.select(F.col(source).alias("source"), word_count(text).alias("size"))
    targets = settle(source_targets(sizes, weights, share, cap), "targets").select("source", "rate")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(source).alias("source"),
                       chance(key, text, seed).alias("_draw"))
    drawn = join_groups(rows, targets, ["source"]).select(
        "_doc", F.explode(F.array_repeat(F.lit(0), copies(F.col("rate"), F.col("_draw")).cast("int"))))
    return drawn.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 13))::BIGINT
           / 4503599627370496.0 AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i, source_size * 2.0::DOUBLE AS lim,
      (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS budget FROM s),
v AS (SELECT *, (CASE i % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS weight FROM w),
r AS (SELECT *, row_number() OVER o AS place,
      budget - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS rest,
      sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
      FROM v WINDOW o AS (ORDER BY lim / weight, i)),
t AS (SELECT *, min(CASE WHEN rest * weight <= lim * open THEN place END) OVER () AS stop FROM r),
l AS (SELECT *, min(CASE WHEN place = stop THEN rest / open END) OVER () AS level FROM t),
g AS (SELECT source, source_size, CASE WHEN place >= stop THEN least(weight * level, lim) ELSE lim END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS rate FROM g)
SELECT doc_id, size, source_size, target, ((floor(rate) + (draw < rate - floor(rate))::INT) * size)::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""

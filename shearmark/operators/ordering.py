"""Exact order statistics that do not depend on a group fitting in one task.

Quantiles come from histograms of leading digits, which are merged map-side: the digit that holds a quantile's rank is
counted again by its next digits, until it is one value or few enough to be sorted.  All groups, columns and
quantiles go through the same passes.

Ranks count their largest group first.  While that fits, a window runs.  Beyond it the distinct values are counted,
range-partitioned over the whole cluster and numbered by two-level prefix sums, so a group with a third of all rows is
spread like any other data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, GROUP_ROWS, join_groups, largest_group, settle

LEAF_VALUES = 4096
DIGITS = 4096


def cumulate(values: DataFrame, by: list[str], order: list[str], weight: str = "n") -> DataFrame:
    """Add ``below`` (weight before the row in its group) and ``total`` (weight of the group).

    ``values`` holds one row per (by, order).  Range partitions become numbered
    pieces; a window only ever sees one group's rows inside one piece, or one
    sum per piece.
    """
    spark = values.sparkSession
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(
        values.repartitionByRange(pieces, *by, *order).withColumn("_piece", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(*by, "_piece").agg(F.sum(weight).alias("_sum"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(sums.select(
        *by, "_piece", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(whole).alias("total")), "offsets")
    inside = Window.partitionBy(*by, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (join_groups(ranged, offsets, [*by, "_piece"])
            .withColumn("below", F.col("_offset") + F.sum(weight).over(inside) - F.col(weight))
            .drop("_offset"))


def first_digit(v: Column) -> Column:
    """Number of a double's first digit in ascending order: sign and binary logarithm in steps of 1/64.

    Zero is 0, infinities and NaN (which Spark sorts last) have digits of their own.  The logarithm is monotone, so
    digits are in the order of values whatever its rounding.
    """
    size = F.floor(F.log2(F.abs(v)) * 64).cast("int") + 70_000  # from 2**-1074 to 2**1024: positive
    return (F.when(F.isnan(v), 200_000).when(v == float("inf"), 190_000).when(v == float("-inf"), -190_000)
            .when(v == 0, 0).when(v > 0, size).otherwise(-size))


def select_ranks(long: DataFrame, keys: list[str], wanted: list[tuple[int, float]], leaf: int) -> tuple[DataFrame, int]:
    """(keys, _q, _part, value, _w): per quantile the values at the ranks below and above it, and its weight between them;
    and a bound of their number.

    ``long`` has (keys, _col, _v) with non-null values; ``wanted`` the (column number, probability) of every quantile.
    A task sees counts of digits, and at most ``leaf`` values of one digit.
    """
    group = Window.partitionBy(*keys, "_col")
    digits = long.groupBy(*keys, "_col", first_digit(F.col("_v")).alias("_d")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    return refined(long, keys, placed(digits, group, wanted), leaf)


def placed(digits: DataFrame, group, wanted: list[tuple[int, float]]) -> DataFrame:
    """The digits (_col, _n, _lo, _hi and keys) that hold the ranks of the wanted quantiles, with the rank inside (_k) and the
    number of all values of the group's column (_total)."""
    upto = group.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)  # some thousand digits at most
    counted = digits.withColumns({"_below": F.coalesce(F.sum("_n").over(upto), F.lit(0)), "_total": F.sum("_n").over(group)})
    ranks = []
    for q, (c, p) in enumerate(wanted):
        h = (F.col("_total") - 1) * F.lit(float(p))
        ranks += [F.struct(F.lit(c).alias("_c"), F.lit(q).alias("_q"), F.lit(part).alias("_part"), (h - F.floor(h)).alias("_w"),
                           r.cast("long").alias("_k")) for part, r in ((0, F.floor(h)), (1, F.ceil(h)))]
    hit = counted.withColumn("_r", F.explode(F.filter(F.array(*ranks), lambda r: (r["_c"] == F.col("_col")) & (
        r["_k"] >= F.col("_below")) & (r["_k"] < F.col("_below") + F.col("_n")))))
    return hit.withColumns({"_q": F.col("_r._q"), "_part": F.col("_r._part"), "_w": F.col("_r._w"),
                            "_k": F.col("_r._k") - F.col("_below")}).drop("_r", "_below", "_d")


def refined(long: DataFrame, keys: list[str], found: DataFrame, leaf: int) -> tuple[DataFrame, int]:
    """Values at the ranks that ``placed`` has found the digits of, and their number; only rows of digits that hold more than
    one value are read."""
    place = ["_q", "_part", "_w"]
    found = settle(found, "digits")
    one = F.col("_lo") == F.col("_hi")
    done, open_ = found.filter(one).select(*keys, *place, F.col("_lo").alias("value")), found.filter(~one)
    total, left, most = found.agg(F.count(F.lit(1)), F.count_if(~one), F.max("_total")).first()
    while left:
        ranges = open_.select(*keys, "_col", "_lo", "_hi", "_n").distinct()
        inside = join_groups(long, ranges, [*keys, "_col"], rows=left, largest=most).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        few = F.col("_n") <= leaf
        step = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * DIGITS)  # splits lo from hi in any case
        digits = inside.groupBy(*keys, "_col", "_lo", "_hi", F.when(few, 0).otherwise(F.least(step, F.lit(DIGITS - 1))).alias("_d")).agg(
            F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_l"), F.max("_v").alias("_h"),
            F.sort_array(F.collect_list(F.when(few, F.col("_v")))).alias("_vs"))
        span = Window.partitionBy(*keys, "_col", "_lo", "_hi").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
        digits = digits.withColumn("_below", F.coalesce(F.sum("_m").over(span), F.lit(0)))
        digits = digits if left <= BROADCAST_ROWS else settle(digits, "digits")
        hit = join_groups(digits, open_.drop("_n"), [*keys, "_col", "_lo", "_hi"], rows=left, largest=DIGITS).filter(
            (F.col("_k") >= F.col("_below")) & (F.col("_k") < F.col("_below") + F.col("_m")))
        value = F.when(F.size("_vs") > 0, F.get("_vs", F.col("_k").cast("int"))).when(F.col("_l") == F.col("_h"), F.col("_l"))
        found = settle(hit.select(*keys, "_col", *place, value.alias("value"), (F.col("_k") - F.col("_below")).alias("_k"),
                                  F.col("_m").alias("_n"), F.col("_l").alias("_lo"), F.col("_h").alias("_hi")), "digits")
        done = done.unionByName(found.filter("value is not null").select(*keys, *place, "value"))
        open_ = found.filter("value is null").drop("value")
        left = open_.count()
    return done, total


def interpolated(found: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row per group from ``refined``: every quantile between its two values."""
    picks = []
    for q, name in enumerate(names):
        low, high = (F.max(F.when((F.col("_q") == q) & (F.col("_part") == part), F.col("value"))) for part in (0, 1))
        weight = F.max(F.when(F.col("_q") == q, F.col("_w")))
        picks.append(F.when(low == high, low).otherwise(low + (high - low) * weight).alias(name))
    return found.groupBy(*keys).agg(*picks)


def summarise(df: DataFrame, by: list[str], quantiles: dict[str, tuple[str, float]],
              aggs: list[Column] = (), leaf: int = LEAF_VALUES) -> DataFrame:
    """One row per group: ``aggs`` plus exact, linearly interpolated quantiles.

    ``quantiles`` maps an output name to (column, probability); null values are skipped and null keys form a group of
    their own.  ``df`` is evaluated once and written; the passes read its columns.
    """
    keys = by or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    if not hasattr(df, "settled_path"):
        source = settle(source, "summarised")
    cols = sorted({c for c, _ in quantiles.values()})
    long = source.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_col"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)])).alias("_e")
    ).select(*keys, "_e.*").filter(F.col("_v").isNotNull())
    found, rows = select_ranks(long, keys, [(cols.index(c), p) for c, p in quantiles.values()], leaf)
    found = interpolated(found, keys, list(quantiles))
    if not by:
        return source.groupBy().agg(F.lit(0).alias("_all"), *aggs).join(found, "_all", "left").drop("_all")
    base = source.groupBy(*keys).agg(*aggs) if aggs else source.select(*keys).distinct()
    found = found if rows <= BROADCAST_ROWS else settle(found, "quantiles")
    return join_groups(base, found, keys, "left", rows=rows, largest=1)


def following(values: DataFrame, by: list[str], order: str, out: str) -> DataFrame:
    """Add the next larger ``order`` of the group, by range-partitioned pieces; ``values`` has one row per (by, order)."""
    pieces = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(values.repartitionByRange(pieces, *by, order).withColumn("_piece", F.spark_partition_id()), "ranged")
    firsts = ranged.groupBy(*by, "_piece").agg(F.min(order).alias("_first"))
    later = F.lead("_first").over(Window.partitionBy(*by).orderBy("_piece"))  # one row a piece
    firsts = settle(firsts.withColumn("_later", later).drop("_first"), "firsts")
    inside = F.lead(order).over(Window.partitionBy(*by, "_piece").orderBy(order))
    return join_groups(ranged, firsts, [*by, "_piece"]).withColumn(out, F.coalesce(inside, F.col("_later"))).drop("_piece", "_later")


def join_per_key(df: DataFrame, per_key: DataFrame, on: list[str], weight: str = "n",
                 limit: int = GROUP_ROWS) -> DataFrame:
    """Join a unique-key table back to its rows, keeping keys with over ``limit`` rows out of the shuffle.

    There are at most rows / limit such keys, and they are counted before the
    broadcast; all other keys take a normal join.  Null keys match everywhere.
    """
    def null_safe_join(rows, keys, how):
        right = keys.withColumnsRenamed({c: f"_k_{c}" for c in on})
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        return rows.join(right, cond, how).drop(*[f"_k_{c}" for c in on])

    table = settle(per_key, "per_key")
    hot = table.filter(F.col(weight) > limit)
    cold = table.filter(F.col(weight) <= limit)
    if hot.isEmpty():
        return null_safe_join(df, table, "inner")
    heavy = join_groups(df, settle(hot, "hot"), on)
    few = hot.count() <= BROADCAST_ROWS
    rest = null_safe_join(df, F.broadcast(hot.select(*on)), "left_anti") if few else df
    return heavy.select(*df.columns, *[c for c in table.columns if c not in on]).unionByName(
        null_safe_join(rest, cold, "inner").select(*df.columns, *[c for c in table.columns if c not in on]))


def avg_rank(df: DataFrame, by: list[str], col: str, out: str = "rank", bounded: bool = False,
             limit: int = GROUP_ROWS) -> DataFrame:
    """Average rank of ``col`` within its group, ties sharing the mean position.

    ``bounded`` skips the size check where the caller's groups cannot grow with
    the data (the genes of one sample, the pathways of one result).
    """
    if bounded or largest_group(df, by) <= limit:
        ordered = Window.partitionBy(*by).orderBy(col)
        peers = ordered.rangeBetween(Window.currentRow, Window.currentRow)  # same shuffle, same sort
        return df.withColumn(out, F.rank().over(ordered) + (F.count(F.lit(1)).over(peers) - 1) / F.lit(2.0))
    values = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("_weight"))
    ranks = cumulate(values, by, [col], "_weight").select(
        *by, col, "_weight", (F.col("below") + (F.col("_weight") + 1) / F.lit(2.0)).alias(out))
    return join_per_key(df, ranks, [*by, col], "_weight", limit).drop("_weight")


def bh_adjust(df: DataFrame, by: list[str], p: str, out: str = "padj", bounded: bool = False,
              limit: int = GROUP_ROWS) -> DataFrame:
    """Benjamini-Hochberg step-up adjusted p-values within each group."""
    if bounded or largest_group(df, by) <= limit:
        group = Window.partitionBy(*by)
        upto = group.orderBy(p)
        beyond = group.orderBy(F.col(p).desc())
        return (df.withColumn("_raw", F.col(p) * F.count(F.lit(1)).over(group) / F.count(F.lit(1)).over(upto))
                .withColumn(out, F.least(F.lit(1.0), F.min("_raw").over(beyond))).drop("_raw"))
    values = df.groupBy(*by, p).agg(F.count(F.lit(1)).alias("_weight"))
    ranked = cumulate(values, by, [p], "_weight").withColumn(
        "_raw", F.col(p) * F.col("total") / (F.col("below") + F.col("_weight")))
    ranked = settle(ranked, "bh")
    later = Window.partitionBy(*by).orderBy(F.col("_piece").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tails = ranked.groupBy(*by, "_piece").agg(F.min("_raw").alias("_m")).select(
        *by, "_piece", F.min("_m").over(later).alias("_tail"))
    inside = Window.partitionBy(*by, "_piece").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = join_groups(ranked, settle(tails, "tails"), [*by, "_piece"]).select(
        *by, p, "_weight", F.least(F.lit(1.0), F.min("_raw").over(inside), F.col("_tail")).alias(out))
    return join_per_key(df, adjusted, [*by, p], "_weight", limit).drop("_weight")


def top_abs(df: DataFrame, by: list[str], col: str, k: int = 20, tie: str = "pathway") -> DataFrame:
    """The ``k`` rows of largest absolute value per group, ties broken by name."""
    order = Window.partitionBy(*by).orderBy(F.abs(F.col(col)).desc(), F.col(tie))
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k).drop("_rn")


def tail_mean(df: DataFrame, by: list[str], pos: str, col: str, n: int = 10, out: str = "tail_mean") -> DataFrame:
    """Mean of the last ``n`` positions of each group (all of them when there are fewer)."""
    last = Window.partitionBy(*by).orderBy(F.col(pos).desc())
    return (df.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= n)
            .groupBy(*by).agg(F.avg(col).alias(out)))


def rank_list(df: DataFrame, by: list[str], stat: str = "stat", min_genes: int = 50) -> DataFrame:
    """Descending rank list of the non-zero statistics; groups under ``min_genes`` are dropped.

    A group is one test's genes, so it is bounded by the gene catalogue.
    """
    group = Window.partitionBy(*by)
    order = group.orderBy(F.col(stat).desc(), F.col("gene"))
    return (df.filter(F.col(stat) != 0)
            .withColumn("pos", F.row_number().over(order))
            .withColumn("n_genes", F.count(F.lit(1)).over(group))
            .filter(F.col("n_genes") >= min_genes))


def first_sign(df: DataFrame, by: list[str], col: str, order: Column, thr: float) -> DataFrame:
    """Sign of the first value beyond ``thr`` in the given order, per group."""
    hit = F.abs(F.col(col)) > thr
    return (df.filter(hit).groupBy(*by)
            .agg(F.min_by(F.signum(F.col(col)).cast("int"), order).alias("first_sign")))


def ordered(df: DataFrame, keys: list) -> DataFrame:
    """Sort by several keys."""
    return df.orderBy(*keys)


def top_n(df: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` rows with the highest score."""
    return df.orderBy(F.col(col).desc(), *[c for c in df.columns if c != col]).limit(n)

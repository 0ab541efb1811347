"""Concordance statistics, trends, histograms and mutual information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import to_double
from ..runtime import join_groups, settle
from ..schemas import MIN_PAIRS, PROFILE_PAIRS
from .ordering import avg_rank, cumulate, following, summarise


def pearson(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null for a constant side.

    A side is constant by its least and largest value: merged partial means are rounded, and leave a constant a tiny deviation.
    """
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)))


def spearman(df: DataFrame, by: list[str], x: str, y: str, min_pairs: int = MIN_PAIRS,
             bounded: bool = False, out: str = "rho") -> DataFrame:
    """Spearman correlation per group over complete pairs; null under ``min_pairs``.

    Groups without a single complete pair do not appear.
    """
    pairs = df.select(*by, to_double(F.col(x)).alias("_x"), to_double(F.col(y)).alias("_y")).dropna(
        subset=["_x", "_y"])
    ranked = avg_rank(avg_rank(pairs, by, "_x", "_rx", bounded), by, "_y", "_ry", bounded)
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.when(F.count(F.lit(1)) >= min_pairs, pearson("_rx", "_ry")).alias(out))


def jaccard(a: DataFrame, b: DataFrame, by: list[str], key: str, contexts: DataFrame | None = None,
            out: str = "jaccard") -> DataFrame:
    """Jaccard index of two keyed sets per group: 1 when both are empty, 0 when one is.

    ``contexts`` lists the groups to report, so that an empty pair has a row.
    """
    flags = (a.select(*by, key).withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0))
             .unionByName(b.select(*by, key).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
             .groupBy(*by, key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")))
    index = flags.groupBy(*by).agg((F.sum(F.col("_a") * F.col("_b")) / F.count(F.lit(1))).alias(out))
    if contexts is None:
        return index
    return (contexts.select(*by).distinct().join(index, by, "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(1.0))))


def direction_concordance(cand: DataFrame, top: DataFrame, by: list[str], on: list[str], key: str, col: str,
                          out: str = "dir_concordance") -> DataFrame:
    """Share of the reference's top items, found in the candidate, whose sign agrees.

    ``top`` has (on, key, ref_sign); candidate groups sharing none do not appear.
    """
    shared = cand.join(top, [*on, key])
    same = (F.signum(F.col(col)).cast("int") == F.col("ref_sign")).cast("double")
    return shared.groupBy(*by).agg(F.avg(same).alias(out))


def vote(sign_of: Column, order: Column, n_methods: Column, frac: float) -> Column:
    """Aggregate: do at least ``frac`` of the methods share the first significant method's sign?

    ``sign_of`` is the method's sign where it is significant, else null.
    """
    first = F.min_by(sign_of, F.when(sign_of.isNotNull(), order))
    agree = F.when(first > 0, F.count_if(sign_of > 0)).otherwise(F.count_if(sign_of < 0))
    return F.coalesce(first.isNotNull() & (agree / n_methods >= frac), F.lit(False))


def sign_vote(df: DataFrame, by: list[str], key: str, col: str, thr: float, order: Column,
              frac: float = 0.75, method: str = "method") -> DataFrame:
    """Keys that pass the vote; the denominator is the number of methods with any result in the group."""
    voters = df.groupBy(*by).agg(F.count_distinct(method).alias("n_methods"))
    sign = F.when(F.abs(F.col(col)) > thr, F.signum(F.col(col)).cast("int"))
    joined = join_groups(df, settle(voters, "voters"), by)
    votes = joined.groupBy(*by, key).agg(vote(sign, order, F.max("n_methods"), frac).alias("keep"))
    return votes.filter("keep").drop("keep")


def consensus(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Median over the reference methods (at most a handful of rows per key), 0 when none has a value."""
    return df.groupBy(*by).agg(F.coalesce(F.median(to_double(F.col(col))), F.lit(0.0)).alias(col))


def profile_similarity(counts: DataFrame, pairs=PROFILE_PAIRS) -> DataFrame:
    """Pearson, Spearman, cosine and Jensen-Shannon divergence of mode pairs per sample.

    The vectors run over the project's gene universe.  Genes absent from both
    modes are never materialised: the ``z`` of them enter the sums in closed
    form.  A window covers one sample's genes, bounded by the gene catalogue.
    """
    modes = sorted({m for p in pairs for m in p})
    universe = (counts.select("project", "gene").distinct().groupBy("project")
                .agg(F.count(F.lit(1)).alias("n")))
    wide = counts.groupBy("project", "srr", "gene").agg(*[
        F.coalesce(F.max(F.when(F.col("mode") == m, F.col("count"))), F.lit(0)).alias(m) for m in modes])
    long = wide.select("project", "srr", F.explode(F.array(*[
        F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(a).cast("double").alias("x"),
                 F.col(b).cast("double").alias("y")) for a, b in pairs])).alias("e")).select("project", "srr", "e.*")
    long = long.filter((F.col("x") > 0) | (F.col("y") > 0))
    long = join_groups(long, settle(universe, "universe"), ["project"])
    group = Window.partitionBy("project", "srr", "pair")
    ranked = long.withColumns({
        "z": F.col("n") - F.count(F.lit(1)).over(group),
        "tx": F.sum("x").over(group), "ty": F.sum("y").over(group)})
    for v in ("x", "y"):
        ordered = group.orderBy(v)
        ties = F.count(F.lit(1)).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
        place = F.rank().over(ordered) + (ties - 1) / F.lit(2.0)
        ranked = ranked.withColumn(f"_t{v}", place)
    mu = (F.col("n") + 1) / F.lit(2.0)
    zeros = {v: F.sum(F.when(F.col(v) == 0, 1).otherwise(0)).over(group) for v in ("x", "y")}
    ranked = ranked.withColumns({f"z{v}": (zeros[v] + F.col("z") + 1) / F.lit(2.0) - mu for v in ("x", "y")})
    ranked = ranked.withColumns({
        f"r{v}": F.when(F.col(v) > 0, F.col(f"_t{v}") + F.col("z") - mu).otherwise(F.col(f"z{v}")) for v in ("x", "y")})
    p, q = F.try_divide("x", "tx"), F.try_divide("y", "ty")
    m = (p + q) / F.lit(2.0)
    kl = [F.when(s > 0, s * F.ln(s / m)).otherwise(F.lit(0.0)) for s in (p, q)]
    n, z = F.max("n"), F.max("z")
    sx, sy, sxy = F.sum("x"), F.sum("y"), F.sum(F.col("x") * F.col("y"))
    sxx, syy = F.sum(F.col("x") * F.col("x")), F.sum(F.col("y") * F.col("y"))
    rank_dot = {(a, b): F.sum(F.col(f"r{a}") * F.col(f"r{b}")) + z * F.max(f"z{a}") * F.max(f"z{b}")
                for a, b in (("x", "y"), ("x", "x"), ("y", "y"))}
    both = (F.max("tx") > 0) & (F.max("ty") > 0)
    return ranked.groupBy("project", "srr", "pair").agg(
        F.when(both, F.try_divide(sxy - sx * sy / n, F.sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)))).alias("pear"),
        F.when(both, F.try_divide(rank_dot["x", "y"], F.sqrt(rank_dot["x", "x"] * rank_dot["y", "y"]))).alias("spear"),
        F.when(both, F.try_divide(sxy, F.sqrt(sxx * syy))).alias("cos"),
        F.when(both, (F.sum(kl[0]) + F.sum(kl[1])) / F.lit(2.0)).alias("jsd"))


def binned_trend(df: DataFrame, x: str, y: str, by: list[str], width: float = 1.0, expand: bool = True) -> DataFrame:
    """Median of ``y`` per (group, bin of ``x``), bins right-closed, empty bins kept.

    Edges run from floor(min) to ceil(max); the minimum belongs to the first bin, whose lower edge sits 0.001 further
    down.  Empty bins are found as gaps between occupied ones.  With ``expand`` each becomes a row; without, a run of
    them is one row from ``bin`` to ``last_bin``, so that a range may be as wide as bin numbers of 64 bits.
    """
    complete = settle(df.select(*by, x, y).dropna(), "trend")  # read three times below
    edges = settle(complete.agg(F.floor(F.min(x)).cast("double").alias("lo"),
                                F.ceil(F.max(x)).cast("double").alias("hi")), "edges")
    lo, hi = edges.select("lo").scalar(), edges.select("hi").scalar()
    number = lambda v: F.greatest(F.ceil((v - lo) / F.lit(width)), F.lit(1)).cast("long")
    medians = summarise(complete.withColumn("bin", number(F.col(x))), [*by, "bin"], {y: (y, 0.5)}, [F.count(F.lit(1)).alias("n")])
    start = complete.select(*by).distinct().select(*by, F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n"),
                                                   F.lit(None).cast("double").alias(y))
    known = following(medians.unionByName(start), by, "bin", "_next")
    end = F.coalesce(F.col("_next"), number(hi) + 1) - 1
    empty = F.struct((F.col("bin") + 1).alias("bin"), end.alias("last_bin"), F.lit(0).cast("long").alias("n"),
                     F.lit(None).cast("double").alias(y))
    known = known.withColumn("_e", F.explode(F.array(F.struct("bin", F.col("bin").alias("last_bin"), "n", y), empty)))
    runs = known.select(*by, "_e.*").filter("bin > 0 and bin <= last_bin")
    if expand:
        runs = runs.withColumn("bin", F.explode(F.sequence("bin", "last_bin"))).withColumn("last_bin", F.col("bin"))
    middle = lo + F.lit(width) * ((F.col("bin") + F.col("last_bin")) / F.lit(2.0) - F.lit(0.5))
    runs = runs.withColumn("mid", middle - F.when(F.col("bin") == 1, F.lit(0.0005)).otherwise(F.lit(0.0)))
    return runs.drop("last_bin") if expand else runs


def histogram(df: DataFrame, cols: list[str], n_edges: int = 30, pad: float = 0.5) -> DataFrame:
    """Counts of several columns over shared equal-width bins, last bin closed, empty bins kept."""
    low, high = [F.min(c) for c in cols], [F.max(c) for c in cols]
    ends = settle(df.agg((F.least(*low) if len(cols) > 1 else low[0]).alias("a"),
                         (F.greatest(*high) if len(cols) > 1 else high[0]).alias("b"))
                  .select((F.col("a") - pad).alias("lo"), (F.col("b") + pad).alias("hi")), "ends")
    lo = ends.select("lo").scalar()
    width = ends.select(((F.col("hi") - F.col("lo")) / F.lit(float(n_edges - 1))).alias("w")).scalar()
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).alias("_v")) for c in cols])).alias("e")).select("e.*").dropna()
    place = F.coalesce(F.floor(F.try_divide(F.col("_v") - lo, width)), F.lit(0))  # a constant column has bins of no width
    index = F.least(place, F.lit(n_edges - 2)).cast("int")
    counted = long.groupBy("variable", index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ends.select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("variable")).withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(n_edges - 2))))
    return (grid.join(counted, ["variable", "bin"], "left")
            .select("variable", "bin", (lo + width * F.col("bin")).alias("edge"),
                    F.coalesce("n", F.lit(0).cast("long")).alias("n")))


def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = 8) -> DataFrame:
    """Mutual information (nats) of each quantile-binned feature with a discrete label, best first.

    A value's bin is the number of interior quantile edges below it, so equal
    values share a bin and no row-level ordering is needed.
    """
    complete = df.select(*features, label).dropna()
    long = settle(complete.select(F.col(label).alias("label"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("e")).select(
        "label", "e.*"), "features")
    names = [f"e{i}" for i in range(1, bins)]
    edges = summarise(long, ["feature"], {n: ("v", i / bins) for i, n in enumerate(names, 1)})
    edges = settle(edges.select("feature", F.array(*names).alias("edges")), "edges")
    index = F.size(F.filter("edges", lambda e: F.col("v") > e)).alias("bin")
    joint = join_groups(long, edges, ["feature"]).groupBy("feature", index, "label").agg(F.count(F.lit(1)).alias("n"))
    # At most features x bins x labels rows from here on.
    w = lambda *c: F.sum("n").over(Window.partitionBy(*c))
    term = F.col("n") / w("feature") * F.ln(F.col("n") * w("feature") / (w("feature", "bin") * w("feature", "label")))
    return (joint.withColumn("t", term).groupBy("feature").agg(F.sum("t").alias("mutual_information"))
            .orderBy(F.desc("mutual_information"), "feature"))


def digamma(n: Column) -> Column:
    """Digamma of a positive number, by recurrence to beyond 6 and its asymptotic series."""
    x, one = n.cast("double"), F.lit(1.0)
    far = one / ((x + 6.0) * (x + 6.0))
    series = F.ln(x + 6.0) - one / (2.0 * (x + 6.0)) - far * (1 / 12 - far * (1 / 120 - far / 252))
    return series - sum((one / (x + float(i)) for i in range(6)), F.lit(0.0))


def nearest_information(df: DataFrame, features: list[str], label: str, k: int = 3) -> DataFrame:
    """Mutual information (nats) of each feature with a discrete label from nearest neighbours, best first.

    A point's radius is the distance to its k-th nearest other point of the same label (its last one, if there are fewer),
    and m counts the points of any label, its own included, that are nearer than that, or equal where the radius is 0.  Then MI is
    psi(N) + mean psi(k) - mean psi(points of the label) - mean psi(m), 0 at least; a label's only point takes no part.
    Rows with a null among the columns are left out.

    Equal points are one row with a count.  Ranks come from range-partitioned pieces, neighbours are looked up by rank and
    counts within the radius by the rank of its ends, so no label and no value is ever in one task.
    """
    complete = df.select(*features, label).dropna()
    long = complete.select(F.col(label).alias("label"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("e")).select("label", "e.*")
    points = long.groupBy("feature", "label", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = settle(cumulate(points, ["feature", "label"], ["v"]).filter("total > 1").select(
        "feature", "label", "v", "n", "below", "total", F.least(F.lit(k), F.col("total") - 1).alias("k")), "placed")
    # the first and last k ranks of every value are all that a neighbour can ask for
    edge = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.lit(k)) - 1),
                                     F.sequence(F.greatest(F.col("n") - k, F.lit(0).cast("long")), F.col("n") - 1)))
    ranked = placed.select("feature", "label", F.col("v").alias("_w"), "below", F.explode(edge).alias("_i")).select(
        "feature", "label", "_w", (F.col("below") + F.col("_i")).alias("rank"))
    steps = F.sequence(F.lit(1), F.lit(k))
    wanted = F.concat(F.transform(steps, lambda d: F.col("below") - d), F.transform(steps, lambda d: F.col("below") + F.col("n") - 1 + d))
    asked = placed.filter("n <= k").withColumn("rank", F.explode(wanted))
    far = asked.join(ranked, ["feature", "label", "rank"]).groupBy("feature", "label", "v").agg(
        F.sort_array(F.collect_list(F.abs(F.col("v") - F.col("_w")))).alias("_far"))
    radius = F.when(F.col("n") > F.col("k"), F.lit(0.0)).otherwise(F.get("_far", (F.col("k") - F.col("n")).cast("int")))
    around = settle(placed.join(far, ["feature", "label", "v"], "left").withColumn("r", radius).select(
        "feature", "label", "v", "n", "total", "k", (F.col("v") - F.col("r")).alias("low"), (F.col("v") + F.col("r")).alias("high"), "r"), "radii")
    ends = around.select("feature", F.explode(F.array("low", "high")).alias("v"), F.lit(0).cast("long").alias("n"))
    values = placed.select("feature", "v", "n").unionByName(ends).groupBy("feature", "v").agg(F.sum("n").alias("n"))
    ranks = settle(cumulate(values, ["feature"], ["v"]).select("feature", F.col("v").alias("_at"), "below", (F.col("below") + F.col("n")).alias("upto")), "ranks")
    low = ranks.select("feature", F.col("_at").alias("low"), F.col("below").alias("_low_lt"), F.col("upto").alias("_low_le"))
    high = ranks.select("feature", F.col("_at").alias("high"), F.col("below").alias("_high_lt"), F.col("upto").alias("_high_le"))
    counted = around.join(low, ["feature", "low"]).join(high, ["feature", "high"])
    m = F.when(F.col("r") > 0, F.col("_high_lt") - F.col("_low_le")).otherwise(F.col("_high_le") - F.col("_low_lt"))
    n = F.sum("n")
    mean = lambda c: F.sum(F.col("n") * digamma(c)) / n
    found = counted.withColumn("m", m).groupBy("feature").agg(
        (digamma(n) + mean(F.col("k")) - mean(F.col("total")) - mean(F.col("m"))).alias("_mi"))
    return found.select("feature", F.greatest(F.lit(0.0), F.col("_mi")).alias("mutual_information")).orderBy(
        F.desc("mutual_information"), "feature")

"""Gene counts: universe, eligibility, size factors and the two-group count test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import erfc
from ..runtime import join_groups, settle
from ..schemas import BASELINE, METHODS, MIN_PER_CONDITION, MIN_SAMPLES
from .cleaning import neutral_fill
from .ordering import bh_adjust

LEAST_DISPERSION = 1e-8


def gene_universe(counts: DataFrame) -> DataFrame:
    """Distinct genes over each project's untrimmed files."""
    return counts.filter(F.col("mode") == BASELINE).select("project", "gene").distinct()


def eligibility(samples: DataFrame) -> DataFrame:
    """Samples, conditions and smallest condition per project, and whether it can be analysed."""
    per = samples.groupBy("project", "condition").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("project").agg(F.sum("n").alias("n_samples"), F.count(F.lit(1)).alias("n_conditions"),
                                     F.min("n").alias("min_per_condition"))
    return out.withColumn("eligible", (F.col("n_samples") >= MIN_SAMPLES) & (F.col("n_conditions") >= 2))


def leave_one_out(samples: DataFrame, min_per_condition: int = MIN_PER_CONDITION) -> DataFrame:
    """What remains of each sample's project without it, by subtraction instead of a self-join.

    ``leave`` is false where removing the sample would leave a remaining
    condition under the minimum: then nothing is removed.  A condition that
    vanishes altogether does not count.
    """
    per = samples.groupBy("project", "condition").agg(F.count(F.lit(1)).alias("n"))
    small = (F.col("n") < min_per_condition).cast("long")
    project = Window.partitionBy("project")  # one row per condition
    per = settle(per.select("project", "condition", "n", F.sum("n").over(project).alias("n_all"),
                            (F.sum(small).over(project) - small).alias("small_others")), "conditions")
    rest = F.col("n") - 1
    leave = (F.col("small_others") == 0) & ((rest == 0) | (rest >= min_per_condition))
    gone = F.when(leave, 1).otherwise(0)
    return join_groups(samples, per, ["project", "condition"]).select(
        "project", "srr", "condition", leave.alias("leave"),
        (F.col("n") - gone).alias("n_same"), (F.col("n_all") - F.col("n")).alias("n_other"))


def candidate_samples(samples: DataFrame, files: DataFrame, methods=METHODS) -> DataFrame:
    """Make-up of each candidate matrix: the untrimmed rest plus the target under one method.

    ``files`` lists (project, srr, mode) that exist.
    """
    own = files.filter(F.col("mode").isin(list(methods))).select("project", "srr", F.col("mode").alias("method"))
    base = files.filter(F.col("mode") == BASELINE).select("project", "srr")
    loo = leave_one_out(samples.join(base, ["project", "srr"]))
    return loo.join(own, ["project", "srr"]).select(
        "project", "srr", "method", "condition", (F.col("n_same") + 1).alias("n_same"), "n_other",
        (F.col("n_other") > 0).alias("valid"))


def library_factors(counts: DataFrame, by: list[str], depth_mode: str | None = None) -> DataFrame:
    """Library-size factors: total over the group's mean total.

    With ``depth_mode`` the mean is taken over that mode only (``by`` must then
    be ["project"]), which puts every mode of a project on one scale.
    """
    keys = [*by, "srr", "mode"] if depth_mode else [*by, "srr"]
    totals = settle(counts.groupBy(*keys).agg(F.sum("count").cast("double").alias("total")), "totals")
    counted = totals.filter(F.col("mode") == depth_mode) if depth_mode else totals
    means = settle(counted.groupBy(*by).agg(F.avg("total").alias("_mean")), "means")
    return join_groups(totals, means, by).withColumn("size_factor", F.try_divide("total", "_mean")).drop("total", "_mean")


def size_factors(counts: DataFrame, by: list[str], how: str = "median_ratio") -> DataFrame:
    """Size factor per (by, srr): median ratio to the geometric mean, or library size.

    ``median_ratio`` uses genes positive in every sample of the group and falls
    back to library size where a group has none.
    """
    library = library_factors(counts, by)
    if how == "library":
        return library
    n_samples = settle(library.groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples")), "n_samples")
    positive = counts.filter(F.col("count") > 0)
    means = positive.groupBy(*by, "gene").agg(F.avg(F.ln("count")).alias("g"), F.count(F.lit(1)).alias("n"))
    means = join_groups(means, n_samples, by).filter(F.col("n") == F.col("n_samples")).select(*by, "gene", "g")
    # A median spans one sample's genes: bounded by the gene catalogue.
    ratio = (positive.join(means, [*by, "gene"]).groupBy(*by, "srr")
             .agg(F.exp(F.median(F.ln("count") - F.col("g"))).alias("ratio")))
    return library.join(ratio, [*by, "srr"], "left").select(
        *by, "srr", F.coalesce("ratio", "size_factor").alias("size_factor"))


def wald(df: DataFrame) -> DataFrame:
    """Moment-based negative-binomial Wald test: adds log2fc, stat and pvalue, drops its inputs.

    Per condition c (0 reference, 1 contrasted) the input holds n_c samples,
    r_c sum of 1/size factor, s_c sum of scaled counts and q_c sum of their
    squares.  Steps are separate projections so that no term is expanded twice.
    """
    return tested(dispersions(df))


def dispersions(df: DataFrame) -> DataFrame:
    """Adds the means m, m0, m1, the mean r of the inverse size factors and the dispersion alpha of every gene."""
    zero = F.lit(0.0)
    c = F.col
    out = df.withColumns({"m0": c("s0") / c("n0"), "m1": c("s1") / c("n1")})
    out = out.withColumns({
        "w": F.try_divide(F.greatest(c("q0") - c("n0") * c("m0") * c("m0"), zero)
                          + F.greatest(c("q1") - c("n1") * c("m1") * c("m1"), zero), c("n0") + c("n1") - F.lit(2.0)),
        "m": (c("s0") + c("s1")) / (c("n0") + c("n1")), "r": (c("r0") + c("r1")) / (c("n0") + c("n1"))})
    # A single sample has no deviation from its own mean, so its square sum contributes nothing to w.
    excess = F.try_divide(c("w") - c("m") * c("r"), c("m") * c("m"))
    return out.withColumn("alpha", F.greatest(F.coalesce(excess, zero), F.lit(LEAST_DISPERSION)))


def shrunken(df: DataFrame, by: list[str]) -> DataFrame:
    """``dispersions`` drawn towards their test's trend alpha(m) = a0 + a1 / m, both from sums over its genes.

    The trend is a least-squares fit over genes with an estimate above the least one; a test with fewer than three, or
    with equal means, has a flat trend.  On the log scale a gene's estimate has the sampling variance trigamma(df / 2)
    and the trend a prior variance of what the residuals have beyond it, a quarter at least.  The result is their
    weighted mean.  Genes without an estimate of their own take the trend; a test without any keeps its values.
    """
    c, one = F.col, F.lit(1.0)
    usable = (c("alpha") > LEAST_DISPERSION) & (c("m") > 0)
    x, y = F.when(usable, one / c("m")), F.when(usable, c("alpha"))
    sums = df.groupBy(*by).agg(F.count(x).cast("double").alias("_n"), F.sum(x).alias("_x"), F.sum(y).alias("_y"),
                               F.sum(x * x).alias("_xx"), F.sum(x * y).alias("_xy"))
    spread = c("_n") * c("_xx") - c("_x") * c("_x")
    slope = F.when((c("_n") > 2) & (spread > 1e-12 * c("_n") * c("_xx")), (c("_n") * c("_xy") - c("_x") * c("_y")) / spread).otherwise(0.0)
    lines = settle(sums.withColumn("_a1", slope).select(*by, F.try_divide(c("_y") - c("_a1") * c("_x"), c("_n")).alias("_a0"), "_a1"), "trends")
    trend = F.greatest(c("_a0") + F.coalesce(c("_a1") / F.nullif(c("m"), F.lit(0.0)), F.lit(0.0)), F.lit(LEAST_DISPERSION))
    out = settle(join_groups(df, lines, by).withColumn("_trend", trend).drop("_a0", "_a1"), "trended")
    half = (c("n0") + c("n1") - 2.0) / 2.0
    # trigamma by recurrence to beyond 6 and its asymptotic series
    far = half + 6.0
    sampling = sum((one / ((half + float(i)) * (half + float(i))) for i in range(6)), F.lit(0.0)) + one / far + one / (2.0 * far * far) \
        + one / (6.0 * far * far * far) - one / (30.0 * far * far * far * far * far)
    out = out.withColumn("_noise", F.when(half > 0, sampling))
    residual = F.when(usable, F.ln("alpha") - F.ln("_trend"))
    wide = settle(out.groupBy(*by).agg(F.var_pop(residual).alias("_spread")), "spreads")
    prior = F.greatest(F.coalesce(c("_spread") - c("_noise"), F.lit(0.0)), F.lit(0.25))
    weight = F.when(usable, prior / (prior + F.coalesce("_noise", F.lit(0.0)))).otherwise(0.0)
    drawn = F.exp(weight * F.ln("alpha") + (one - weight) * F.ln("_trend"))
    return join_groups(out, wide, by).withColumn("alpha", F.coalesce(drawn, c("alpha"))).drop("_trend", "_noise", "_spread")


def tested(df: DataFrame) -> DataFrame:
    """log2fc, stat and pvalue from ``dispersions``, whose columns are dropped."""
    half, c = F.lit(0.5), F.col
    out = df.withColumns({f"v{i}": (c(f"m{i}") * (c(f"r{i}") / c(f"n{i}")) + c("alpha") * c(f"m{i}") * c(f"m{i}"))
                           / c(f"n{i}") / ((c(f"m{i}") + half) * (c(f"m{i}") + half)) for i in (0, 1)})
    out = out.withColumn("beta", F.when(c("m") > 0, F.ln((c("m1") + half) / (c("m0") + half))))
    out = out.withColumn("stat", F.try_divide("beta", F.sqrt(c("v0") + c("v1"))))
    out = out.withColumn("z", F.abs("stat") / F.sqrt(F.lit(2.0)))
    inner = ["n0", "n1", "r0", "r1", "s0", "s1", "q0", "q1", "m0", "m1", "w", "m", "r", "alpha", "v0", "v1"]
    out = out.withColumns({"log2fc": c("beta") / F.ln(F.lit(2.0)), "u": F.lit(1.0) / (F.lit(1.0) + c("z") / F.lit(2.0))})
    return out.withColumn("pvalue", erfc(c("z"), c("u"))).drop(*inner, "beta", "z", "u")


def contrast_levels(samples: DataFrame, by: list[str]) -> DataFrame:
    """Reference and contrasted condition per group: control and treatment, else the first two by name."""
    names = samples.select(*by, "condition").filter(F.col("condition").isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy(*by).orderBy("condition"))
    labels = names.withColumn("_place", place).groupBy(*by).agg(
        F.max(F.when(F.col("_place") == 1, F.col("condition"))).alias("_first"),
        F.max(F.when(F.col("_place") == 2, F.col("condition"))).alias("_second"),
        (F.max(F.col("condition") == "control") & F.max(F.col("condition") == "treatment")).alias("_usual"))
    return labels.filter(F.col("_second").isNotNull()).select(
        *by, F.when(F.col("_usual"), F.lit("control")).otherwise(F.col("_first")).alias("level0"),
        F.when(F.col("_usual"), F.lit("treatment")).otherwise(F.col("_second")).alias("level1"))


def with_role(samples: DataFrame, by: list[str]) -> DataFrame:
    """Add role 0 or 1 to each sample of the contrast; other conditions drop out."""
    levels = settle(contrast_levels(samples, by), "levels")
    role = F.when(F.col("condition") == F.col("level0"), 0).when(F.col("condition") == F.col("level1"), 1)
    return (join_groups(samples, levels, by).withColumn("role", role)
            .filter(F.col("role").isNotNull()).drop("level0", "level1"))


def diff_test(counts: DataFrame, samples: DataFrame, by: list[str], how: str = "library", shrink: bool = False) -> DataFrame:
    """Two-group test per (by, gene): log2fc, stat, pvalue, padj; ``shrink`` draws dispersions to their trend.

    ``counts`` is long (by, srr, gene, count); absent cells are zeros and only
    enter through the sample numbers.  Groups with one condition give nothing.
    A sample without any count has no size factor and is left out.
    """
    factors = size_factors(counts, by, how).filter(F.col("size_factor") > 0)
    design = settle(with_role(samples.join(factors, [*by, "srr"]), by), "design")
    is0, is1 = F.col("role") == 0, F.col("role") == 1
    inverse = F.lit(1.0) / F.col("size_factor")
    groups = settle(design.groupBy(*by).agg(
        F.count_if(is0).cast("double").alias("n0"), F.count_if(is1).cast("double").alias("n1"),
        F.sum(F.when(is0, inverse)).alias("r0"), F.sum(F.when(is1, inverse)).alias("r1"))
                    .filter((F.col("n0") > 0) & (F.col("n1") > 0)), "groups")
    q = F.col("count") / F.col("size_factor")
    scaled = counts.join(design.select(*by, "srr", "role", "size_factor"), [*by, "srr"]).withColumn("q", q)
    zero = F.lit(0.0)
    sums = scaled.groupBy(*by, "gene").agg(*[
        F.coalesce(F.sum(F.when(F.col("role") == r, v)), zero).alias(f"{k}{r}")
        for r in (0, 1) for k, v in (("s", F.col("q")), ("q", F.col("q") * F.col("q")))])
    found = dispersions(join_groups(sums, groups, by))
    fit = tested(shrunken(settle(found, "dispersions"), by) if shrink else found)
    return neutral_fill(bh_adjust(fit.withColumn("pvalue", F.coalesce("pvalue", F.lit(1.0))), by, "pvalue",
                                  bounded=True))

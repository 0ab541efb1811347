"""Aggregations behind the published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sample_id
from ..runtime import join_groups, settle
from ..schemas import METHODS, TRIMMED_METHODS, method_order, methods
from .collections import to_long
from .ordering import summarise


def sizes(df: DataFrame, by: list[str], distinct: list[str]) -> DataFrame:
    """Rows and distinct values per group (or overall)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"),
                               *[F.count_distinct(c).alias(f"n_{c}") for c in distinct])


def status_counts(df: DataFrame) -> DataFrame:
    """Rows per (status, run_status), unknown values left out, most frequent first."""
    return (df.dropna(subset=["status", "run_status"]).groupBy("status", "run_status")
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "status", "run_status"))


def status_totals(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    # The queue's status labels.
    states = ("done", "todo", "submitted", "abandoned")
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in states])


def stage_summary(df: DataFrame) -> DataFrame:
    """Records and cost quartiles per (category, mode); no mode is a mode of its own."""
    out = summarise(df, ["category", "mode"], {
        "median_core_hours_per_gb": ("core_hours_per_gb", 0.5),
        "q1_core_hours_per_gb": ("core_hours_per_gb", 0.25),
        "q3_core_hours_per_gb": ("core_hours_per_gb", 0.75),
        "median_mb_per_sec": ("mb_per_sec", 0.5)}, [F.count(F.lit(1)).alias("n_records")])
    return out.orderBy("category", F.col("mode").asc_nulls_last())


def paired_medians(df: DataFrame, index: str, key: str, value: str, a: str, b: str) -> DataFrame:
    """Per index: median value under ``a`` and under ``b``, and their ratio; both must exist."""
    cases = df.filter(F.col(key).isin(a, b)).select(
        index, *[F.when(F.col(key) == k, F.col(value)).alias(f"_{k}") for k in (a, b)])
    out = summarise(cases, [index], {a: (f"_{a}", 0.5), b: (f"_{b}", 0.5)})
    return out.dropna(subset=[a, b]).withColumn("ratio", F.try_divide(a, b))


def paired_ratio(df: DataFrame, index: str, key: str, value: str, a: str, b: str) -> DataFrame:
    """How many pairs exist, and the median and mean of their ratio."""
    pairs = settle(paired_medians(df, index, key, value, a, b), "pairs")
    return summarise(pairs, [], {"median_ratio": ("ratio", 0.5)},
                     [F.count(F.lit(1)).alias("n_pairs"), F.avg("ratio").alias("mean_ratio")])


def endpoint_summary(df: DataFrame) -> DataFrame:
    """Attempts, outcomes and median speed per download endpoint."""
    return summarise(df, ["endpoint"], {"median_mb_per_sec": ("mb_per_sec", 0.5)}, [
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("status") == "success").alias("successes"),
        F.count_if(F.col("status") == "failed").alias("failed")]).orderBy("endpoint")


def mean_by(df: DataFrame, by: list[str], col: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(col).alias(col))


def quality_summary(df: DataFrame) -> DataFrame:
    return summarise(df, [], {"median_Q_mean": ("Q_mean", 0.5), "median_terminal_q_mean": ("terminal_q_mean", 0.5)}, [
        F.count(F.lit(1)).alias("n_samples"), F.min("Q_mean").alias("min_Q_mean"),
        F.min("terminal_q_mean").alias("min_terminal_q_mean")])


def describe_long(df: DataFrame, cols: dict[str, tuple[str, str]]) -> DataFrame:
    """Mean, sample deviation, median, range and count of each column, labelled (method, measure)."""
    long = to_long(df, [], {c: f"{m}|{k}" for c, (m, k) in cols.items()}, "_label").filter(F.col("value").isNotNull())
    parts = F.split("_label", r"\|")
    long = long.select(parts[0].alias("method"), parts[1].alias("measure"), "value")
    return summarise(long, ["method", "measure"], {"median": ("value", 0.5)}, [
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.count("value").alias("n")])


def read_survival(df: DataFrame) -> DataFrame:
    """Samples, paired-end rows and surviving percentage per trimming mode."""
    rows = settle(df.dropna(subset=["mode"]), "survival")
    out = summarise(rows, ["mode"], {"median_surviving_pct": ("surviving_pct", 0.5)}, [
        F.count_if(F.col("layout") == "PE").alias("paired_srrs"), F.avg("surviving_pct").alias("mean_surviving_pct")])
    # Counted apart: in one aggregate every (mode, sample) pair would carry a value map.
    distinct = rows.groupBy("mode").agg(F.count_distinct("SRR_ID").alias("srrs"))
    return out.join(distinct, "mode").orderBy("mode")


def _by_method(df: DataFrame, medians: list[str], minima: list[str]) -> DataFrame:
    found = summarise(df, ["method"], {f"median_{c}": (c, 0.5) for c in medians},
                      [F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"min_{c}") for c in minima]])
    return (methods(df.sparkSession).join(found, "method", "left")
            .withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).orderBy("ord"))


def gene_summary(df: DataFrame) -> DataFrame:
    """Gene-level agreement per method in method order; a method without rows shows n = 0."""
    return _by_method(df, ["rho_gene", "jaccard_deg"], ["rho_gene", "jaccard_deg"])


def pathway_summary(df: DataFrame) -> DataFrame:
    """Pathway-level agreement per method in method order."""
    return _by_method(df, ["rho_pathway", "jaccard_pathway", "dir_concordance"], [])


# The three calls a method can receive.
CALLS = ("helpful", "neutral", "harmful")


def call_summary(df: DataFrame, names=TRIMMED_METHODS) -> DataFrame:
    """Helpful, neutral and harmful calls per method; a call nobody received is 0."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(f"{m}_class").alias("call")) for m in names])).alias("e")).select("e.*")
    return (long.groupBy("method").agg(*[F.count_if(F.col("call") == c).alias(c) for c in CALLS])
            .orderBy(method_order(F.col("method"))))


def outlier_projects(df: DataFrame) -> DataFrame:
    """Samples per project whose preferred method is not U."""
    return (df.filter(~F.col("t_star").eqNullSafe(F.lit("U"))).dropna(subset=["project_id"])
            .groupBy("project_id").agg(F.count(F.lit(1)).alias("n_outliers"))
            .orderBy(F.desc("n_outliers"), "project_id"))


def classification_headline(df: DataFrame) -> DataFrame:
    """Totals by preference and the outliers' median gain and read loss.

    Input: one row per sample with t_star, preferred_delta_path and
    preferred_read_loss_pct (both null for samples that prefer U).
    """
    prefers_u = F.col("t_star").eqNullSafe(F.lit("U"))
    return summarise(df, [], {"median_outlier_pathway_delta": ("preferred_delta_path", 0.5),
                              "median_outlier_read_loss_pct": ("preferred_read_loss_pct", 0.5)}, [
        F.count(F.lit(1)).alias("total_samples"), F.count_if(prefers_u).alias("samples_preferring_untrimmed"),
        F.count_if(~prefers_u).alias("samples_preferring_trimmed")])


def class_counts_wide(df: DataFrame, names=TRIMMED_METHODS) -> DataFrame:
    """Per project: samples and the count of every (method, call) pair."""
    cells = [F.count_if(F.col(f"{m}_class") == c).alias(f"{m}_{c}") for m in names for c in CALLS]
    return df.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_srrs"), *cells)


def accuracy(df: DataFrame, truth: str, pred: str, baseline: str = "U") -> DataFrame:
    """Rows, share predicted right and share right when always predicting ``baseline``."""
    hit = (F.col(truth).eqNullSafe(F.col(pred))).cast("double")
    base = (F.col(truth).eqNullSafe(F.lit(baseline))).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(base).alias("baseline_accuracy"),
                  F.avg(hit).alias("model_accuracy"))


def confusion(df: DataFrame, truth: str, pred: str, labels=METHODS) -> DataFrame:
    """Rows per true label with a column per predicted label."""
    return (df.dropna(subset=[truth, pred]).groupBy(truth)
            .agg(*[F.count_if(F.col(pred) == m).alias(m) for m in labels]))


def pivot_stat(df: DataFrame, index: str, key: str, value: str, labels: list[str]) -> DataFrame:
    """Median and mean of ``value`` for every (index, key) cell, keys as columns."""
    cases = df.select(index, *[F.when(F.col(key) == k, F.col(value)).alias(f"_{k}") for k in labels])
    return summarise(cases, [index], {f"{k}_median": (f"_{k}", 0.5) for k in labels},
                     [F.avg(f"_{k}").alias(f"{k}_mean") for k in labels])


def _audited(paths: DataFrame, cohort: DataFrame) -> DataFrame:
    """Distinct (directory, project, sample) of file paths, with whether the project is in the cohort (``_in``)."""
    p = F.col("path")
    # Fixed pattern: <...>/flattened_<kind>/<project>/<anything>
    where = r"(?:^|/)(flattened_[^/]+)/([^/]+)/"
    keyed = paths.select(
        F.regexp_extract(p, where, 1).alias("flattened_dir"), F.regexp_extract(p, where, 2).alias("project"),
        sample_id(F.element_at(F.split(p, "/"), -1), p).alias("srr")
    ).filter(F.col("flattened_dir") != "").distinct()
    inside = settle(cohort.select("project").distinct().withColumn("_in", F.lit(True)), "inside")
    return join_groups(keyed, inside, ["project"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))


def directory_audit(paths: DataFrame, cohort: DataFrame) -> DataFrame:
    """Per flattened directory: projects and samples in total, inside and outside the cohort.

    ``paths`` holds one file path per row, ``cohort`` a project column.  The names of the projects outside are the
    table of ``outside_projects``.
    """
    pairs = _audited(paths, cohort).select("flattened_dir", "project", "srr", "_in").distinct()
    # every project and every sample once, with its membership on both sides
    kinds = F.explode(F.array(F.struct(F.lit("projects").alias("kind"), F.col("project").alias("id")),
                              F.struct(F.lit("unique_srrs").alias("kind"), F.col("srr").alias("id"))))
    each = pairs.select("flattened_dir", kinds.alias("_k"), "_in").filter("_k.id is not null").groupBy("flattened_dir", "_k.kind", "_k.id").agg(
        F.max("_in").alias("inside"), F.max(~F.col("_in")).alias("outside"))
    return each.groupBy("flattened_dir").agg(*[F.count_if((F.col("kind") == kind) & part).alias(f"{kind}_{name}") for kind, part, name in (
        (kind, part, name) for part, name in ((F.lit(True), "total"), (F.col("inside"), "in_cohort"), (F.col("outside"), "outside_cohort"))
        for kind in ("projects", "unique_srrs"))]).orderBy("flattened_dir")


def outside_projects(paths: DataFrame, cohort: DataFrame) -> DataFrame:
    """The projects of each flattened directory that are not in the cohort, one per row."""
    return _audited(paths, cohort).filter(~F.col("_in")).select("flattened_dir", "project").distinct()


def cohort_totals(df: DataFrame) -> DataFrame:
    """Sums and medians of the cohort table, by inclusion."""
    return summarise(df, ["included"], {"median_srrs": ("total_srrs", 0.5), "median_classes": ("total_classes", 0.5)}, [
        F.count(F.lit(1)).alias("projects"), F.sum("total_srrs").alias("srrs"),
        F.sum("eligible_srrs").alias("eligible")])


def value_counts(df: DataFrame, col: str, missing: str = "Unknown") -> DataFrame:
    return (df.select(F.coalesce(F.col(col), F.lit(missing)).alias(col)).groupBy(col)
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col))


def replicate_structure(meta: DataFrame) -> DataFrame:
    """Classes, replicated classes, inclusion and reason for exclusion per project.

    ``meta`` has one row per run with project and condition.  A project is
    included when at least two of its classes hold two or more runs.
    """
    classes = meta.groupBy("project", "condition").agg(F.count(F.lit(1)).alias("n"))
    out = classes.groupBy("project").agg(
        F.sum("n").alias("total_srrs"), F.count(F.lit(1)).alias("total_classes"),
        F.count_if(F.col("n") >= 2).alias("classes_with_replicates"),
        F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(F.lit(0))).alias("_eligible"))
    ok = F.col("classes_with_replicates") >= 2
    one, none = F.col("total_classes") == 1, F.col("classes_with_replicates") == 0
    reason = (F.when(ok, F.lit(None))
              .when(one & none, F.lit("Only 1 class exists, and it has no replicates"))
              .when(one, F.lit("Only 1 class exists (DESeq2 requires >= 2 to compare)"))
              .otherwise(F.format_string("Has %d classes, but only %d have replicates",
                                         "total_classes", "classes_with_replicates")))
    return out.select("project", "total_srrs", "total_classes", "classes_with_replicates",
                      F.when(ok, F.col("_eligible")).otherwise(F.lit(0).cast("long")).alias("eligible_srrs"),
                      F.when(ok, "Yes").otherwise("No").alias("included"), reason.alias("reason"))


def timing_check(timings: DataFrame) -> DataFrame:
    """Recorded mode and pipeline totals against the sums of their parts.

    ``timings`` has project, srr, stage and duration_sec as read by
    ``read_stage_timings``.
    """
    parsed = timings.select(
        "project", "srr", "duration_sec",
        F.regexp_extract("stage", r"^(?:trim|align|count)_(.+)$", 1).alias("part_mode"),
        F.regexp_extract("stage", r"^mode_(.+)_total$", 1).alias("total_mode"),
        (F.col("stage") == "pipeline_total").alias("is_pipeline"))
    mode = F.when(F.col("is_pipeline"), F.lit("pipeline")).otherwise(
        F.coalesce(F.nullif("part_mode", F.lit("")), F.nullif("total_mode", F.lit(""))))
    is_total = F.col("is_pipeline") | (F.col("total_mode") != "")
    cells = parsed.select("project", "srr", mode.alias("mode"), is_total.alias("is_total"), "duration_sec").filter(
        F.col("mode").isNotNull())
    per_mode = cells.groupBy("project", "srr", "mode").agg(
        F.sum(F.when(F.col("is_total"), F.col("duration_sec"))).alias("recorded"),
        F.sum(F.when(~F.col("is_total"), F.col("duration_sec"))).alias("summed"))
    whole = Window.partitionBy("project", "srr")
    modes_sum = F.sum(F.when(F.col("mode") != "pipeline", F.col("recorded"))).over(whole)
    out = per_mode.withColumn("summed", F.when(F.col("mode") == "pipeline", modes_sum).otherwise(F.col("summed")))
    return out.withColumn("agrees", F.col("recorded").eqNullSafe(F.col("summed")))


def stage_loss(stages: DataFrame) -> DataFrame:
    """Projects lost at each funnel stage; a funnel is a handful of rows, one per stage, by construction."""
    return stages.withColumn("loss", F.lag("projects").over(Window.orderBy("stage")) - F.col("projects"))


def box_stats(df: DataFrame, by: list[str], y: str) -> DataFrame:
    """Quartiles, whiskers at the last point within 1.5 IQR, and outliers per group."""
    keyed = settle(df.select(*by, F.col(y).alias("_y")).filter(F.col("_y").isNotNull()), "boxes")  # read three times
    quart = settle(summarise(keyed, by, {"q1": ("_y", 0.25), "median": ("_y", 0.5), "q3": ("_y", 0.75)}), "quartiles")
    fenced = join_groups(keyed, quart.select(*by, "q1", "median", "q3"), by)
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("_y") >= lo) & (F.col("_y") <= hi)
    return fenced.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max("q1").alias("q1"), F.max("median").alias("median"),
        F.max("q3").alias("q3"), F.min(F.when(inside, F.col("_y"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_y"))).alias("whisker_hi"), F.count_if(~inside).alias("outliers"))

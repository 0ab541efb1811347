"""Cohort funnel: from queried projects to the samples that were evaluated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.collections import funnel
from ..operators.summaries import stage_loss


def stage_row(df: DataFrame, stage: str, projects, samples) -> DataFrame:
    """One funnel row: the stage name and its project and sample numbers (aggregate expressions)."""
    return df.agg(projects.cast("long").alias("projects"), samples.cast("long").alias("samples")).select(
        F.lit(stage).alias("stage"), "projects", "samples")


def cohort_funnel(queried: DataFrame, filtered: DataFrame, queue: DataFrame, panel: DataFrame,
                  concordance: DataFrame) -> DataFrame:
    """Projects and samples at each selection stage, with the loss to the stage before.

    ``queried`` (project_id); ``filtered`` (project_id, n_files); ``queue``
    (project_id, srr_id); ``panel`` (project, total_srrs, eligible_srrs,
    included); ``concordance`` (project, SRR_ID).
    """
    included = F.col("included") == "Yes"
    return stage_loss(funnel([
        stage_row(queried, "1. query", F.count("project_id"), F.max(F.lit(None))),
        stage_row(filtered, "2. run-count filter", F.count(F.lit(1)), F.sum("n_files")),
        stage_row(queue, "3. queue", F.count_distinct("project_id"), F.count(F.lit(1))),
        stage_row(panel, "4. curated panel", F.count_distinct("project"), F.sum("total_srrs")),
        stage_row(panel.filter(included), "5. eligible", F.count(F.lit(1)), F.sum("eligible_srrs")),
        stage_row(concordance, "6. concordance", F.count_distinct("project"), F.count_distinct("SRR_ID")),
    ]))


def count_issues(filtered: DataFrame, queue: DataFrame, panel: DataFrame, concordance: DataFrame) -> DataFrame:
    """Places where two tables that should agree on a number do not: (issue, expected, found, difference)."""
    expected = filtered.agg(F.sum("n_runs").cast("long").alias("expected"))
    listed = filtered.agg(F.sum("n_files").cast("long").alias("v")).scalar()
    queued = queue.agg(F.count(F.lit(1)).alias("v")).scalar()
    eligible = panel.filter(F.col("included") == "Yes").agg(F.sum("eligible_srrs").cast("long").alias("expected"))
    used = concordance.agg(F.count_distinct("SRR_ID").alias("v")).scalar()
    rows = (expected.select(F.lit("runs queried against id files").alias("issue"), "expected", listed.alias("found"))
            .unionByName(expected.select(F.lit("runs queried against queue").alias("issue"), "expected",
                                         queued.alias("found")))
            .unionByName(eligible.select(F.lit("eligible against evaluated samples").alias("issue"), "expected",
                                         used.alias("found"))))
    return rows.withColumn("difference", F.col("expected") - F.col("found"))

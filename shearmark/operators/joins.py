"""Equi-joins, lookups and reconciliations; Spark picks the physical join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import dealt, grid_join, join_groups, settle


def left_join(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left")


def lookup_diff(df: DataFrame, counts: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """Rows whose ``a`` differs from the looked-up ``b``; a failed lookup differs."""
    return (df.join(counts, on, "left").withColumn("diff", F.col(a) - F.col(b))
            .filter(~F.col("diff").eqNullSafe(F.lit(0))))


def lookup_last(df: DataFrame, other: DataFrame, on: list[str], value: str, order: str) -> DataFrame:
    """Attach ``value`` of the last row (by ``order``) that ``other`` holds for the key.

    Keys are dealt before they are grouped: most have few rows, and a map-side table would hold nearly all of them.
    """
    df = settle(df, "looked_up")
    rows = df.count()
    last = dealt(other.select(*on, value, order), on, rows).groupBy(*on).agg(F.max_by(value, order).alias(value))
    return dealt(df, on, rows).join(last, on, "left")


def preferred_survival(outliers: DataFrame, trim: DataFrame, order: str) -> DataFrame:
    """Surviving percentage under each row's preferred method, 100 when that is U."""
    found = lookup_last(outliers, trim, ["SRR_ID", "mode"], "surviving_pct", order)
    return found.withColumn("preferred_surviving_pct", F.when(F.col("t_star") == "U", F.lit(100.0))
                            .otherwise(F.col("surviving_pct"))).drop("surviving_pct")


def common(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "inner")


def missing_from(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def cohort_split(df: DataFrame, cohort: DataFrame, on: list[str]) -> DataFrame:
    """Flag each row by membership of its key in the cohort; one project may hold much of the rows."""
    flag = settle(cohort.select(*on).distinct().withColumn("_in", F.lit(True)), "cohort")
    return join_groups(df, flag, on, "left").withColumn("in_cohort", F.coalesce("_in", F.lit(False))).drop("_in")


def reconcile(df: DataFrame, other: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """Keys whose two counts disagree, a missing right side counting as 0."""
    return (df.join(other, on, "left").withColumn(b, F.coalesce(F.col(b), F.lit(0)))
            .filter(F.col(a) != F.col(b)).withColumn("delta", F.col(a) - F.col(b)))


def dense_counts(counts: DataFrame, universe: DataFrame, samples: DataFrame) -> DataFrame:
    """Count of every universe gene in every sample of its project and mode, 0 where absent.

    The result is the dense matrix itself; the grid join lets many tasks build
    the cells of one large project.
    """
    cells = samples.select("project", "srr", "mode")
    grid = grid_join(universe, cells, ["project"], "gene", "srr")
    return (grid.join(counts, ["project", "srr", "mode", "gene"], "left")
            .withColumn("count", F.coalesce("count", F.lit(0).cast("long"))))


def dense_sums(counts: DataFrame, universe: DataFrame, samples: DataFrame) -> DataFrame:
    """Files, files with a count, total, mean and variance per (project, mode, gene), where absent cells count as zero.

    What ``dense_counts`` would add up, from the present cells alone: a zero adds to the number of files only.
    """
    n = F.col("n_files").cast("double")
    files = settle(samples.select("project", "srr", "mode").distinct().groupBy("project", "mode").agg(F.count(F.lit(1)).alias("n_files")), "files")
    present = counts.groupBy("project", "mode", "gene").agg(
        F.count_if(F.col("count") > 0).alias("n_positive"), F.sum("count").alias("total"),
        F.sum(F.col("count").cast("double") * F.col("count")).alias("_squares"))
    grid = join_groups(universe.select("project", "gene").distinct(), files, ["project"])
    out = grid.join(present, ["project", "mode", "gene"], "left").select(
        "project", "mode", "gene", "n_files", *[F.coalesce(c, F.lit(0).cast(kind)).alias(c) for c, kind in (
            ("n_positive", "long"), ("total", "long"), ("_squares", "double"))])
    spread = F.greatest(F.col("_squares") - F.col("total") * F.col("total") / n, F.lit(0.0))
    return out.withColumns({"mean": F.col("total") / n, "variance": F.try_divide(spread, n - F.lit(1.0))}).drop("_squares")

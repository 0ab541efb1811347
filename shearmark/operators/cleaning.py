"""Filters, coercions and derived columns (one projection each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import mode_name, to_double
from ..schemas import DEG_FDR, DEG_LOG2FC, TRIMMED_METHODS, method_order


def active_samples(df: DataFrame, project: str | None = None) -> DataFrame:
    """Annotation rows that are not excluded and belong to a positive group."""
    out = df.filter((F.col("exclude").isNull() | (F.col("exclude") == ""))
                    & (F.col("group").try_cast("int") > 0))
    return out.filter(F.col("BioProject") == project) if project else out


def coerce_double(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: to_double(F.col(c)) for c in cols})


def runs_between(df: DataFrame, lo: int = 10, hi: int = 50) -> DataFrame:
    """Projects with strictly more than ``lo`` and fewer than ``hi`` runs; input has project_id, srr_id."""
    n = df.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_runs"))
    return n.filter((F.col("n_runs") > lo) & (F.col("n_runs") < hi))


def cost_columns(df: DataFrame) -> DataFrame:
    """fastq_gb, core_hours and core_hours_per_gb from MB, seconds and cores."""
    return (df.withColumn("fastq_gb", F.col("fastq_mb") / F.lit(1024.0))
            .withColumn("core_hours", F.col("duration_sec") * F.col("cores_used") / F.lit(3600.0))
            .withColumn("core_hours_per_gb", F.try_divide("core_hours", "fastq_gb")))


def stage_label(df: DataFrame) -> DataFrame:
    mode = F.coalesce(F.col("mode"), F.lit(""))
    return df.withColumn("label", F.when(mode == "", F.col("category")).otherwise(
        F.concat_ws(":", "category", "mode")))


def keep_in(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.filter(F.col(col).isin(list(values)))


def keep_ne_or_null(df: DataFrame, col: str, value) -> DataFrame:
    """Rows whose value differs from ``value``; an unknown value differs."""
    return df.filter(~F.col(col).eqNullSafe(F.lit(value)))


def fill_terminal(df: DataFrame) -> DataFrame:
    """Missing terminal quality is the mean quality less the tail decay."""
    return df.withColumn("terminal_q_mean", F.coalesce(
        F.col("terminal_q_mean"), F.col("Q_mean") - F.col("tail_quality_decay")))


def transfer_rate(df: DataFrame) -> DataFrame:
    """duration_sec, mb_downloaded and mb_per_sec of each fetch attempt."""
    started, finished = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("started_at", "finished_at"))
    return (df.withColumn("duration_sec", (finished - started) / F.lit(1e6))
            .withColumn("mb_downloaded", to_double(F.col("bytes_downloaded")) / F.lit(1e6))
            .withColumn("mb_per_sec", F.try_divide("mb_downloaded", "duration_sec")))


def neutral_fill(df: DataFrame) -> DataFrame:
    """Untestable genes become neutral: effect and statistic 0, p-values 1."""
    neutral = {"log2fc": 0.0, "stat": 0.0, "pvalue": 1.0, "padj": 1.0}
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(v)), F.lit(v)) for c, v in neutral.items()})


def significant_genes(df: DataFrame, fdr: float = DEG_FDR, lfc: float = DEG_LOG2FC) -> DataFrame:
    return df.filter((F.col("padj") < fdr) & (F.abs("log2fc") > lfc))


def beyond(df: DataFrame, col: str, thr: float) -> DataFrame:
    return df.filter(F.abs(F.col(col)) > thr)


def with_method_order(df: DataFrame, col: str = "method") -> DataFrame:
    return df.withColumn("ord", method_order(F.col(col)))


def drop_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=cols)


def rename_mode(df: DataFrame) -> DataFrame:
    return df.withColumn("mode", mode_name(F.col("method")))


def pick_by_key(df: DataFrame, key: str, template: str, keys=TRIMMED_METHODS, out: str = "picked") -> DataFrame:
    """The value of the column ``template`` names for the row's own key; null for other keys."""
    value: Column = F.lit(None).cast("double")
    for k in keys:
        value = F.when(F.col(key) == k, F.col(template.format(k))).otherwise(value)
    return df.withColumn(out, value)


def benefit_label(df: DataFrame) -> DataFrame:
    """1 unless the preferred method is U; an unmatched (null) preference counts as 1."""
    return df.withColumn("benefits_from_trimming", (~F.col("t_star").eqNullSafe(F.lit("U"))).cast("int"))


def read_loss(df: DataFrame, col: str = "surviving_pct", out: str = "read_loss_pct") -> DataFrame:
    return df.withColumn(out, F.lit(100.0) - F.col(col))

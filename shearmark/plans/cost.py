"""Computational cost, download throughput and aligner speed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import coerce_double, cost_columns, keep_in, stage_label, transfer_rate
from ..operators.summaries import box_stats, endpoint_summary, paired_ratio, pivot_stat, stage_summary

# Measured columns and pipeline stages of the throughput table.
MEASURES = ("duration_sec", "cores_used", "total_reads_M", "read_length", "fastq_mb", "mb_per_sec",
            "mb_per_sec_per_core", "reads_per_sec")
STAGES = ("fastqc", "sra_conversion", "trim", "align", "count")


def throughput_table(raw: DataFrame) -> DataFrame:
    """Throughput rows with numeric measures and cost columns."""
    return cost_columns(coerce_double(raw, [c for c in MEASURES if c in raw.columns]))


def cost_summary(raw: DataFrame) -> DataFrame:
    return stage_summary(throughput_table(raw))


def alignment_ratio(raw: DataFrame) -> DataFrame:
    """Untrimmed over adapter-only alignment time of the samples that have both."""
    aligned = throughput_table(raw).filter(F.col("category") == "align")
    return paired_ratio(aligned, "SRR_ID", "mode", "duration_sec", "untrimmed", "adapter_only")


def stage_boxes(raw: DataFrame) -> DataFrame:
    """Box-plot statistics of core-hours per GB for every stage label."""
    return box_stats(stage_label(keep_in(throughput_table(raw), "category", list(STAGES))), ["label"],
                     "core_hours_per_gb")


def endpoints(attempts: DataFrame) -> DataFrame:
    return endpoint_summary(transfer_rate(attempts))


def aligner_speed(runs: DataFrame, aligners: list[str]) -> DataFrame:
    """Median and mean wall minutes per GB for each mode and aligner."""
    speed = runs.withColumn("wall_min_per_gb", F.try_divide(F.col("duration_sec") / F.lit(60.0), F.col("aligned_input_gb")))
    return pivot_stat(speed, "mode", "aligner", "wall_min_per_gb", aligners)

"""QC quality distribution and quality-sensitivity trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import fill_terminal
from ..operators.collections import to_long
from ..operators.joins import left_join
from ..operators.ordering import tail_mean
from ..operators.stats import binned_trend
from ..operators.summaries import mean_by

SAMPLE = ["project_id", "SRR_ID"]


def terminal_quality(positions: DataFrame, n: int = 10) -> DataFrame:
    """Mean of the last positions of each report, averaged over a sample's mate reports."""
    per_report = tail_mean(positions, [*SAMPLE, "report"], "pos", "mean_q", n, "terminal_q_mean")
    return mean_by(per_report, SAMPLE, "terminal_q_mean")


def quality_table(quality: DataFrame, terminal: DataFrame | None) -> DataFrame:
    """Per-sample quality with terminal quality, estimated where no report gave one."""
    if terminal is None:
        return fill_terminal(quality.withColumn("terminal_q_mean", F.lit(None).cast("double")))
    return fill_terminal(left_join(quality, terminal, SAMPLE))


def quality_sensitivity(quality: DataFrame, evaluation: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Median similarity per (method, terminal-quality bin); ``cols`` maps a wide column to its method."""
    long = to_long(evaluation, SAMPLE, cols, "method", "spearman")
    merged = left_join(long, quality.select(*SAMPLE, "terminal_q_mean", "Q_mean"), SAMPLE).dropna()
    return binned_trend(merged, "terminal_q_mean", "spearman", ["method"])

"""Per-sample trimming calls and the preferred method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import keep_ne_or_null, pick_by_key, read_loss
from ..operators.joins import preferred_survival
from ..functions.scalars import mode_name
from ..operators.summaries import classification_headline
from ..runtime import settle
from ..schemas import BASELINE, TRIMMED_METHODS


def classify_trimming(conc: DataFrame, eps: float = 0.05, metric: str = "rho_pathway") -> DataFrame:
    """Calls, deltas and preferred method of each sample, from its concordance rows.

    A method's delta is its pathway agreement less that of the untrimmed run;
    it is helpful above ``eps``, harmful below ``-eps``, neutral between, and
    unknown when either side is.  The preferred method is U unless a method is
    helpful; then it is the one of largest delta, earlier methods winning ties.
    """
    value = {m: F.max(F.when(F.col("method") == m, F.col(metric))) for m in (BASELINE, *TRIMMED_METHODS)}
    wide = conc.groupBy(F.col("project").alias("project_id"), "SRR_ID").agg(*[v.alias(f"_{m}") for m, v in value.items()])
    delta = {m: F.col(f"_{m}") - F.col(f"_{BASELINE}") for m in TRIMMED_METHODS}
    out = wide.select("project_id", "SRR_ID", *[d.alias(f"{m}_delta_path") for m, d in delta.items()])
    d = {m: F.col(f"{m}_delta_path") for m in TRIMMED_METHODS}
    out = out.withColumns({f"{m}_class": F.when(d[m] > eps, "helpful").when(d[m] < -eps, "harmful")
                           .when(d[m].isNotNull(), "neutral") for m in TRIMMED_METHODS})
    best = F.greatest(*d.values())
    choice = F.lit(BASELINE)
    for m in reversed(TRIMMED_METHODS):
        choice = F.when((d[m] > eps) & (d[m] == best), F.lit(m)).otherwise(choice)
    return out.withColumn("t_star", choice)


def outlier_table(cls: DataFrame, trim: DataFrame, order: str) -> DataFrame:
    """Samples that prefer trimming, with the gain and read loss of their preferred method."""
    outliers = keep_ne_or_null(cls, "t_star", BASELINE).withColumn("mode", mode_name(F.col("t_star")))
    picked = pick_by_key(outliers, "t_star", "{}_delta_path", out="preferred_delta_path")
    lost = read_loss(preferred_survival(picked, trim, order), "preferred_surviving_pct", "preferred_read_loss_pct")
    return lost.select("project_id", "SRR_ID", "t_star", "preferred_delta_path", "preferred_read_loss_pct")


def headline(cls: DataFrame, trim: DataFrame, order: str) -> DataFrame:
    """Totals by preference with the outliers' median gain and loss."""
    cls = settle(cls, "classes")
    outliers = settle(outlier_table(cls, trim, order), "outliers")
    rest = cls.filter(F.col("t_star").eqNullSafe(F.lit(BASELINE))).select("project_id", "SRR_ID", "t_star")
    return classification_headline(outliers.unionByName(rest, allowMissingColumns=True))

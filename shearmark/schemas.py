"""Table schemas, the method dimension and the fixed thresholds of the analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Fixed values of the analysis: method order, file-name labels, thresholds.
METHODS = ("U", "A", "P5", "P10", "P20", "P35")
REFERENCE_METHODS = ("U", "A", "P5", "P10")
TRIMMED_METHODS = ("A", "P5", "P10", "P20", "P35")
MODE_NAMES = {"U": "untrimmed", "A": "adapter_only", "P5": "P5", "P10": "P10", "P20": "P20", "P35": "P35"}
BASELINE = "U"
DEG_FDR = 0.05
DEG_LOG2FC = 1.0
GENE_VOTE_Z = 1.96
PATHWAY_NES = 1.0
VOTE_FRACTION = 0.75
TOP_PATHWAYS = 20
MIN_PER_CONDITION = 3
MIN_SAMPLES = 4
MIN_RANKED_GENES = 50
MIN_PAIRS = 10
SET_SIZE = (15, 500)
QC_FEATURES = (
    "sequence_depth", "Q_mean", "Q_median", "read_length_mean", "frac_below_q20", "frac_below_q30",
    "tail_quality_decay", "adapter_rate", "duplication_rate", "n_content", "gc_content", "gc_deviation",
)
PROFILE_PAIRS = (("U", "A"), ("U", "P5"), ("U", "P10"), ("U", "P20"), ("U", "P35"), ("P5", "P35"))
CONCORDANCE_METRICS = ("rho_gene", "jaccard_deg", "rho_pathway", "jaccard_pathway", "dir_concordance")

CONCORDANCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("project", "SRR_ID", "method")]
    + [T.StructField(n, T.DoubleType()) for n in CONCORDANCE_METRICS])
ANNOTATION = T.StructType([T.StructField(n, T.StringType()) for n in (
    "BioProject", "SRR_ID", "condition", "condition_original", "group", "exclude")])
TRIM_STATS = T.StructType([
    T.StructField("project_id", T.StringType()), T.StructField("srr_id", T.StringType()),
    T.StructField("mode", T.StringType()), T.StructField("layout", T.StringType()),
    T.StructField("input_reads", T.LongType()), T.StructField("surviving", T.LongType()),
    T.StructField("surviving_pct", T.DoubleType()), T.StructField("dropped", T.LongType()),
    T.StructField("dropped_pct", T.DoubleType()),
])
ALIGN_STATS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("project_id", "srr_id", "mode", "layout")]
    + [T.StructField(n, T.LongType()) for n in (
        "total_reads", "paired_reads", "unpaired_reads", "aligned_exactly_1", "aligned_gt1", "aligned_0",
        "concordant_exactly_1", "concordant_gt1", "discordant_1", "pairs_0_concordant")]
    + [T.StructField("overall_alignment_rate", T.StringType())])
STAGE_TIMINGS = T.StructType(
    [T.StructField("stage", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("start_epoch", "end_epoch", "duration_sec")])
PROJECT_METADATA = T.StructType([T.StructField(n, T.StringType()) for n in (
    "Run", "condition", "condition_raw", "condition_role", "class_field", "metadata_status")])


def method_order(col: Column) -> Column:
    """Position of a method in U < A < P5 < P10 < P20 < P35, null for anything else."""
    out = F.lit(None).cast("int")
    for i, m in enumerate(METHODS):
        out = F.when(col == m, F.lit(i)).otherwise(out)
    return out


def methods(spark: SparkSession) -> DataFrame:
    """The six-row method dimension (method, ord)."""
    return spark.createDataFrame([(m, i) for i, m in enumerate(METHODS)], "method string, ord int")

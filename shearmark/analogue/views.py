"""The domain tables as deterministic views of the driver's tables.

Every view is one or two aggregations over whole tables.  ``sql.py`` states the
same views for the oracle engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.collections import to_long
from ..runtime import dealt
from ..schemas import METHODS, MODE_NAMES, TRIMMED_METHODS

# Smallest l_quantity that survives each mode is just above its cutoff.
CUTOFF = {"U": 0, "A": 1, "P5": 5, "P10": 10, "P20": 20, "P35": 35}


class Tables:
    """The driver's Parquet tables below one folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _text(prefix: str, value) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def _hundredths(c: str):
    """A two-decimal rate as a whole number, so that sums do not depend on their order."""
    return F.round(F.col(c) * 100).cast("long")


def lines(t: Tables, *columns: str) -> DataFrame:
    """Columns of the line items by order: an order has a few lines, so that sums before the shuffle would hold all orders."""
    return dealt(t.lineitem.select("l_orderkey", *columns), ["l_orderkey"], t.lineitem.count())


def reads(t: Tables) -> DataFrame:
    s = F.floor(F.col("l_orderkey") / F.lit(3)).cast("long") % 20
    return t.lineitem.select(
        _text("P", F.col("l_orderkey") % 3).alias("project"), _text("S", s).alias("srr"),
        F.when(s < 10, "control").otherwise("treatment").alias("condition"),
        _text("g", F.col("l_partkey") % 200).alias("gene"), F.col("l_quantity").alias("q"))


def counts(t: Tables) -> DataFrame:
    """Gene counts per (project, srr, mode, gene): one shuffle over the reads, then wide to long."""
    wide = reads(t).groupBy("project", "srr", "gene").agg(*[
        F.count_if(F.col("q") > CUTOFF[m]).alias(m) for m in METHODS])
    return (to_long(wide, ["project", "srr", "gene"], list(METHODS), "mode", "count")
            .withColumn("count", F.col("count").cast("long")).filter(F.col("count") > 0)
            .select("project", "srr", "mode", "gene", "count"))


def samples(t: Tables) -> DataFrame:
    return reads(t).select("project", "srr", "condition").distinct()


def samples_of_three(t: Tables) -> DataFrame:
    """The samples in three conditions; those of project P1 have none of the usual names."""
    number = F.substring("srr", 2, 10).cast("int")
    name = F.when(number < 7, "control").when(number < 14, "treatment").otherwise("other")
    other = F.when(number < 7, "warm").when(number < 14, "cold").otherwise("mild")
    return samples(t).select("project", "srr", F.when(F.col("project") == "P1", other).otherwise(name).alias("condition"))


def gene_sets(t: Tables) -> DataFrame:
    number = F.col("p_partkey") % 200
    return t.part.select(number.alias("n")).distinct().select(
        F.explode(F.array(_text("mod", F.col("n") % 8), _text("div", F.floor(F.col("n") / F.lit(40)).cast("long"))))
        .alias("set_name"), F.lit("na").alias("description"), _text("g", F.col("n")).alias("gene"))


def trim_detail(t: Tables) -> DataFrame:
    """Read survival per (sample, mode), percentages as text with some that are not numbers."""
    per = lines(t, "l_quantity").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("input_reads"),
        *[F.count_if(F.col("l_quantity") > CUTOFF[m]).alias(MODE_NAMES[m]) for m in TRIMMED_METHODS])
    ids = ["l_orderkey", "input_reads"]
    long = to_long(per, ids, [MODE_NAMES[m] for m in TRIMMED_METHODS], "mode", "surviving")
    return long.select(
        _text("SRR", F.col("l_orderkey")).alias("SRR_ID"), _text("P", F.col("l_orderkey") % 3).alias("project_id"),
        "mode", F.when(F.col("l_orderkey") % 4 == 0, "SE").otherwise("PE").alias("layout"), "input_reads",
        F.col("surviving").cast("long").alias("surviving"),
        F.when(F.col("l_orderkey") % 97 == 0, "NA").otherwise(
            (F.col("surviving") / F.col("input_reads") * 100).cast("string")).alias("surviving_pct"),
        F.col("l_orderkey").alias("row_no"))


def throughput(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    # A stage for each priority, a mode for each status.
    stage = F.substring("o_orderpriority", 1, 1)
    category = (F.when(stage == "1", "fastqc").when(stage == "2", "sra_conversion").when(stage == "3", "trim")
                .when(stage == "4", "align").otherwise("count"))
    mode = (F.when(stage.isin("1", "2"), F.lit(None)).when(F.col("o_orderstatus") == "F", "untrimmed")
            .when(F.col("o_orderstatus") == "O", "adapter_only").otherwise("P5"))
    return t.orders.select(
        _text("SRR", c).alias("SRR_ID"), category.alias("category"), mode.alias("mode"),
        F.when(k % 97 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("duration_sec"),
        (k % 8 + 1).cast("double").alias("cores_used"),
        F.when(k % 101 == 0, F.lit(0.0)).otherwise((c % 3000 + 500).cast("double")).alias("fastq_mb"),
        ((k % 50) / F.lit(4.0)).alias("mb_per_sec"))


def fetch_attempts(t: Tables) -> DataFrame:
    k = F.col("event_id")
    start = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + F.round(F.col("value") * 1000000).cast("long"))
    return t.events.select(
        _text("SRR", F.col("user_id")).alias("srr_id"), F.col("event_type").alias("endpoint"),
        F.when(k % 10 < 7, "success").when(k % 10 < 9, "failed").otherwise("pending").alias("status"),
        start.alias("started_at"), F.when(k % 50 != 0, end).alias("finished_at"),
        (k % 7 * 1000000 + k % 1000).alias("bytes_downloaded"))


def queue(t: Tables) -> DataFrame:
    status = (F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "submitted")
              .when(F.col("o_orderkey") % 2 == 0, "todo").otherwise("abandoned"))
    return t.orders.select(
        _text("PRJ", F.col("o_custkey")).alias("project_id"), _text("SRR", F.col("o_orderkey")).alias("srr_id"),
        status.alias("status"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("run_status"))


def id_files(t: Tables) -> DataFrame:
    """Runs listed in the id files: every queued run but each eleventh."""
    return queue(t).select("project_id", "srr_id").filter(F.substring("srr_id", 4, 20).cast("long") % 11 != 0)


def id_lists(t: Tables) -> DataFrame:
    """Id lists of every queued run, as the cohort's flow counts them."""
    return queue(t).select("project_id", "srr_id")


def metadata(t: Tables) -> DataFrame:
    """Run annotation: five customers make a project, the market segment is the condition."""
    return t.customer.select(
        _text("PRJ", F.floor(F.col("c_custkey") / F.lit(5)).cast("long")).alias("project"),
        _text("SRR", F.col("c_custkey")).alias("Run"), F.col("c_mktsegment").alias("condition"),
        F.when(F.col("c_nationkey") % 3 != 0, F.when(F.col("c_nationkey") % 3 == 1, "PAIRED").otherwise("SINGLE"))
        .alias("layout"))


def quality(t: Tables) -> DataFrame:
    """Twelve QC features per sample, each an exact ratio of whole numbers."""
    n = F.count(F.lit(1))
    mean = lambda x: F.sum(x) / n
    d, x, q = _hundredths("l_discount"), _hundredths("l_tax"), F.col("l_quantity").cast("long")
    per = lines(t, "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey").groupBy("l_orderkey").agg(
        n.cast("double").alias("sequence_depth"), (mean(d) + 28).alias("Q_mean"),
        (F.max(d) + 28).cast("double").alias("Q_median"), mean(q).alias("read_length_mean"),
        mean(F.when(d < 2, 1).otherwise(0)).alias("frac_below_q20"),
        mean(F.when(d < 5, 1).otherwise(0)).alias("frac_below_q30"),
        (mean(x) / F.lit(4.0)).alias("tail_quality_decay"), mean(F.when(q < 5, 1).otherwise(0)).alias("adapter_rate"),
        mean(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("duplication_rate"),
        mean(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("n_content"),
        mean(F.col("l_partkey") % 100).alias("gc_content"), mean(F.col("l_suppkey") % 10).alias("gc_deviation"))
    return per.select(_text("SRR", F.col("l_orderkey")).alias("SRR_ID"),
                      _text("P", F.col("l_orderkey") % 3).alias("project_id"), *per.columns[1:])


def qc_positions(t: Tables) -> DataFrame:
    """Mean quality by position (l_quantity, at most 50) of two mate reports per sample, one sample per supplier."""
    return t.lineitem.groupBy(
        _text("P", F.col("l_suppkey") % 3).alias("project_id"), _text("SRR", F.col("l_suppkey")).alias("SRR_ID"),
        (F.col("l_linenumber") % 2 + 1).alias("mate"), F.col("l_quantity").cast("int").alias("pos")).agg(
        (F.sum(_hundredths("l_discount")) / F.count(F.lit(1)) + 28).alias("mean_q"))


def concordance(t: Tables) -> DataFrame:
    """Concordance-shaped rows per (order, method): shares of an order that survive a mode."""
    d, line = _hundredths("l_discount"), F.col("l_linenumber").cast("long")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(line).alias("lines"),
            F.count_if(F.col("l_returnflag") == "A").alias("flags")]
    for m in METHODS:
        keep = F.col("l_quantity") > CUTOFF[m]
        aggs += [F.count_if(keep).alias(f"n_{m}"), F.sum(F.when(keep, line).otherwise(0)).alias(f"l_{m}"),
                 F.sum(F.when(keep, d).otherwise(0)).alias(f"d_{m}"),
                 F.count_if(keep & (F.col("l_returnflag") == "A")).alias(f"f_{m}")]
    per = lines(t, "l_discount", "l_linenumber", "l_returnflag", "l_quantity").groupBy("l_orderkey").agg(*aggs)
    rows = per.select("l_orderkey", "n", "lines", "flags", F.explode(F.array(*[F.struct(
        F.lit(m).alias("method"), *[F.col(f"{k}_{m}").alias(k) for k in ("l", "d", "f")],
        F.col(f"n_{m}").alias("kept")) for m in METHODS])).alias("e")).select(
        "l_orderkey", "n", "lines", "flags", "e.*")
    kept = F.col("kept")
    return rows.select(
        _text("P", F.col("l_orderkey") % 3).alias("project"), _text("SRR", F.col("l_orderkey")).alias("SRR_ID"),
        "method", F.when(kept > 0, kept / F.col("n")).alias("rho_gene"),
        (F.col("l") / F.col("lines")).alias("jaccard_deg"),
        F.when(kept > 0, F.lit(1.0) - F.col("d") / (kept * F.lit(20.0))).alias("rho_pathway"),
        F.when(kept > 0, F.col("d") / (kept * F.lit(10.0))).alias("jaccard_pathway"),
        F.when(F.col("flags") > 0, F.col("f") / F.col("flags")).alias("dir_concordance"))


def predictions(cls: DataFrame) -> DataFrame:
    """True and predicted method: the call itself against a rule on two of the deltas."""
    rule = F.when(F.col("P35_delta_path") > 0.1, "P35").when(F.col("P20_delta_path") > 0.05, "P20").otherwise("U")
    return cls.select("SRR_ID", "project_id", F.col("t_star").alias("True_t_star"), rule.alias("Predicted_t_star"))


def paths(t: Tables) -> DataFrame:
    """Flattened file paths made of the pages' language, host and number."""
    host = F.regexp_extract("url", r"^https?://([^/]+)/", 1)
    lang, number = (F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/(\d+)", i) for i in (1, 2))
    return t.pages.select(F.concat(F.lit("data/flattened_"), lang, F.lit("/"), host, F.lit("/SRR"), number,
                                   F.lit("_x.txt")).alias("path"), host.alias("host"), "page_id")


def cohort(t: Tables) -> DataFrame:
    return paths(t).filter(F.col("page_id") % 3 == 0).select(F.col("host").alias("project")).distinct()


def aligner_runs(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("aligner"),
        F.col("o_totalprice").alias("duration_sec"),
        (F.col("o_custkey") % 30 / F.lit(10.0)).alias("aligned_input_gb"))


def timings(t: Tables) -> DataFrame:
    """Stage seconds per sample, with recorded totals that are sometimes off by one."""
    s = F.floor(F.col("l_orderkey") / F.lit(3)).cast("long") % 60
    # A stage for each third of the lines, a mode for each return flag.
    per = t.lineitem.groupBy(_text("P", F.col("l_orderkey") % 3).alias("project"), s.alias("s")).agg(*[
        F.sum(F.when((F.col("l_returnflag") == f) & (F.col("l_linenumber") % 3 == i), F.col("l_quantity").cast("long"))
              .otherwise(0)).alias(f"{c}_{m}")
        for f, m in (("A", "adapter_only"), ("N", "untrimmed"), ("R", "P5"))
        for i, c in enumerate(("trim", "align", "count"))])
    modes = ("adapter_only", "untrimmed", "P5")
    for m in modes:
        total = F.col(f"trim_{m}") + F.col(f"align_{m}") + F.col(f"count_{m}")
        per = per.withColumn(f"mode_{m}_total", total + F.when(F.col("s") % 17 == 0, 1).otherwise(0))
    per = per.withColumn("pipeline_total", sum(F.col(f"mode_{m}_total") for m in modes) + F.when(F.col("s") % 23 == 0, 1).otherwise(0))
    stages = [c for c in per.columns if c not in ("project", "s")]
    return to_long(per, ["project", "s"], stages, "stage", "duration_sec").select(
        "project", _text("S", F.col("s")).alias("srr"), "stage", F.col("duration_sec").cast("long").alias("duration_sec"))

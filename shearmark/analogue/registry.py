"""One registered query per inventory id: the Spark job and, where SQL can state it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import cleaning as P
from ..operators import collections as U
from ..operators import counts as C
from ..operators import enrich as G
from ..operators import joins as J
from ..operators import ordering as O
from ..operators import stats as ST
from ..operators import summaries as A
from ..plans import classify, cohort, cost, loso, qcmodel, quality
from ..runtime import settle, shared_folder
from ..schemas import CONCORDANCE, METHODS, PROFILE_PAIRS, QC_FEATURES, TRIMMED_METHODS, method_order
from ..sources import readers as R
from ..sources import writers as W
from ..streaming import ingest
from . import views as V
from .sql import LOOSE, MODE_NAME, r6, spearman_sql, vote_sql, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six decimals without negative zeros, so that engines can be compared by value."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[(F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) if c in doubles else F.col(f"`{c}`")
                       for c in df.columns])


def query(name: str, oracle: str | None = None):
    """Register a function of the driver's tables under ``name``."""
    def add(fn):
        QUERIES[name] = lambda spark, folder: rounded(fn(V.Tables(spark, folder)))
        if oracle:
            ORACLES[name] = with_views(oracle)
        return fn
    return add


# --- derived inputs -------------------------------------------------------------------------------------------

def trim(t):
    return P.coerce_double(V.trim_detail(t), ["surviving_pct"])


def fetches(t):
    return R.fetch_attempts(V.fetch_attempts(t))


def terminal(t):
    positions = V.qc_positions(t).withColumn("report", F.col("mate").cast("string"))
    return quality.terminal_quality(positions)


def quality_full(t):
    return quality.quality_table(V.quality(t), terminal(t))


def classes(t):
    return classify.classify_trimming(V.concordance(t))


def evaluation(t):
    """Predictions with features and called methods."""
    cls = settle(classes(t), "classes")
    return qcmodel.evaluation_table(V.predictions(cls), V.quality(t), cls)


def panel(t):
    return A.replicate_structure(V.metadata(t))


def filtered(t, lists=V.id_files):
    return J.left_join(P.runs_between(V.queue(t)), R.id_list_sizes(lists(t)), ["project_id"])


def annotation(t):
    k = F.col("c_custkey")
    return t.customer.select(
        F.concat(F.lit("PRJ"), F.col("c_nationkey").cast("string")).alias("BioProject"),
        F.concat(F.lit("SRR"), k.cast("string")).alias("SRR_ID"),
        F.when(k % 2 == 0, "control").otherwise("treatment").alias("condition"),
        F.col("c_mktsegment").alias("condition_original"),
        F.when(k % 19 == 0, "x").otherwise((k % 4).cast("string")).alias("group"),
        F.when(k % 5 == 0, "failed").when(k % 5 == 1, "").alias("exclude"))


def raw_diff(t):
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    return t.part.select(
        k.alias("gene"), F.when(k % 7 != 0, size - 25).alias("log2fc"),
        F.when(k % 11 == 0, F.lit(float("nan"))).otherwise(size / F.lit(10.0)).alias("stat"),
        F.when(k % 13 != 0, size / F.lit(50.0)).alias("pvalue"), F.when(k % 5 != 0, size / F.lit(50.0)).alias("padj"))


def project_diff(t):
    """Whole-project tests of every (project, mode)."""
    counts = settle(V.counts(t), "counts")
    design = V.samples(t).join(counts.select("project", "srr", "mode").distinct(), ["project", "srr"])
    return settle(C.diff_test(counts, design, ["project", "mode"]), "diff")


# --- sources and sinks ----------------------------------------------------------------------------------------

@query("S1_read_table", "SELECT p_partkey, p_name, p_brand, p_type, p_size, " + r6("p_retailprice")
       + " AS p_retailprice FROM part")
def s1(t):
    path = shared_folder(t.spark, "part") + ".csv"
    t.part.write.option("header", True).csv(path)
    return R.read_table(t.spark, path, t.part.schema)


@query("S2_read_headerless", """SELECT 'PRJ' || o_custkey AS BioProject, CAST(count(*) AS INTEGER) AS n_runs FROM orders
    WHERE o_custkey % 13 <> 0 GROUP BY 1""")
def s2(t):
    path = shared_folder(t.spark, "headerless")
    key = F.when(F.col("o_custkey") % 13 != 0, F.concat(F.lit("PRJ"), F.col("o_custkey").cast("string")))
    t.orders.groupBy(key.alias("k")).agg(F.count(F.lit(1))).write.option("sep", "\t").csv(path)
    return R.read_headerless(t.spark, path, ["BioProject", "n_runs"])


@query("S3_read_id_lists", """SELECT 'P' || (o_custkey % 20) AS project_id, count(*) AS n_files FROM orders
    WHERE o_orderkey % 7 <> 0 GROUP BY 1""")
def s3(t):
    path, k = shared_folder(t.spark, "ids"), F.col("o_orderkey")
    line = F.when(k % 7 != 0, F.concat(F.lit("  SRR"), k.cast("string"), F.lit(" "))).otherwise(
        F.when(k % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("ERR"), k.cast("string"))))
    name = F.concat(F.lit("P"), (F.col("o_custkey") % 20).cast("string"), F.lit("_SRR_IDs.txt"))
    t.orders.select(line.alias("value"), name.alias("list")).write.partitionBy("list").text(path)
    return R.id_list_sizes(R.read_id_lists(t.spark, path))


@query("S4_read_feature_counts", 'SELECT project, srr, mode, gene, "count" FROM counts')
def s4(t):
    path = shared_folder(t.spark, "feature_counts")
    suffix = F.when(F.col("mode") == "A", "adapter").otherwise(F.col("mode"))
    name = F.when(F.col("mode") == "U", F.concat(F.lit("untrmd_"), "srr", F.lit("_fC.txt.gz"))).otherwise(
        F.concat("srr", F.lit("_trimmomatic_"), suffix, F.lit("_fC.txt.gz")))
    counts = V.counts(t).withColumn("file", name)
    body = counts.select("project", "file", F.concat_ws(
        "\t", "gene", F.lit("chr1"), F.lit("1"), F.lit("9"), F.lit("+"), F.lit("9"), F.col("count").cast("string")).alias("value"))
    head = counts.select("project", "file").distinct().select("project", "file", F.explode(F.array(
        F.lit("# Program: counts"), F.lit("Geneid\tChr\tStart\tEnd\tStrand\tLength\tsample.bam"))).alias("value"))
    (head.unionByName(body).repartition("project", "file").write.partitionBy("project", "file")
     .option("compression", "gzip").text(path))
    return R.read_feature_counts(t.spark, path)


@query("S5_read_qc_sections", f"""SELECT project_id, SRR_ID, SRR_ID || '_' || mate || '_fastqc' AS report,
    {r6('mean_q')} AS mean_q FROM qcpos WHERE pos % 17 <> 0""")
def s5(t):
    """Reports packed into a few files for each project: a folder for every report would be listed by the driver."""
    path = shared_folder(t.spark, "qc")
    value = F.when(F.col("pos") % 17 == 0, "n/a").otherwise(F.col("mean_q").cast("string"))
    line = F.struct("pos", F.concat_ws("\t", F.col("pos").cast("string"), value, F.lit("1")).alias("line"))
    # At most 50 positions make a report.
    per = V.qc_positions(t).groupBy("project_id", "SRR_ID", "mate").agg(F.sort_array(F.collect_list(line)).alias("rows"))
    file = F.concat("SRR_ID", F.lit("_"), F.col("mate").cast("string"), F.lit(".fastq.gz"))
    text = F.concat_ws("\n", F.lit("##FastQC\t0.11\n>>Basic Statistics\tpass"), F.concat(F.lit("Filename\t"), file), F.lit(">>END_MODULE"),
                       F.lit(">>Per base sequence quality\tpass\n#Base\tMean\tMedian"), F.col("rows.line"),
                       F.lit(">>END_MODULE\n>>Other\tpass\n1\t99.0\n>>END_MODULE"))
    per.select("project_id", text.alias("value")).write.partitionBy("project_id").text(path)
    return R.read_qc_sections(t.spark, path).select("project_id", "SRR_ID", "report", "mean_q")


@query("S6_read_gene_sets", "SELECT set_name, description, gene FROM gene_sets")
def s6(t):
    path = shared_folder(t.spark, "gmt")
    # One line per set is the file format; a set is bounded by the gene catalogue.
    V.gene_sets(t).groupBy("set_name").agg(F.concat_ws("\t", F.first("set_name"), F.lit(""), F.collect_list("gene"))
                                          .alias("value")).select("value").write.text(path)
    return R.read_gene_sets(t.spark, path)


@query("S7_fetch_attempts", """SELECT srr_id, endpoint, status, started_us, finished_us,
    CAST(bytes_downloaded AS DOUBLE) AS bytes_downloaded FROM fetches""")
def s7(t):
    text = V.fetch_attempts(t).select(*[F.col(c).cast("string").alias(c) for c in V.fetch_attempts(t).columns])
    return R.fetch_attempts(text).select("srr_id", "endpoint", "status", F.unix_micros("started_at").alias("started_us"),
                                         F.unix_micros("finished_at").alias("finished_us"), "bytes_downloaded")


@query("S7_queue_table", "SELECT project_id, srr_id, status, run_status FROM queue")
def s7b(t):
    return R.queue_table(V.queue(t))


@query("S8_read_project_metadata", """SELECT 'PRJ' || c_nationkey AS project, 'SRR' || c_custkey AS Run,
    lower(c_mktsegment) AS condition, c_mktsegment || ', raw' AS condition_raw FROM customer""")
def s8(t):
    path = shared_folder(t.spark, "metadata")
    rows = t.customer.select(
        F.concat(F.lit("PRJ"), F.col("c_nationkey").cast("string"), F.lit(".csv")).alias("file"),
        F.concat(F.lit("SRR"), F.col("c_custkey").cast("string")).alias("Run"), F.lower("c_mktsegment").alias("condition"),
        F.concat("c_mktsegment", F.lit(", raw")).alias("condition_raw"), F.lit("class").alias("condition_role"),
        F.lit("auto").alias("class_field"), F.lit("ok").alias("metadata_status"))
    rows.write.partitionBy("file").option("header", True).csv(path)
    return R.read_project_metadata(t.spark, path).select("project", "Run", "condition", "condition_raw")


def _timings(t):
    path = shared_folder(t.spark, "timings")
    file = F.concat("srr", F.lit("_timings.tsv"))
    rows = V.timings(t).select("project", file.alias("file"), "stage", F.lit(0).alias("start_epoch"),
                               F.lit(0).alias("end_epoch"), "duration_sec")
    rows.repartition("project", "file").write.partitionBy("project", "file").option("sep", "\t").option("header", True).csv(path)
    return R.read_stage_timings(t.spark, path)


@query("S9_read_stage_timings", "SELECT project, srr, category, mode, stage, duration_sec FROM timings")
def s9(t):
    return _timings(t)


@query("S10_read_trim_stats", f"""SELECT project_id, SRR_ID, mode, layout, input_reads, surviving,
    {r6('surviving_pct')} AS surviving_pct FROM trim""")
def s10(t):
    path = shared_folder(t.spark, "trim_stats")
    d = V.trim_detail(t)
    d.select("project_id", F.col("SRR_ID").alias("srr_id"), "mode", "layout", "input_reads", "surviving", "surviving_pct",
             (F.col("input_reads") - F.col("surviving")).alias("dropped"), F.lit(0.0).alias("dropped_pct")
             ).write.option("sep", "\t").option("header", True).csv(path)
    return R.read_trim_stats(t.spark, path).select("project_id", "SRR_ID", "mode", "layout", "input_reads", "surviving",
                                                  "surviving_pct")


@query("S10_read_align_stats", """SELECT 'SRR' || o_orderkey AS SRR_ID, o_orderkey % 100000 AS total_reads,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 10000) / 100.0::DOUBLE END AS overall_alignment_pct FROM orders""")
def s10b(t):
    path, k = shared_folder(t.spark, "align_stats"), F.col("o_orderkey")
    rate = F.when(k % 9 == 0, "NA").otherwise(F.concat(F.format_string("%.2f", (k % 10000) / F.lit(100.0)), F.lit("%")))
    numbers = [F.lit(0).alias(n) for n in R.ALIGN_STATS.fieldNames()[5:14]]
    t.orders.select(F.lit("P").alias("project_id"), F.concat(F.lit("SRR"), k.cast("string")).alias("srr_id"),
                    F.lit("P5").alias("mode"), F.lit("PE").alias("layout"), (k % 100000).alias("total_reads"), *numbers,
                    rate.alias("overall_alignment_rate")).write.option("sep", "\t").option("header", True).csv(path)
    return R.read_align_stats(t.spark, path).select("SRR_ID", "total_reads", "overall_alignment_pct")


TEXT_METRICS = ", ".join(f"coalesce(printf('%.6f', {c}), 'NA') AS {c}" for c in loso.CONCORDANCE_METRICS)


@query("S11_write_results", f"SELECT project, SRR_ID, method, {TEXT_METRICS} FROM conc")
def s11(t):
    path = shared_folder(t.spark, "results")
    W.write_results(V.concordance(t), path)
    return t.spark.read.option("sep", "\t").option("header", True).option("recursiveFileLookup", True).csv(path)


@query("S12_combine_results", "SELECT project, SRR_ID, method, " + ", ".join(
    f"{r6(c)} AS {c}" for c in loso.CONCORDANCE_METRICS) + " FROM conc")
def s12(t):
    path = shared_folder(t.spark, "results")
    W.write_results(V.concordance(t), path)
    out = shared_folder(t.spark, "combined")
    W.combine_results(t.spark, path, out=out)
    return t.spark.read.schema(CONCORDANCE).option("sep", "\t").option("header", True).option("nullValue", "NA").csv(out)


# --- projections and filters ----------------------------------------------------------------------------------

query("P1_active_samples", """SELECT * FROM annotation WHERE (exclude IS NULL OR exclude = '')
    AND TRY_CAST("group" AS INTEGER) > 0""")(lambda t: P.active_samples(annotation(t)))
query("P2_coerce_double", f"SELECT SRR_ID, mode, {r6('surviving_pct')} AS surviving_pct FROM trim")(
    lambda t: trim(t).select("SRR_ID", "mode", "surviving_pct"))
query("P3_runs_between", "SELECT * FROM filtered")(lambda t: P.runs_between(V.queue(t)))
query("P4_cost_columns", f"""SELECT SRR_ID, category, {r6('fastq_gb')} AS fastq_gb, {r6('core_hours')} AS core_hours,
    {r6('core_hours_per_gb')} AS core_hours_per_gb FROM cost""")(
    lambda t: cost.throughput_table(V.throughput(t)).select("SRR_ID", "category", "fastq_gb", "core_hours", "core_hours_per_gb"))
query("P5_stage_label", """SELECT CASE WHEN coalesce(mode, '') = '' THEN category ELSE category || ':' || mode END AS label,
    count(*) AS n FROM thr GROUP BY 1""")(
    lambda t: P.stage_label(V.throughput(t)).groupBy("label").agg(F.count(F.lit(1)).alias("n")))
query("P6_keep_in", "SELECT project_id, srr_id, status FROM queue WHERE status IN ('done', 'todo')")(
    lambda t: P.keep_in(V.queue(t), "status", ["done", "todo"]).select("project_id", "srr_id", "status"))
query("P6_keep_ne_or_null", "SELECT project_id, srr_id, run_status FROM queue WHERE run_status IS DISTINCT FROM '2-HIGH'")(
    lambda t: P.keep_ne_or_null(V.queue(t), "run_status", "2-HIGH").select("project_id", "srr_id", "run_status"))
query("P7_fill_terminal", f"SELECT project_id, SRR_ID, {r6('Q_mean - tail_quality_decay')} AS terminal_q_mean FROM qual")(
    lambda t: quality.quality_table(V.quality(t), None).select("project_id", "SRR_ID", "terminal_q_mean"))
query("P8_sample_id", "SELECT page_id, 'SRR' || number AS srr FROM paths")(lambda t: V.paths(t).select(
    "page_id", S.sample_id(F.element_at(F.split("path", "/"), -1), F.col("path")).alias("srr")))
query("P9_transfer_rate", f"""SELECT srr_id, endpoint, {r6('duration_sec')} AS duration_sec, {r6('mb_downloaded')} AS mb_downloaded,
    {r6('mb_per_sec')} AS mb_per_sec FROM rate""")(lambda t: P.transfer_rate(fetches(t)).select(
        "srr_id", "endpoint", "duration_sec", "mb_downloaded", "mb_per_sec"))
query("P10_neutral_fill", """SELECT gene, coalesce(log2fc, 0) AS log2fc, CASE WHEN isnan(stat) THEN 0 ELSE stat END AS stat,
    coalesce(pvalue, 1) AS pvalue, coalesce(padj, 1) AS padj FROM raw_diff""")(lambda t: P.neutral_fill(raw_diff(t)))
query("P11_significant_genes", f"""SELECT project, mode, gene, {r6('log2fc')} AS log2fc, {r6('padj')} AS padj FROM diff
    WHERE padj < 0.9 AND abs(log2fc) > 0.1""")(lambda t: P.significant_genes(project_diff(t), 0.9, 0.1).select(
        "project", "mode", "gene", "log2fc", "padj"))
query("P12_beyond", f"SELECT project, mode, gene, {r6('stat')} AS stat FROM diff WHERE abs(stat) > 1.96")(
    lambda t: P.beyond(project_diff(t), "stat", 1.96).select("project", "mode", "gene", "stat"))
query("P13_with_method_order", "SELECT project, SRR_ID, method, ord FROM conc JOIN modes USING (method)")(
    lambda t: P.with_method_order(V.concordance(t)).select("project", "SRR_ID", "method", "ord"))
query("P14_drop_null", f"""SELECT SRR_ID, method, {r6('rho_gene')} AS rho_gene, {r6('dir_concordance')} AS dir_concordance
    FROM conc WHERE rho_gene IS NOT NULL AND dir_concordance IS NOT NULL""")(lambda t: P.drop_null(
        V.concordance(t).select("SRR_ID", "method", "rho_gene", "dir_concordance")))
query("P15_mode_name", "SELECT SRR_ID, mode_name AS mode FROM conc JOIN modes USING (method)")(
    lambda t: P.rename_mode(V.concordance(t)).select("SRR_ID", "mode"))
query("P16_pick_by_key", f"""SELECT project_id, SRR_ID, t_star, {r6('CASE t_star ' + ' '.join(
    f"WHEN '{m}' THEN {m}_delta_path" for m in TRIMMED_METHODS) + ' END')} AS picked FROM cls""")(
    lambda t: P.pick_by_key(classes(t), "t_star", "{}_delta_path").select("project_id", "SRR_ID", "t_star", "picked"))
query("P17_benefit_label", "SELECT SRR_ID, project_id, t_star, benefits_from_trimming FROM evaluation")(
    lambda t: evaluation(t).select("SRR_ID", "project_id", "t_star", "benefits_from_trimming"))
query("P18_read_loss", f"SELECT SRR_ID, mode, {r6('100 - surviving_pct')} AS read_loss_pct FROM trim")(
    lambda t: P.read_loss(trim(t)).select("SRR_ID", "mode", "read_loss_pct"))

# --- joins ----------------------------------------------------------------------------------------------------

query("J1_left_join", f"""SELECT project_id, SRR_ID, {r6('Q_mean')} AS Q_mean, {r6('terminal.terminal_q_mean')} AS terminal_q_mean
    FROM qual LEFT JOIN terminal USING (project_id, SRR_ID)""")(lambda t: J.left_join(
        V.quality(t), terminal(t), quality.SAMPLE).select("project_id", "SRR_ID", "Q_mean", "terminal_q_mean"))
query("J2_left_join_complete", f"""SELECT project, SRR_ID, method, {r6('rho_gene')} AS rho_gene, {r6('Q_mean')} AS Q_mean
    FROM conc JOIN qual USING (SRR_ID) WHERE rho_gene IS NOT NULL""")(lambda t: P.drop_null(J.left_join(
        V.concordance(t).select("project", "SRR_ID", "method", "rho_gene"),
        V.quality(t).select("SRR_ID", "Q_mean"), ["SRR_ID"])).select(
        "project", "SRR_ID", "method", "rho_gene", "Q_mean"))
query("J3_evaluation_join", f"""SELECT SRR_ID, project_id, True_t_star, Predicted_t_star, t_star, {r6('Q_mean')} AS Q_mean
    FROM evaluation""")(lambda t: evaluation(t).select("SRR_ID", "project_id", "True_t_star", "Predicted_t_star", "t_star", "Q_mean"))
query("J4_lookup_diff", """SELECT project_id, n_runs, n_files, n_runs - n_files AS diff FROM filtered
    LEFT JOIN n_files USING (project_id) WHERE (n_runs - n_files) IS DISTINCT FROM 0""")(lambda t: J.lookup_diff(
        P.runs_between(V.queue(t)), R.id_list_sizes(V.id_files(t)), ["project_id"], "n_runs", "n_files"))
query("J5_lookup_last", f"""SELECT p.SRR_ID, p.mode, t_star, {r6("CASE WHEN t_star = 'U' THEN 100.0 ELSE surviving_pct END")}
    AS preferred_surviving_pct FROM (SELECT SRR_ID, t_star, {MODE_NAME.format('t_star')} AS mode FROM cls) p
    LEFT JOIN (SELECT SRR_ID, mode, max_by(pct, k) AS surviving_pct FROM (
        SELECT SRR_ID, mode, row_no AS k, surviving_pct AS pct FROM trim WHERE surviving_pct IS NOT NULL
        UNION ALL SELECT SRR_ID, mode, row_no - 1, 1.5 FROM trim) GROUP BY 1, 2) USING (SRR_ID, mode)""")(
    lambda t: J.preferred_survival(
        classes(t).select("SRR_ID", "t_star").withColumn("mode", S.mode_name(F.col("t_star"))),
        trim(t).filter("surviving_pct IS NOT NULL").select("SRR_ID", "mode", "surviving_pct", "row_no").unionByName(
            trim(t).select("SRR_ID", "mode", F.lit(1.5).alias("surviving_pct"), (F.col("row_no") - 1).alias("row_no"))),
        "row_no"))
query("J6_common", """SELECT project, srr, gene, a."count" AS n_u, b."count" AS n_p35 FROM counts a JOIN counts b
    USING (project, srr, gene) WHERE a.mode = 'U' AND b.mode = 'P35'""")(lambda t: J.common(
        V.counts(t).filter("mode = 'U'").select("project", "srr", "gene", F.col("count").alias("n_u")),
        V.counts(t).filter("mode = 'P35'").select("project", "srr", "gene", F.col("count").alias("n_p35")),
        ["project", "srr", "gene"]))
query("J7_missing_from", "SELECT DISTINCT project_id FROM queue WHERE project_id NOT IN (SELECT project_id FROM filtered)")(
    lambda t: J.missing_from(V.queue(t).select("project_id").distinct(), P.runs_between(V.queue(t)), ["project_id"]))
query("J8_cohort_split", "SELECT page_id, host AS project, host IN (SELECT project FROM cohort) AS in_cohort FROM paths")(
    lambda t: J.cohort_split(V.paths(t).select("page_id", F.col("host").alias("project")), V.cohort(t), ["project"]))
query("J9_reconcile", """SELECT project_id, n_queue, coalesce(n_files, 0) AS n_files, n_queue - coalesce(n_files, 0) AS delta
    FROM (SELECT project_id, count(*) AS n_queue FROM queue GROUP BY 1) LEFT JOIN n_files USING (project_id)
    WHERE n_queue <> coalesce(n_files, 0)""")(lambda t: J.reconcile(
        V.queue(t).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_queue")), R.id_list_sizes(V.id_files(t)),
        ["project_id"], "n_queue", "n_files"))
query("J10_dense_counts", """SELECT u.project, f.srr, f.mode, u.gene, coalesce(c."count", 0) AS "count" FROM universe u
    JOIN (SELECT DISTINCT project, srr, mode FROM counts) f ON f.project = u.project
    LEFT JOIN counts c ON c.project = u.project AND c.srr = f.srr AND c.mode = f.mode AND c.gene = u.gene""")(
    lambda t: _dense(t))


def _dense(t):
    counts = settle(V.counts(t), "counts")
    files = counts.select("project", "srr", "mode").distinct()
    return J.dense_counts(counts, C.gene_universe(counts), files).select("project", "srr", "mode", "gene", "count")


@query("J10_dense_sums", f"""WITH f AS (SELECT DISTINCT project, srr, mode FROM counts),
    d AS (SELECT u.project, f.mode, u.gene, coalesce(c."count", 0) AS c FROM universe u JOIN f ON f.project = u.project
    LEFT JOIN counts c ON c.project = u.project AND c.srr = f.srr AND c.mode = f.mode AND c.gene = u.gene)
    SELECT project, mode, gene, count(*) AS n_files, count(*) FILTER (c > 0) AS n_positive, CAST(sum(c) AS BIGINT) AS total,
    {r6('avg(c)')} AS mean, {r6('var_samp(c)')} AS variance FROM d GROUP BY 1, 2, 3""")
def dense_sums(t):
    counts = settle(V.counts(t), "counts")
    return J.dense_sums(counts, C.gene_universe(counts), counts.select("project", "srr", "mode").distinct())


query("J11_leave_one_out", """SELECT s.project, s.srr, s.condition, leave,
    coalesce(a.n, 0) + CASE WHEN leave THEN 0 ELSE 1 END AS n_same, coalesce(b.n, 0) AS n_other
    FROM samples s JOIN leave l ON l.project = s.project AND l.srr = s.srr
    LEFT JOIN rest a ON a.project = s.project AND a.srr = s.srr AND a.condition = s.condition
    LEFT JOIN rest b ON b.project = s.project AND b.srr = s.srr AND b.condition <> s.condition""")(
    lambda t: C.leave_one_out(V.samples(t)))
query("J12_candidate_samples", """SELECT t.project, t.srr, t.method, t.condition,
    count(*) FILTER (m.condition = t.condition) AS n_same, count(*) FILTER (m.condition <> t.condition) AS n_other,
    count(*) FILTER (m.condition <> t.condition) > 0 AS valid
    FROM (SELECT project, srr, mode AS method, condition FROM fac) t
    JOIN members m ON m.project = t.project AND m.srr = t.srr AND m.method = t.method AND m.stage = 'candidate'
    GROUP BY ALL""")(lambda t: C.candidate_samples(V.samples(t), V.counts(t).select("project", "srr", "mode").distinct()))
query("J13_set_members", f"""SELECT project, mode, set_name AS pathway, gene, pos, n AS n_genes FROM proj_ranked
    JOIN gene_sets USING (gene)""")(lambda t: G.set_members(
        O.rank_list(project_diff(t), ["project", "mode"]), V.gene_sets(t)).select(
        "project", "mode", "pathway", "gene", F.col("pos").cast("long").alias("pos"), "n_genes"))

# --- aggregations ---------------------------------------------------------------------------------------------

query("A1_sizes", "SELECT project_id, count(*) AS n_rows, count(DISTINCT srr_id) AS n_srr_id, count(DISTINCT status) AS n_status FROM queue GROUP BY 1")(
    lambda t: A.sizes(V.queue(t), ["project_id"], ["srr_id", "status"]))
query("A1_sizes_global", "SELECT count(*) AS n_rows, count(DISTINCT project) AS n_project, count(DISTINCT SRR_ID) AS n_SRR_ID, count(DISTINCT method) AS n_method FROM conc")(
    lambda t: A.sizes(V.concordance(t), [], ["project", "SRR_ID", "method"]))
query("A2_status_counts", """SELECT status, run_status, count(*) AS "count" FROM queue WHERE status IS NOT NULL
    AND run_status IS NOT NULL GROUP BY 1, 2""")(lambda t: A.status_counts(V.queue(t)))
STATUS = "count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("done", "todo", "submitted", "abandoned"))
query("A3_status_totals", f"SELECT {STATUS} FROM queue")(lambda t: A.status_totals(V.queue(t)))
query("A3_status_by_project", f"SELECT project_id, {STATUS} FROM queue GROUP BY 1")(
    lambda t: A.status_totals(V.queue(t), ["project_id"]))
STAGE = f"""SELECT category, mode, count(*) AS n_records, {r6('quantile_cont(core_hours_per_gb, 0.5)')} AS median_core_hours_per_gb,
    {r6('quantile_cont(core_hours_per_gb, 0.25)')} AS q1_core_hours_per_gb,
    {r6('quantile_cont(core_hours_per_gb, 0.75)')} AS q3_core_hours_per_gb,
    {r6('median(mb_per_sec)')} AS median_mb_per_sec FROM cost GROUP BY 1, 2"""
query("A4_stage_summary", STAGE)(lambda t: cost.cost_summary(V.throughput(t)))
query("A5_paired_ratio", f"""SELECT count(*) AS n_pairs, {r6('median(ratio)')} AS median_ratio, {r6('avg(ratio)')} AS mean_ratio
    FROM (SELECT u / nullif(a, 0) AS ratio FROM (SELECT SRR_ID, median(duration_sec) FILTER (mode = 'untrimmed') AS u,
    median(duration_sec) FILTER (mode = 'adapter_only') AS a FROM cost WHERE category = 'align' GROUP BY 1)
    WHERE u IS NOT NULL AND a IS NOT NULL)""")(lambda t: cost.alignment_ratio(V.throughput(t)))
ENDPOINT = f"""SELECT endpoint, count(*) AS attempts, count(*) FILTER (status = 'success') AS successes,
    count(*) FILTER (status = 'failed') AS failed, {r6('median(mb_per_sec)')} AS median_mb_per_sec FROM rate GROUP BY 1"""
query("A6_endpoint_summary", ENDPOINT)(lambda t: cost.endpoints(fetches(t)))
query("A7_terminal_quality", f"SELECT project_id, SRR_ID, {r6('terminal_q_mean')} AS terminal_q_mean FROM terminal")(terminal)
QSUM = f"""SELECT count(*) AS n_samples, {r6('median(Q_mean)')} AS median_Q_mean, {r6('median(terminal_q_mean)')} AS median_terminal_q_mean,
    {r6('min(Q_mean)')} AS min_Q_mean, {r6('min(terminal_q_mean)')} AS min_terminal_q_mean FROM qfull"""
query("A8_quality_summary", QSUM)(lambda t: A.quality_summary(quality_full(t)))
LABELS = {"rho_gene": ("gene", "rho"), "jaccard_deg": ("gene", "jaccard"), "rho_pathway": ("pathway", "rho"),
          "jaccard_pathway": ("pathway", "jaccard")}
query("A9_describe_long", " UNION ALL ".join(
    f"""SELECT '{m}' AS method, '{k}' AS measure, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std,
    {r6(f'median({c})')} AS median, {r6(f'min({c})')} AS min, {r6(f'max({c})')} AS max, count({c}) AS n FROM conc"""
    for c, (m, k) in LABELS.items()))(lambda t: A.describe_long(V.concordance(t), LABELS))
SURVIVAL = f"""SELECT mode, count(DISTINCT SRR_ID) AS srrs, count(*) FILTER (layout = 'PE') AS paired_srrs,
    {r6('median(surviving_pct)')} AS median_surviving_pct, {r6('avg(surviving_pct)')} AS mean_surviving_pct FROM trim GROUP BY 1"""
query("A10_read_survival", SURVIVAL)(lambda t: A.read_survival(trim(t)))
GENE = f"""SELECT method, ord, count(SRR_ID) AS n, {r6('median(rho_gene)')} AS median_rho_gene, {r6('median(jaccard_deg)')} AS median_jaccard_deg,
    {r6('min(rho_gene)')} AS min_rho_gene, {r6('min(jaccard_deg)')} AS min_jaccard_deg
    FROM modes LEFT JOIN conc USING (method) GROUP BY 1, 2"""
query("A11_gene_summary", GENE)(lambda t: A.gene_summary(V.concordance(t)))
PATHWAY = f"""SELECT method, ord, count(SRR_ID) AS n, {r6('median(rho_pathway)')} AS median_rho_pathway,
    {r6('median(jaccard_pathway)')} AS median_jaccard_pathway, {r6('median(dir_concordance)')} AS median_dir_concordance
    FROM modes LEFT JOIN conc USING (method) GROUP BY 1, 2"""
query("A12_pathway_summary", PATHWAY)(lambda t: A.pathway_summary(V.concordance(t)))
CALLS = " UNION ALL ".join(
    f"SELECT '{m}' AS method, " + ", ".join(f"count(*) FILTER ({m}_class = '{c}') AS {c}" for c in A.CALLS) + " FROM cls"
    for m in TRIMMED_METHODS)
query("A13_call_summary", CALLS)(lambda t: A.call_summary(classes(t)))
query("A14_outlier_projects", "SELECT project_id, count(*) AS n_outliers FROM cls WHERE t_star <> 'U' GROUP BY 1")(
    lambda t: A.outlier_projects(classes(t)))
HEADLINE = f"""SELECT (SELECT count(*) FROM cls) AS total_samples,
    (SELECT count(*) FROM cls WHERE t_star = 'U') AS samples_preferring_untrimmed,
    (SELECT count(*) FROM cls WHERE t_star <> 'U') AS samples_preferring_trimmed,
    {r6('median(preferred_delta_path)')} AS median_outlier_pathway_delta,
    {r6('median(preferred_read_loss_pct)')} AS median_outlier_read_loss_pct FROM outliers"""
query("A15_classification_headline", HEADLINE)(lambda t: classify.headline(classes(t), trim(t), "row_no"))
query("A16_class_counts_wide", "SELECT project_id, count(*) AS n_srrs, " + ", ".join(
    f"count(*) FILTER ({m}_class = '{c}') AS {m}_{c}" for m in TRIMMED_METHODS for c in A.CALLS) + " FROM cls GROUP BY 1")(
    lambda t: A.class_counts_wide(classes(t)))
ACCURACY = f"""SELECT count(*) AS n_rows, {r6("avg(CASE WHEN True_t_star = 'U' THEN 1 ELSE 0 END)")} AS baseline_accuracy,
    {r6('avg(CASE WHEN True_t_star = Predicted_t_star THEN 1 ELSE 0 END)')} AS model_accuracy FROM pred"""
query("A17_accuracy", ACCURACY)(lambda t: A.accuracy(V.predictions(classes(t)), "True_t_star", "Predicted_t_star"))
query("A18_confusion", "SELECT True_t_star, " + ", ".join(
    f"count(*) FILTER (Predicted_t_star = '{m}') AS {m}" for m in METHODS) + " FROM pred GROUP BY 1")(
    lambda t: A.confusion(V.predictions(classes(t)), "True_t_star", "Predicted_t_star"))
SPEED = "(duration_sec / 60) / nullif(aligned_input_gb, 0)"
query("A19_aligner_speed", "SELECT mode, " + ", ".join(
    f"{r6(f'''median({SPEED}) FILTER (aligner = '{a}')''')} AS {a}_median, {r6(f'''avg({SPEED}) FILTER (aligner = '{a}')''')} AS {a}_mean"
    for a in "FOP") + " FROM runs GROUP BY 1")(lambda t: cost.aligner_speed(V.aligner_runs(t), ["F", "O", "P"]))
query("A20_directory_audit", """SELECT 'flattened_' || lang AS flattened_dir, count(DISTINCT host) AS projects_total,
    count(DISTINCT number) AS unique_srrs_total, count(DISTINCT host) FILTER (ic) AS projects_in_cohort,
    count(DISTINCT number) FILTER (ic) AS unique_srrs_in_cohort, count(DISTINCT host) FILTER (NOT ic) AS projects_outside_cohort,
    count(DISTINCT number) FILTER (NOT ic) AS unique_srrs_outside_cohort
    FROM (SELECT *, host IN (SELECT project FROM cohort) AS ic FROM paths) GROUP BY lang""")(
    lambda t: A.directory_audit(V.paths(t), V.cohort(t)))
query("A20_outside_projects", """SELECT DISTINCT 'flattened_' || lang AS flattened_dir, host AS project FROM paths
    WHERE host NOT IN (SELECT project FROM cohort)""")(lambda t: A.outside_projects(V.paths(t), V.cohort(t)))
query("A21_gene_universe", "SELECT project, gene FROM universe")(lambda t: C.gene_universe(V.counts(t)))
query("A22_eligibility", """SELECT project, CAST(sum(n) AS BIGINT) AS n_samples, count(*) AS n_conditions, min(n) AS min_per_condition,
    sum(n) >= 4 AND count(*) >= 2 AS eligible FROM classes GROUP BY 1""")(lambda t: C.eligibility(V.metadata(t)))
query("A23_consensus", f"""SELECT project, gene, {r6('median(stat)')} AS stat FROM diff WHERE mode IN ('U', 'A', 'P5', 'P10')
    GROUP BY 1, 2""")(lambda t: ST.consensus(
        project_diff(t).filter(F.col("mode").isin("U", "A", "P5", "P10")), ["project", "gene"], "stat"))
query("A24_cohort_totals", f"""SELECT included, count(*) AS projects, CAST(sum(total_srrs) AS BIGINT) AS srrs,
    CAST(sum(eligible_srrs) AS BIGINT) AS eligible, {r6('median(total_srrs)')} AS median_srrs,
    {r6('median(total_classes)')} AS median_classes FROM panel GROUP BY 1""")(lambda t: A.cohort_totals(panel(t)))
query("A25_value_counts", """SELECT coalesce(layout, 'Unknown') AS layout, count(*) AS "count" FROM meta GROUP BY 1""")(
    lambda t: A.value_counts(V.metadata(t), "layout"))
query("A26_replicate_structure", "SELECT * FROM panel")(panel)
query("A27_timing_check", """SELECT project, 'S' || s AS srr, mode, recorded, CAST(summed AS BIGINT) AS summed, recorded = summed AS agrees FROM (
    SELECT project, s, mode, recorded, summed FROM modes_t UNION ALL
    SELECT project, s, 'pipeline', CAST(sum(recorded) + CASE WHEN s % 23 = 0 THEN 1 ELSE 0 END AS BIGINT), sum(recorded)
    FROM modes_t GROUP BY project, s)""")(lambda t: A.timing_check(V.timings(t)))

# --- ordered computations -------------------------------------------------------------------------------------

query("W1_avg_rank", """SELECT SRR_ID, mode, surviving, (rank() OVER (PARTITION BY mode ORDER BY surviving)
    + (count(*) OVER (PARTITION BY mode, surviving) - 1) / 2.0)::DOUBLE AS rank FROM trim""")(
    lambda t: O.avg_rank(V.trim_detail(t).select("SRR_ID", "mode", "surviving"), ["mode"], "surviving"))
query("W2_top_abs", f"""SELECT project, mode, gene, {r6('stat')} AS stat FROM (SELECT *, row_number() OVER (
    PARTITION BY project, mode ORDER BY abs(stat) DESC, gene) AS rn FROM diff) WHERE rn <= 20""")(
    lambda t: O.top_abs(project_diff(t), ["project", "mode"], "stat", 20, "gene").select("project", "mode", "gene", "stat"))
query("W3_tail_mean", f"""SELECT project_id, SRR_ID, mate, {r6('avg(mean_q)')} AS tail_mean FROM (SELECT *, row_number() OVER (
    PARTITION BY project_id, SRR_ID, mate ORDER BY pos DESC) AS rn FROM qcpos) WHERE rn <= 10 GROUP BY 1, 2, 3""")(
    lambda t: O.tail_mean(V.qc_positions(t), ["project_id", "SRR_ID", "mate"], "pos", "mean_q"))
FUNNEL = """SELECT '1. query' AS stage, count(*) AS projects, NULL::BIGINT AS samples FROM (SELECT DISTINCT project_id FROM queue)
    UNION ALL SELECT '2. run-count filter', count(*), CAST(sum(n_files) AS BIGINT) FROM filtered LEFT JOIN n_ids USING (project_id)
    UNION ALL SELECT '3. queue', count(DISTINCT project_id), count(*) FROM queue WHERE project_id IN (SELECT project_id FROM filtered)
    UNION ALL SELECT '4. curated panel', count(DISTINCT project), CAST(sum(total_srrs) AS BIGINT) FROM panel
    UNION ALL SELECT '5. eligible', count(*), CAST(sum(eligible_srrs) AS BIGINT) FROM panel WHERE included = 'Yes'
    UNION ALL SELECT '6. concordance', count(DISTINCT project), count(DISTINCT SRR_ID) FROM conc"""
LOSS = f"SELECT *, lag(projects) OVER (ORDER BY stage) - projects AS loss FROM ({FUNNEL})"


def funnel(t):
    queue, kept = V.queue(t), settle(filtered(t, V.id_lists), "filtered")
    return cohort.cohort_funnel(queue.select("project_id").distinct(), kept,
                                queue.join(kept.select("project_id"), "project_id", "left_semi"), panel(t), V.concordance(t))


query("W4_stage_loss", f"SELECT stage, loss FROM ({LOSS})")(lambda t: funnel(t).select("stage", "loss"))
query("W5_running_score", f"SELECT project, mode, set_name AS pathway, {r6('es')} AS es FROM proj_es")(lambda t: G.running_score(
    G.set_members(O.rank_list(project_diff(t), ["project", "mode"]), V.gene_sets(t)).withColumn("weight", F.abs("stat")),
    ["project", "mode"]))
query("W6_bh_adjust", f"SELECT project, mode, gene, {r6('pvalue')} AS pvalue, {r6('padj')} AS padj FROM diff")(
    lambda t: O.bh_adjust(project_diff(t).drop("padj"), ["project", "mode"], "pvalue").select("project", "mode", "gene", "pvalue", "padj"))


def spread(t):
    """Rows with null keys, null values, ties and a column of the caller's own called n."""
    k = F.col("l_linenumber")
    return t.lineitem.select(
        "l_orderkey", k.alias("n"), F.when(k != 3, F.col("l_returnflag")).alias("g"),
        F.when(F.col("l_quantity") <= 45, F.col("l_quantity").cast("double")).alias("v"),
        F.when(k != 5, F.col("l_orderkey") % 97 / F.lit(97.0)).alias("p"))


SPREAD = """(SELECT l_orderkey, l_linenumber AS n, CASE WHEN l_linenumber <> 3 THEN l_returnflag END AS g,
    CASE WHEN l_quantity <= 45 THEN l_quantity::DOUBLE END AS v, CASE WHEN l_linenumber <> 5 THEN l_orderkey % 97 / 97.0::DOUBLE END AS p
    FROM lineitem)"""
query("W1_avg_rank_spread", f"""SELECT l_orderkey, n, g, {r6('v')} AS v, (rank() OVER (PARTITION BY g ORDER BY s.v NULLS FIRST)
    + (count(*) OVER (PARTITION BY g, s.v) - 1) / 2.0)::DOUBLE AS rank FROM {SPREAD} s""")(
    lambda t: O.avg_rank(spread(t).drop("p"), ["g"], "v", limit=1))
query("W6_bh_adjust_spread", f"""SELECT l_orderkey, n, g, {r6('p')} AS p, {r6("least(1.0, min(raw) OVER (PARTITION BY g ORDER BY p DESC NULLS LAST))")}
    AS padj FROM (SELECT *, s.p * count(*) OVER (PARTITION BY g) / count(*) OVER (PARTITION BY g ORDER BY s.p NULLS FIRST) AS raw
    FROM {SPREAD} s)""")(lambda t: O.bh_adjust(spread(t).drop("v"), ["g"], "p", limit=1))
query("A4_stage_summary_spread", f"""SELECT g, count(*) AS rows_in, {r6('avg(v)')} AS mean_v, {r6('quantile_cont(v, 0.25)')} AS q1_v,
    {r6('median(v)')} AS median_v, {r6('median(p)')} AS median_p FROM {SPREAD} s GROUP BY g""")(lambda t: O.summarise(
        spread(t), ["g"], {"q1_v": ("v", 0.25), "median_v": ("v", 0.5), "median_p": ("p", 0.5)},
        [F.count(F.lit(1)).alias("rows_in"), F.avg("v").alias("mean_v")], leaf=1))
query("W7_first_sign", """SELECT project, gene, min_by(CAST(sign(stat) AS INTEGER), ord) AS first_sign FROM diff
    JOIN modes ON method = diff.mode WHERE abs(stat) > 1.0 GROUP BY 1, 2""")(lambda t: O.first_sign(
        project_diff(t), ["project", "gene"], "stat", method_order(F.col("mode")), 1.0))
query("O1_ordered", STAGE)(lambda t: O.ordered(cost.cost_summary(V.throughput(t)), ["category", "mode"]))
query("O2_top_n", f"SELECT SRR_ID, {r6('Q_mean')} AS Q_mean FROM qual ORDER BY qual.Q_mean DESC, SRR_ID LIMIT 6")(
    lambda t: O.top_n(V.quality(t).select("SRR_ID", "Q_mean"), "Q_mean", 6))
query("O3_rank_list", f"SELECT project, mode, gene, pos, n AS n_genes FROM proj_ranked")(lambda t: O.rank_list(
    project_diff(t), ["project", "mode"]).select("project", "mode", "gene", F.col("pos").cast("long").alias("pos"), "n_genes"))

# --- set operations -------------------------------------------------------------------------------------------

query("U1_to_long", " UNION ALL ".join(f"SELECT project_id, SRR_ID, '{c}' AS variable, {r6(c)} AS value FROM qual"
                                       for c in ("Q_mean", "gc_content", "adapter_rate")))(
    lambda t: U.to_long(V.quality(t), ["project_id", "SRR_ID"], ["Q_mean", "gc_content", "adapter_rate"]))
query("U2_set_report", """SELECT project_id, CASE WHEN a AND b THEN 'both' WHEN a THEN 'left' ELSE 'right' END AS side FROM (
    SELECT project_id, bool_or(a) AS a, bool_or(b) AS b FROM (SELECT project_id, TRUE AS a, FALSE AS b FROM filtered UNION ALL
    SELECT project, FALSE, TRUE FROM panel) GROUP BY 1)""")(lambda t: U.set_report(
        P.runs_between(V.queue(t)).select("project_id"), panel(t).select(F.col("project").alias("project_id")), ["project_id"]))
query("U3_append_new", f"""SELECT SRR_ID, method, {r6('rho_gene')} AS rho_gene FROM conc WHERE method IN ('U', 'A', 'P5')
    UNION ALL SELECT SRR_ID, method, {r6('jaccard_deg')} FROM conc WHERE method NOT IN ('U', 'A', 'P5')""")(lambda t: U.append_new(
        V.concordance(t).filter(F.col("method").isin("U", "A", "P5")).select("SRR_ID", "method", "rho_gene"),
        V.concordance(t).select("SRR_ID", "method", F.col("jaccard_deg").alias("rho_gene")), ["SRR_ID", "method"]))
query("U4_funnel", f"SELECT stage, projects, samples FROM ({FUNNEL})")(lambda t: funnel(t).select("stage", "projects", "samples"))

# --- statistics -----------------------------------------------------------------------------------------------


query("ST1_spearman", f"SELECT method, n_pairs, {r6('rho')} AS rho FROM ({spearman_sql('conc', 'method', 'rho_gene', 'dir_concordance')})")(
    lambda t: ST.spearman(V.concordance(t), ["method"], "rho_gene", "dir_concordance"))
query("ST2_jaccard", f"""SELECT SRR_ID, {r6('count(*) FILTER (a AND b) / count(*)')} AS jaccard FROM (
    SELECT SRR_ID, k, bool_or(a) AS a, bool_or(b) AS b FROM (
    SELECT 'SRR' || l_orderkey AS SRR_ID, l_partkey % 20 AS k, l_quantity > 10 AS a, l_quantity <= 30 AS b FROM lineitem)
    GROUP BY 1, 2) GROUP BY 1""")(lambda t: _jaccard(t))


def _jaccard(t):
    rows = t.lineitem.select(F.concat(F.lit("SRR"), F.col("l_orderkey").cast("string")).alias("SRR_ID"),
                             (F.col("l_partkey") % 20).alias("k"), "l_quantity")
    return ST.jaccard(rows.filter("l_quantity > 10"), rows.filter("l_quantity <= 30"), ["SRR_ID"], "k",
                      rows.select("SRR_ID"))


query("ST3_direction_concordance", f"""SELECT project, mode, {r6('avg(CASE WHEN sign(stat) = sg THEN 1.0 ELSE 0.0 END)')} AS dir_concordance
    FROM diff JOIN (SELECT project, gene, sign(stat) AS sg, row_number() OVER (PARTITION BY project ORDER BY abs(stat) DESC, gene) AS rn
    FROM diff WHERE mode = 'U') USING (project, gene) WHERE rn <= 20 AND mode <> 'U' GROUP BY 1, 2""")(lambda t: _direction(t))


def _direction(t):
    diff = project_diff(t)
    top = O.top_abs(diff.filter("mode = 'U'"), ["project"], "stat", 20, "gene").select(
        "project", "gene", F.signum("stat").cast("int").alias("ref_sign"))
    return ST.direction_concordance(diff.filter("mode <> 'U'"), top, ["project", "mode"], ["project"], "gene", "stat")


query("ST4_sign_vote", f"""SELECT project, gene FROM ({vote_sql('(SELECT project, gene, mode AS method, stat FROM diff)', 'project', 'gene', 'stat', 1.0)}
    ) WHERE voted""")(lambda t: ST.sign_vote(project_diff(t), ["project"], "gene", "stat", 1.0, method_order(F.col("mode")),
                                            0.75, "mode"))
E11 = "SELECT * FROM e11_conc"
query("ST5_concordance", E11)(lambda t: _whole(t))


def _whole(t):
    return loso.whole_project(V.counts(t), V.samples(t), V.gene_sets(t), fdr=LOOSE["fdr"], lfc=LOOSE["lfc"])


query("ST6_size_factors", f"""SELECT l.project, l.mode, l.srr, {r6('coalesce(ratio, sf)')} AS size_factor FROM lib l LEFT JOIN (
    SELECT project, mode, srr, exp(median(ln("count") - g)) AS ratio FROM counts
    JOIN (SELECT project, mode, gene, avg(ln("count")) AS g, count(*) AS n FROM counts GROUP BY 1, 2, 3) USING (project, mode, gene)
    JOIN (SELECT project, mode, count(DISTINCT srr) AS n_srr FROM counts GROUP BY 1, 2) USING (project, mode)
    WHERE n = n_srr GROUP BY 1, 2, 3) m ON m.project = l.project AND m.mode = l.mode AND m.srr = l.srr""")(
    lambda t: C.size_factors(settle(V.counts(t), "counts"), ["project", "mode"]).select("project", "mode", "srr", "size_factor"))
query("ST6_library_factors", f"SELECT project, mode, srr, {r6('sf')} AS size_factor FROM lib")(
    lambda t: C.size_factors(V.counts(t), ["project", "mode"], "library"))
query("ST7_diff_test", f"""SELECT project, mode, gene, {r6('log2fc')} AS log2fc, {r6('stat')} AS stat, {r6('pvalue')} AS pvalue,
    {r6('padj')} AS padj FROM diff""")(lambda t: project_diff(t).select("project", "mode", "gene", "log2fc", "stat", "pvalue", "padj"))
@query("ST7_diff_test_shrunk", f"""SELECT project, mode, gene, {r6('log2fc')} AS log2fc, {r6('stat')} AS stat, {r6('pvalue')} AS pvalue,
    {r6('padj')} AS padj FROM diff_shrunk""")
def diff_shrunk(t):
    counts = settle(V.counts(t), "counts")
    design = V.samples(t).join(counts.select("project", "srr", "mode").distinct(), ["project", "srr"])
    return C.diff_test(counts, design, ["project", "mode"], shrink=True).select("project", "mode", "gene", "log2fc", "stat", "pvalue", "padj")


query("ST8_enrich_prerank", f"SELECT project, mode, pathway, {r6('es')} AS es, {r6('nes')} AS nes FROM proj_nes")(
    lambda t: G.enrich_prerank(project_diff(t), V.gene_sets(t), ["project", "mode"]))
PAIR_ROWS = " UNION ALL ".join(f"SELECT project, srr, gene, '{a}-{b}' AS pair, {a} AS x, {b} AS y FROM wide" for a, b in PROFILE_PAIRS)
PROFILE = f"""SELECT project, srr, pair, corr(x, y) AS pear, corr(rx, ry) AS spear,
    sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS cos,
    {("(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END)) / 2")} AS jsd
    FROM (SELECT *, x / sum(x) OVER w AS p, y / sum(y) OVER w AS q,
    rank() OVER (w ORDER BY x) + (count(*) OVER (PARTITION BY project, srr, pair, x) - 1) / 2 AS rx,
    rank() OVER (w ORDER BY y) + (count(*) OVER (PARTITION BY project, srr, pair, y) - 1) / 2 AS ry FROM (
    WITH wide AS (SELECT u.project, s.srr, u.gene, {', '.join(f'coalesce(max(CASE WHEN c.mode = {chr(39)}{m}{chr(39)} THEN c."count" END), 0)::DOUBLE AS {m}' for m in METHODS)}
        FROM (SELECT DISTINCT project, gene FROM counts) u JOIN samples s ON s.project = u.project
        LEFT JOIN counts c ON c.project = u.project AND c.srr = s.srr AND c.gene = u.gene GROUP BY 1, 2, 3)
    {PAIR_ROWS}) WINDOW w AS (PARTITION BY project, srr, pair)) GROUP BY 1, 2, 3"""
query("ST9_profile_similarity", f"SELECT project, srr, pair, {r6('pear')} AS pear, {r6('spear')} AS spear, {r6('cos')} AS cos, "
      f"{r6('jsd')} AS jsd FROM ({PROFILE})")(lambda t: ST.profile_similarity(settle(V.counts(t), "counts")))


def trend_sql(src: str) -> str:
    return f"""WITH src AS ({src}), ends AS (SELECT floor(min(x)) AS lo, ceil(max(x)) AS hi FROM src),
        med AS (SELECT method, greatest(ceil(x - lo), 1)::BIGINT AS bin, median(y) AS m, count(*) AS n FROM src, ends GROUP BY 1, 2),
        grid AS (SELECT DISTINCT method, unnest(range(1, greatest(hi - lo, 1)::BIGINT + 1))::BIGINT AS bin, lo FROM src, ends)
        SELECT g.method, g.bin, {r6('m')} AS spearman, coalesce(n, 0) AS n,
        {r6('lo + g.bin - 0.5 - CASE WHEN g.bin = 1 THEN 0.0005 ELSE 0 END')} AS mid
        FROM grid g LEFT JOIN med ON med.method = g.method AND med.bin = g.bin"""


TREND = trend_sql("SELECT method, terminal_q_mean AS x, rho_gene AS y FROM conc JOIN qfull USING (SRR_ID) WHERE rho_gene IS NOT NULL AND method <> 'U'")
WIDE_COLS = {f"w_{m}": m for m in TRIMMED_METHODS}


def _sensitivity(t):
    wide = V.concordance(t).groupBy(F.col("project").alias("project_id"), "SRR_ID").agg(*[
        F.max(F.when(F.col("method") == m, F.col("rho_gene"))).alias(c) for c, m in WIDE_COLS.items()])
    return quality.quality_sensitivity(quality_full(t), wide, WIDE_COLS)


def _trend(t):
    rows = V.concordance(t).filter("method <> 'U'").join(quality_full(t).select("SRR_ID", "terminal_q_mean"), "SRR_ID")
    return ST.binned_trend(rows.withColumnRenamed("rho_gene", "spearman"), "terminal_q_mean", "spearman", ["method"])


query("ST10_binned_trend", TREND)(_trend)


@query("ST10_binned_trend_wide", f"""WITH src AS (SELECT l_returnflag AS g, CASE WHEN l_orderkey % 997 = 0 THEN 3e9 + l_partkey ELSE 1 + l_partkey % 900 END::DOUBLE AS x,
    l_quantity::DOUBLE AS y FROM lineitem), ends AS (SELECT floor(min(x)) AS lo, ceil(max(x)) AS hi FROM src),
    med AS (SELECT g, greatest(ceil(x - lo), 1)::BIGINT AS bin, median(y) AS m, count(*) AS n FROM src, ends GROUP BY 1, 2),
    nxt AS (SELECT g, bin, lead(bin) OVER (PARTITION BY g ORDER BY bin) AS nb FROM (SELECT g, bin FROM med UNION ALL SELECT DISTINCT g, 0 FROM src)),
    bands AS (SELECT g, bin, bin AS last_bin, m, n FROM med UNION ALL
        SELECT g, bin + 1, coalesce(nb, greatest(hi - lo, 1)::BIGINT + 1) - 1, NULL, 0 FROM nxt, ends WHERE coalesce(nb, greatest(hi - lo, 1)::BIGINT + 1) > bin + 1)
    SELECT g, bin, last_bin, {r6('m')} AS y, n, {r6('lo + (bin + last_bin) / 2.0::DOUBLE - 0.5 - CASE WHEN bin = 1 THEN 0.0005 ELSE 0 END')} AS mid FROM bands, ends""")
def trend_wide(t):
    """A column that holds small numbers and numbers beyond 32 bits: bins of width one, empty ones as runs."""
    rows = t.lineitem.select(F.col("l_returnflag").alias("g"), F.when(F.col("l_orderkey") % 997 == 0, F.lit(3e9) + F.col("l_partkey"))
                             .otherwise(1 + F.col("l_partkey") % 900).cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y"))
    return ST.binned_trend(rows, "x", "y", ["g"], expand=False)


HIST = f"""WITH ends AS (SELECT least(min(Q_mean), min(terminal_q_mean)) - 0.5 AS lo,
    (greatest(max(Q_mean), max(terminal_q_mean)) + 0.5 - (least(min(Q_mean), min(terminal_q_mean)) - 0.5)) / 29.0::DOUBLE AS w FROM qfull),
    vals AS (SELECT 'Q_mean' AS variable, Q_mean AS v FROM qfull UNION ALL SELECT 'terminal_q_mean', terminal_q_mean FROM qfull),
    cnt AS (SELECT variable, least(floor((v - lo) / w), 28)::INTEGER AS bin, count(*) AS n FROM vals, ends GROUP BY 1, 2),
    grid AS (SELECT variable, unnest(range(0, 29))::INTEGER AS bin FROM (VALUES ('Q_mean'), ('terminal_q_mean')) AS g(variable))
    SELECT g.variable, g.bin, {r6('lo + w * g.bin')} AS edge, coalesce(n, 0) AS n FROM grid g LEFT JOIN cnt
    ON cnt.variable = g.variable AND cnt.bin = g.bin CROSS JOIN ends"""
query("ST11_histogram", HIST)(lambda t: ST.histogram(quality_full(t), ["Q_mean", "terminal_q_mean"]))


def box_sql(src: str, by: str, y: str) -> str:
    """Box statistics of ``y`` per ``by`` of ``src``."""
    return f"""SELECT {by}, count(*) AS n, {r6('any_value(q1)')} AS q1, {r6('any_value(md)')} AS median, {r6('any_value(q3)')} AS q3,
        {r6(f'min({y}) FILTER ({y} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_lo,
        {r6(f'max({y}) FILTER ({y} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_hi,
        count(*) FILTER ({y} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
        FROM {src} JOIN (SELECT {by}, quantile_cont({y}, 0.25) AS q1, median({y}) AS md, quantile_cont({y}, 0.75) AS q3
        FROM {src} GROUP BY {by}) USING ({by}) WHERE {y} IS NOT NULL GROUP BY {by}"""


query("ST12_box_stats", box_sql("conc", "method", "rho_pathway"))(lambda t: A.box_stats(V.concordance(t), ["method"], "rho_pathway"))
MI = " UNION ALL ".join(f"""SELECT '{f}' AS feature, {r6('sum(n / tot * ln(n * tot / (nb * nl)))')} AS mutual_information FROM (
    SELECT n, sum(n) OVER () AS tot, sum(n) OVER (PARTITION BY bin) AS nb, sum(n) OVER (PARTITION BY lab) AS nl FROM (
    SELECT bin, lab, count(*) AS n FROM (SELECT {' + '.join(f'CASE WHEN {f} > e[{i}] THEN 1 ELSE 0 END' for i in range(1, 8))} AS bin,
    benefits_from_trimming AS lab FROM evaluation, (SELECT quantile_cont({f}, [{', '.join(str(i / 8) for i in range(1, 8))}]) AS e FROM evaluation))
    GROUP BY 1, 2))""" for f in QC_FEATURES)
query("ST13_mutual_information", MI)(lambda t: qcmodel.feature_scores(evaluation(t)))


def psi_sql(x: str) -> str:
    """Digamma of a positive number."""
    x, one = f"({x})::DOUBLE", "1.0::DOUBLE"
    f = f"({one} / (({x} + 6) * ({x} + 6)))"
    rest = " - ".join(f"{one} / ({x} + {i})" for i in range(6))
    return f"(ln({x} + 6) - {one} / (2 * ({x} + 6)) - {f} * ({one} / 12 - {f} * ({one} / 120 - {f} / 252)) - {rest})"


def nearest_sql(feature: str) -> str:
    """Mutual information of one feature with the benefit label from its three nearest neighbours."""
    near = ", ".join(f"abs(v - {side}(v, {d}) OVER w)" for side in ("lag", "lead") for d in (1, 2, 3))
    return f"""SELECT '{feature}' AS feature, {r6(f"greatest(0, {psi_sql('count(*)')} + avg({psi_sql('k')}) - avg({psi_sql('nc')}) - avg({psi_sql('m')}))")} AS mutual_information
        FROM (WITH p AS (SELECT benefits_from_trimming AS lab, {feature}::DOUBLE AS v, count(*) OVER (PARTITION BY benefits_from_trimming) AS nc FROM evaluation
            WHERE {' AND '.join(f'{f} IS NOT NULL' for f in QC_FEATURES)}),
        q AS (SELECT *, least(3, nc - 1) AS k, list_sort(list_filter([{near}], lambda d: d IS NOT NULL)) AS ds FROM p WHERE nc > 1
            WINDOW w AS (PARTITION BY lab ORDER BY v)),
        r AS (SELECT *, ds[k] AS r, v - ds[k] AS low, v + ds[k] AS high FROM q),
        c AS (SELECT v AS at, sum(count(*)) OVER (ORDER BY v) AS upto FROM p WHERE nc > 1 GROUP BY v)
        SELECT r.k, r.nc, CASE WHEN r.r > 0 THEN coalesce(hl.upto, 0) - coalesce(le.upto, 0) ELSE coalesce(he.upto, 0) - coalesce(ll.upto, 0) END AS m
        FROM r ASOF LEFT JOIN c hl ON r.high > hl.at ASOF LEFT JOIN c he ON r.high >= he.at
        ASOF LEFT JOIN c le ON r.low >= le.at ASOF LEFT JOIN c ll ON r.low > ll.at)"""


query("ST13_nearest_information", " UNION ALL ".join(nearest_sql(f) for f in QC_FEATURES))(
    lambda t: ST.nearest_information(evaluation(t), list(QC_FEATURES), "benefits_from_trimming"))
CLS_COLS = ", ".join([f"{r6(f'{m}_delta_path')} AS {m}_delta_path" for m in TRIMMED_METHODS] + [f"{m}_class" for m in TRIMMED_METHODS])
query("ST14_classify_trimming", f"SELECT project_id, SRR_ID, {CLS_COLS}, t_star FROM cls")(classes)


@query("ST15_qc_forest", f"""SELECT True_t_star, count(*) AS n_samples, 1::BIGINT AS most_predictions, true AS known_labels
    FROM (SELECT c.t_star AS True_t_star FROM qual q JOIN cls c USING (SRR_ID)
    WHERE c.t_star IS NOT NULL AND {' AND '.join(f'q.{f} IS NOT NULL' for f in QC_FEATURES)}) GROUP BY 1""")
def forest(t):
    """What holds for any forest: every complete sample is predicted once, with its true label, by a known label."""
    out = settle(qcmodel.qc_forest(_forest_input(t)), "forest")
    labels = settle(out.select(F.col("True_t_star").alias("_label")).distinct(), "labels")
    per = out.groupBy("project_id", "SRR_ID", "True_t_star", "Predicted_t_star").agg(F.count(F.lit(1)).alias("_times"))
    known = per.join(labels, F.col("Predicted_t_star") == F.col("_label"), "left")
    return known.groupBy("True_t_star").agg(F.sum("_times").alias("n_samples"), F.max("_times").alias("most_predictions"),
                                            F.min(F.col("_label").isNotNull()).alias("known_labels"))


def _forest_input(t):
    """Features with the called method; fifty groups of samples, so that folds are even."""
    label = classes(t).select("SRR_ID", "t_star")
    part = F.concat(F.lit("G"), (F.substring("SRR_ID", 4, 20).cast("long") % 50).cast("string"))
    return V.quality(t).drop("project_id").join(label, "SRR_ID").withColumn("project_id", part)


# --- end-to-end jobs ------------------------------------------------------------------------------------------

query("E1_loso", "SELECT * FROM e1_conc")(lambda t: loso.loso(
    V.counts(t), V.samples(t), V.gene_sets(t), fdr=LOOSE["fdr"], lfc=LOOSE["lfc"], gene_z=LOOSE["gene_z"]))


@query("E1_loso_conditions", "SELECT * FROM e1_conc_c3")
def loso_conditions(t):
    """Three conditions, of which two are contrasted; samples of the third are targets like any other."""
    return loso.loso(V.counts(t), V.samples_of_three(t), V.gene_sets(t), fdr=LOOSE["fdr"], lfc=LOOSE["lfc"], gene_z=LOOSE["gene_z"])


@query("E1_loso_samples", """SELECT BioProject AS project, SRR_ID AS srr, condition FROM annotation
    WHERE (exclude IS NULL OR exclude = '') AND TRY_CAST("group" AS INTEGER) > 0""")
def loso_samples(t):
    return loso.loso_samples(annotation(t))


@query("E12_skip_ledger", """WITH t AS (SELECT f.project, f.srr, f.mode, s.condition FROM (SELECT DISTINCT project, srr, mode FROM counts WHERE srr <> 'S3' OR mode <> 'P20') f
    JOIN (SELECT * FROM samples WHERE project <> 'P2' OR srr IN ('S1', 'S2', 'S12')) s USING (project, srr)),
    a AS (SELECT project, srr, condition FROM t WHERE mode = 'U'),
    k AS (SELECT project, count(*) AS n, count(*) FILTER (condition = 'control') AS c, count(*) FILTER (condition = 'treatment') AS r FROM a GROUP BY 1)
    SELECT a.project, a.srr, 'target' AS stage, NULL AS method, 'too few samples' AS reason, n AS n_samples FROM a JOIN k USING (project) WHERE n < 4
    UNION ALL SELECT a.project, a.srr, 'candidate', m.method, 'no count file', n - 1 FROM a JOIN k USING (project), modes m
    WHERE NOT EXISTS (FROM t WHERE t.project = a.project AND t.srr = a.srr AND t.mode = m.method)
        AND least(c - (a.condition = 'control')::INT, r - (a.condition = 'treatment')::INT) >= 3""")
def skip_ledger(t):
    """A project of three samples, and a sample without one of its files."""
    counts = V.counts(t).filter("srr <> 'S3' or mode <> 'P20'")
    samples = V.samples(t).filter("project <> 'P2' or srr in ('S1', 'S2', 'S12')")
    return loso.loso_skips(settle(counts, "counts"), samples).select("project", "srr", "stage", "method", "reason", "n_samples")


@query("E12_resume", "SELECT * FROM e1_conc")
def resume(t):
    """A run cut short and taken up again: half of the targets are left of it, what its records and its ledger of skipped
    tests leave open is computed."""
    counts, samples, sets = (settle(view(t), "input") for view in (V.counts, V.samples, V.gene_sets))
    limits = {"fdr": LOOSE["fdr"], "lfc": LOOSE["lfc"], "gene_z": LOOSE["gene_z"]}
    early = samples.filter(F.pmod(F.xxhash64("project", "srr"), F.lit(2)) == 0)
    done = settle(loso.loso(counts, samples, sets, targets=early, **limits), "done")
    left = loso.pending(samples, done, loso.loso_skips(counts, samples, early))
    return done.unionByName(loso.loso(counts, samples, sets, targets=left, **limits))


query("E2_cohort_funnel", LOSS)(funnel)
query("E2_count_issues", """SELECT issue, expected, found, expected - found AS difference FROM (
    SELECT 'runs queried against id files' AS issue, (SELECT CAST(sum(n_runs) AS BIGINT) FROM filtered) AS expected,
        (SELECT CAST(sum(n_files) AS BIGINT) FROM filtered JOIN n_files USING (project_id)) AS found
    UNION ALL SELECT 'runs queried against queue', (SELECT CAST(sum(n_runs) AS BIGINT) FROM filtered), (SELECT count(*) FROM queue)
    UNION ALL SELECT 'eligible against evaluated samples', (SELECT CAST(sum(eligible_srrs) AS BIGINT) FROM panel WHERE included = 'Yes'),
        (SELECT count(DISTINCT SRR_ID) FROM conc))""")(
    lambda t: cohort.count_issues(filtered(t), V.queue(t), panel(t), V.concordance(t)))
query("E3_cost_by_stage", STAGE)(lambda t: cost.cost_summary(V.throughput(t)))
query("E3_stage_boxes", box_sql("(SELECT CASE WHEN coalesce(mode, '') = '' THEN category ELSE category || ':' || mode END AS label, "
                               "core_hours_per_gb FROM cost)", "label", "core_hours_per_gb"))(lambda t: cost.stage_boxes(V.throughput(t)))
query("E3_endpoints", ENDPOINT)(lambda t: cost.endpoints(fetches(t)))
query("E4_quality_distribution", f"""SELECT project_id, SRR_ID, {r6('Q_mean')} AS Q_mean, {r6('terminal_q_mean')} AS terminal_q_mean,
    {r6('tail_quality_decay')} AS tail_quality_decay FROM qfull""")(
    lambda t: quality_full(t).select("project_id", "SRR_ID", "Q_mean", "terminal_q_mean", "tail_quality_decay"))
STABILITY = f"WITH profile AS ({PROFILE}) " + " UNION ALL ".join(
    f"""SELECT pair AS method, '{k}' AS measure, {r6(f'avg({k})')} AS mean, {r6(f'stddev_samp({k})')} AS std, {r6(f'median({k})')} AS median,
    {r6(f'min({k})')} AS min, {r6(f'max({k})')} AS max, count({k}) AS n FROM profile GROUP BY pair"""
    for k in ("pear", "spear", "cos", "jsd"))
query("E5_profile_stability", STABILITY)(lambda t: _stability(t))


def _stability(t):
    table = ST.profile_similarity(settle(V.counts(t), "counts"))
    names = {f"{a}-{b}": f"{a}_{b}" for a, b in PROFILE_PAIRS}
    wide = table.groupBy("project", "srr").agg(*[
        F.max(F.when(F.col("pair") == p, F.col(k))).alias(f"{n}_{k}") for p, n in names.items() for k in ("pear", "spear", "cos", "jsd")])
    return A.describe_long(settle(wide, "profiles"), {f"{n}_{k}": (p, k) for p, n in names.items() for k in ("pear", "spear", "cos", "jsd")})


query("E6_read_survival", f"SELECT *, {r6('100 - median_surviving_pct')} AS median_read_loss FROM ({SURVIVAL})")(
    lambda t: P.read_loss(A.read_survival(trim(t)), "median_surviving_pct", "median_read_loss"))
query("E6_survival_boxes", box_sql("trim", "mode", "surviving_pct"))(lambda t: A.box_stats(trim(t), ["mode"], "surviving_pct"))
query("E7_quality_sensitivity", TREND)(_sensitivity)
query("E8_gene_concordance", GENE)(lambda t: A.gene_summary(V.concordance(t)))
query("E8_pathway_concordance", PATHWAY)(lambda t: A.pathway_summary(V.concordance(t)))
query("E9_outliers", f"""SELECT project_id, SRR_ID, t_star, {r6('preferred_delta_path')} AS preferred_delta_path,
    {r6('preferred_read_loss_pct')} AS preferred_read_loss_pct FROM outliers""")(
    lambda t: classify.outlier_table(classes(t), trim(t), "row_no"))
query("E9_headline", HEADLINE)(lambda t: classify.headline(classes(t), trim(t), "row_no"))
query("E10_accuracy", ACCURACY)(lambda t: A.accuracy(evaluation(t), "True_t_star", "Predicted_t_star"))
query("E10_top_features", f"SELECT * FROM ({MI}) ORDER BY mutual_information DESC, feature LIMIT 6")(
    lambda t: qcmodel.top_features(qcmodel.feature_scores(evaluation(t)), 6))
BENEFIT = " UNION ALL ".join(f"""SELECT CASE WHEN benefits_from_trimming = 1 THEN 'beneficial' ELSE 'untrimmed-optimal' END || '|{f}' AS k,
    {f}::DOUBLE AS v FROM evaluation""" for f in ("Q_mean", "gc_content"))
query("E10_feature_boxes", f"""SELECT split_part(k, '|', 1) AS benefit_label, split_part(k, '|', 2) AS feature, * EXCLUDE (k)
    FROM ({box_sql(f'({BENEFIT})', 'k', 'v')})""")(lambda t: qcmodel.feature_boxes(evaluation(t), ["Q_mean", "gc_content"]))
query("E11_whole_project", E11)(_whole)
query("E12_pending", """SELECT DISTINCT 'P' || (l_orderkey % 3) AS project, 'SRR' || l_orderkey AS srr FROM lineitem
    WHERE l_orderkey % 10 <> 0 AND l_orderkey % 4 <> 0""")(lambda t: _pending(t))


def _pending(t):
    """Orders as targets: a tenth dropped by a reference skip, a quarter finished by results and candidate skips."""
    k = F.col("l_orderkey")
    keys = settle(V.lines(t).distinct().select(
        k, F.concat(F.lit("P"), (k % 3).cast("string")).alias("project"), F.concat(F.lit("SRR"), k.cast("string")).alias("srr")), "targets")
    done = keys.withColumn("method", F.explode(F.array(*[F.lit(m) for m in METHODS]))).filter(
        (k % 4 == 0) | (F.col("method") != "P35")).filter((F.col("method") != "P20") | (k % 8 != 0))
    drop = keys.filter(k % 10 == 0).select("project", "srr", F.lit("reference").alias("stage"), F.lit("U").alias("method"))
    skip = keys.filter(k % 8 == 0).select("project", "srr", F.lit("candidate").alias("stage"), F.lit("P20").alias("method"))
    return loso.pending(keys.select("project", "srr"), done.select("project", "srr", "method"), drop.unionByName(skip))


# --- streaming ------------------------------------------------------------------------------------------------

@query("T1_ingest_results", f"""SELECT project, SRR_ID, method, {r6("CASE WHEN method IN ('U', 'A', 'P5') THEN rho_gene ELSE jaccard_deg END")}
    AS rho_gene FROM conc""")
def t1(t):
    root = shared_folder(t.spark, "ingest")
    conc = settle(V.concordance(t), "concordance")
    src, out, ckpt = (f"{root}/{d}" for d in ("src", "out", "ckpt"))
    W.write_results(conc.filter(F.col("method").isin("U", "A", "P5")), f"{src}/first")
    ingest.ingest_results(t.spark, src, out, ckpt)
    W.write_results(conc.withColumn("rho_gene", F.col("jaccard_deg")), f"{src}/second")
    ingest.ingest_results(t.spark, src, out, ckpt)
    return ingest.ingested(t.spark, out).select("project", "SRR_ID", "method", "rho_gene")


@query("T2_live_endpoint_summary", f"""SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS window_start_us, endpoint,
    count(*) AS attempts, count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status = 'failed') AS failed,
    {r6('median(mb_per_sec)')} AS median_mb_per_sec, epoch_us(time_bucket(INTERVAL 6 HOUR, any_value(ts))) + 21600000000
        <= (SELECT max(started_us) FROM rate) - 600000000 AS closed
    FROM (SELECT *, make_timestamp(started_us) AS ts FROM rate) GROUP BY 1, 2""")
def t2(t):
    root = shared_folder(t.spark, "live")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/event[s].parquet")
    live = V.Tables(t.spark, t.folder)
    live.__dict__["events"] = stream
    ingest.run_available(ingest.live_digit_counts(V.fetch_attempts(live), "6 hours", "10 minutes"), f"{root}/out", f"{root}/ckpt")
    return ingest.live_endpoint_summary(t.spark.read.parquet(f"{root}/out"), V.fetch_attempts(t), "6 hours", "10 minutes").select(
        F.unix_micros("window_start").alias("window_start_us"), "endpoint", "attempts", "successes", "failed",
        "median_mb_per_sec", "closed")

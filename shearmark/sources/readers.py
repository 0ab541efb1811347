"""Text-file sources.  Keys that only exist in file names come from the file path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import percent, sample_id, to_double
from ..runtime import join_groups, settle
from ..schemas import ALIGN_STATS, PROJECT_METADATA, STAGE_TIMINGS, TRIM_STATS

PATH = "_metadata.file_path"


def _path_part(pattern: str, group: int = 1) -> Column:
    """A piece of the file path; accepts both ``<value>`` and ``<key>=<value>`` folders."""
    return F.regexp_extract(F.col(PATH), pattern, group)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Delimited table with a header: comma for .csv, tab otherwise; NA and blank are null."""
    sep = "," if path.rstrip("/").endswith(".csv") else "\t"
    return (spark.read.schema(schema).option("sep", sep).option("header", True)
            .option("nullValue", "NA").option("escape", '"').csv(path))


def read_headerless(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Tab-separated (key, whole number) rows without a header; rows without a key are dropped."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("sep", "\t").csv(path)
    return raw.dropna(subset=[names[0]]).withColumn(names[1], F.col(names[1]).cast("int"))


def read_id_lists(spark: SparkSession, path: str, prefix: str = "SRR") -> DataFrame:
    """Accessions of per-project id files: trimmed lines with the prefix, project from the file name."""
    # Fixed pattern: <project>_SRR_IDs.txt
    raw = spark.read.text(path, recursiveFileLookup=True).select(
        _path_part(r"([^/=]+)_SRR_IDs\.txt").alias("project_id"), F.trim("value").alias("srr_id"))
    return raw.filter((F.col("project_id") != "") & F.col("srr_id").startswith(prefix))


def id_list_sizes(ids: DataFrame) -> DataFrame:
    return ids.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_files"))


def read_feature_counts(spark: SparkSession, root: str) -> DataFrame:
    """Long gene counts (project, srr, mode, gene, count) of all count files below ``root``, in one job.

    Comment and header lines are skipped, a row needs seven fields.  Files
    are gzip or plain.
    """
    names = ["gene", "chr", "start", "end", "strand", "length", "n"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = (spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("quote", "")
           .option("recursiveFileLookup", True).csv(root))
    # Fixed patterns: untrmd_<srr>_fC.txt[.gz] and <srr>_trimmomatic_<mode>_fC.txt[.gz]
    name = r"([^/=]+)/(?:[^/=]+=)?(?:untrmd_([^/=]+?)|([^/=]+?)_trimmomatic_([^/_]+))_fC\.txt"
    suffix = _path_part(name, 4)
    keyed = raw.select(
        _path_part(name, 1).alias("project"),
        F.coalesce(F.nullif(_path_part(name, 2), F.lit("")), _path_part(name, 3)).alias("srr"),
        F.when(suffix == "", "U").when(suffix == "adapter", "A").otherwise(suffix).alias("mode"),
        "gene", F.col("n").try_cast("long").alias("count"))
    return keyed.filter(F.col("project").isNotNull() & (F.col("project") != "") & (F.col("gene") != "Geneid")
                        & F.col("count").isNotNull())


def read_qc_sections(spark: SparkSession, path: str) -> DataFrame:
    """Per-position mean quality of QC reports: (project_id, SRR_ID, report, pos, mean_q).

    A report begins with a ``##FastQC`` line; a file may hold many, and be split anywhere.  A report alone in a folder
    ``*_fastqc`` is named by it, any other by its ``Filename`` line.  Only the first quality section of a report counts, and
    pos numbers its lines.  What a line belongs to follows from the last marker lines before it: inside a split by a
    window, over the splits of a file by what each of them ends with.
    """
    # Fixed markers: ##FastQC, >>Per base sequence quality ... >>END_MODULE, Filename
    folder, parent = r"([^/=]+)/(?:[^/=]+=)?([^/=]+_fastqc)/", r"([^/=]+)/[^/]*$"
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col(PATH).alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"),
        F.rtrim(F.col("value"), F.lit("\r")).alias("value"))
    head, quality = F.col("value").startswith("##FastQC"), F.col("value").startswith(">>Per base sequence quality")
    name = F.when(F.col("value").startswith("Filename\t"), F.split("value", "\t")[1])
    lines = settle(raw.filter((F.col("value") != "") & (head | ~F.col("value").startswith("#"))).select(
        "path", "split", "line", head.cast("int").alias("head"), quality.cast("int").alias("quality"), name.alias("name"),
        F.col("value").startswith(">>").alias("marker"),
        F.when(~F.col("value").startswith(">>") & ~head, F.get(F.split("value", "\t"), F.lit(1))).alias("cell")), "qc_lines")

    # inside a split: reports begun, quality sections since the last of them, and whether the last marker opened one
    upto = Window.partitionBy("path", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inner = lines.withColumn("reports", F.sum("head").over(upto)).withColumn("open", F.last(
        F.when(F.col("marker") | (F.col("head") == 1), F.col("quality") == 1), ignorenulls=True).over(upto))
    since = Window.partitionBy("path", "split", "reports").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inner = settle(inner.withColumn("sections", F.sum("quality").over(since)), "qc_split_lines")
    # one row a split: what it hands on to the next
    ends = inner.groupBy("path", "split").agg(
        F.max("reports").alias("reports"), F.max_by("open", F.when(F.col("open").isNotNull(), F.col("line"))).alias("open"),
        F.max_by("sections", "line").alias("sections"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_r", F.coalesce(F.sum("reports").over(before), F.lit(0)))
    # sections since the report that is open at the split's start: those of the splits since the one that began it
    ends = ends.withColumn("_began", F.sum((F.col("reports") > 0).cast("int")).over(
        Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)))
    piece = Window.partitionBy("path", "_began").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_upto", F.sum("sections").over(piece))
    last = Window.partitionBy("path").orderBy("split")
    ends = settle(ends.select("path", "split", "_r", F.coalesce(F.lag("_upto").over(last), F.lit(0)).alias("_s"),
                              F.last("open", ignorenulls=True).over(before).alias("_o")), "qc_splits")
    known = join_groups(inner, ends, ["path", "split"])
    known = known.select(
        "path", "split", "line", "name", "cell", (F.col("reports") + F.col("_r")).alias("number"),
        (F.col("sections") + F.when(F.col("reports") == 0, F.col("_s")).otherwise(F.lit(0))).alias("section"),
        F.coalesce("open", "_o", F.lit(False)).alias("open"))
    names = known.filter("name is not null").groupBy("path", "number").agg(F.min_by("name", F.struct("split", "line")).alias("name"))
    cells = known.filter((F.col("section") == 1) & F.col("open") & F.col("cell").isNotNull()).drop("name")
    place = F.row_number().over(Window.partitionBy("path", "number").orderBy("split", "line"))  # some hundred lines
    # the patterns run once a report, not once a line
    reports = cells.select("path", "number").distinct().join(names, ["path", "number"], "left")
    alone = F.nullif(F.regexp_extract("path", folder, 2), F.lit(""))
    report = F.coalesce(alone, F.concat(F.regexp_replace("name", r"(\.fastq|\.fq)?(\.gz)?$", ""), F.lit("_fastqc")))
    project = F.coalesce(F.nullif(F.regexp_extract("path", folder, 1), F.lit("")), F.regexp_extract("path", parent, 1))
    reports = settle(reports.select("path", "number", project.alias("project_id"), report.alias("report")).filter("report is not null").withColumn(
        "SRR_ID", sample_id(F.col("report"), F.col("path"))), "qc_reports")
    found = cells.withColumn("pos", place).withColumn("mean_q", to_double(F.col("cell"))).dropna(subset=["mean_q"])
    return found.join(reports, ["path", "number"]).select("project_id", "SRR_ID", "report", "pos", "mean_q")


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """Gene sets of a GMT file, one row per member; an empty description becomes ``na``."""
    f = F.split("value", "\t")
    raw = spark.read.text(path).select(f.alias("f")).filter(F.size("f") >= 3)
    return raw.select(
        F.get("f", F.lit(0)).alias("set_name"),
        F.when(F.get("f", F.lit(1)) == "", "na").otherwise(F.get("f", F.lit(1))).alias("description"),
        F.explode(F.slice("f", F.lit(3), F.size("f"))).alias("gene")).filter(F.col("gene") != "")


def queue_table(df: DataFrame) -> DataFrame:
    """Queue rows as (project_id, srr_id, status, run_status), from any DataFrame source."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in ("project_id", "srr_id", "status", "run_status")])


def fetch_attempts(df: DataFrame) -> DataFrame:
    """Fetch attempts with parsed timestamps."""
    stamps = {c: F.col(c).try_cast("timestamp") for c in ("started_at", "finished_at")}
    return df.withColumns(stamps).withColumn("bytes_downloaded", to_double(F.col("bytes_downloaded")))


def read_project_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Run annotation of a folder of per-project CSV files, project from the file name."""
    raw = (spark.read.schema(PROJECT_METADATA).option("header", True).option("recursiveFileLookup", True)
           .option("escape", '"').csv(path))
    return raw.select(_path_part(r"([^/=]+)\.csv").alias("project"), *PROJECT_METADATA.fieldNames())


def read_stage_timings(spark: SparkSession, path: str) -> DataFrame:
    """Stage seconds per sample, the stage split into category and mode where it has them."""
    raw = (spark.read.schema(STAGE_TIMINGS).option("sep", "\t").option("header", True)
           .option("recursiveFileLookup", True).csv(path))
    # Fixed patterns: <project>/<srr>_timings.tsv, stages <category>_<mode>
    name = r"([^/=]+)/(?:[^/=]+=)?([^/=]+)_timings\.tsv"
    stage = r"^(trim|align|count)_(.*)$"
    return raw.select(_path_part(name, 1).alias("project"), _path_part(name, 2).alias("srr"),
                      F.nullif(F.regexp_extract("stage", stage, 1), F.lit("")).alias("category"),
                      F.nullif(F.regexp_extract("stage", stage, 2), F.lit("")).alias("mode"),
                      "stage", "duration_sec")


def read_trim_stats(spark: SparkSession, path: str) -> DataFrame:
    """Flattened trimming statistics with the column names the summaries use."""
    raw = (spark.read.schema(TRIM_STATS).option("sep", "\t").option("header", True)
           .option("recursiveFileLookup", True).option("nullValue", "NA").csv(path))
    return raw.withColumnRenamed("srr_id", "SRR_ID")


def read_align_stats(spark: SparkSession, path: str) -> DataFrame:
    """Flattened alignment statistics, the overall rate as a number."""
    raw = (spark.read.schema(ALIGN_STATS).option("sep", "\t").option("header", True)
           .option("recursiveFileLookup", True).option("nullValue", "NA").csv(path))
    return (raw.withColumn("overall_alignment_pct", percent(F.col("overall_alignment_rate")))
            .withColumnRenamed("srr_id", "SRR_ID"))

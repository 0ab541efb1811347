"""Incremental result ingestion and the live endpoint summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import transfer_rate
from ..operators.ordering import LEAF_VALUES, first_digit, interpolated, placed, refined
from ..runtime import dealt, join_groups, settle
from ..schemas import CONCORDANCE

KEYS = ["project", "SRR_ID", "method"]
PRUNED_PROJECTS = 1000


def ingest_results(spark: SparkSession, src: str, out: str, checkpoint: str,
                   schema: T.StructType = CONCORDANCE) -> None:
    """Take in all result files that arrived in ``src`` since the last call; the first row of a key wins.

    ``src`` holds what ``write_results`` writes; a file with another header fails.  First is the row of the earliest
    file (by modification time, then path), and inside one file that of the earlier line: splits of a file are ordered by
    where they start, and a task numbers the lines of its split.  Each micro-batch goes into its own folder of ``out``, written in overwrite mode, so a batch replayed after a failure replaces itself.
    Stored rows lie by project, and a batch of few projects reads only theirs.
    """
    values = [c for c in schema.fieldNames() if c not in KEYS]
    stream = (spark.readStream.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", False)
              .option("nullValue", "NA").option("recursiveFileLookup", True).csv(src).select(
                  "*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_path").alias("_path"),
                  F.col("_metadata.file_block_start").alias("_split")))

    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("project").parquet(f"{out}/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        sizes = [(r["project"], r["n"]) for r in batch.groupBy("project").agg(F.count(F.lit(1)).alias("n")).limit(PRUNED_PROJECTS + 1).collect()]
        projects, few = [p for p, _ in sizes], len(sizes) <= PRUNED_PROJECTS
        # dealt by key: few keys come twice, and sums before the shuffle would sort every row once more
        lines = dealt(batch.withColumn("_line", F.monotonically_increasing_id()), KEYS, sum(n for _, n in sizes) if few else batch.count())
        first = lines.groupBy(*KEYS).agg(F.min_by(F.struct(*values), F.struct("_at", "_path", "_split", "_line")).alias("r"))
        rows = first.select(*KEYS, "r.*").select(*schema.fieldNames())
        stored = ingested(spark, out, schema).filter(F.col("batch") < batch_id)
        if few:
            stored = stored.filter(F.col("project").isin([p for p in projects if p is not None]) | F.col("project").isNull())
        known = stored.select(*[F.col(c).alias(f"_{c}") for c in KEYS])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEYS]
        fresh = rows.join(known, same[0] & same[1] & same[2], "left_anti")
        fresh.write.mode("overwrite").partitionBy("project").parquet(f"{out}/batch={batch_id}")

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def ingested(spark: SparkSession, out: str, schema: T.StructType = CONCORDANCE) -> DataFrame:
    """Everything ingested so far, with the number of the batch that brought it."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(full).option("basePath", out).parquet(out).select(*full.fieldNames())


def live_digit_counts(stream: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Attempts by window, endpoint, status and leading digit of the transfer rate over a stream of fetch attempts.

    Late rows are taken in up to ``delay``.  State holds a count and the range of each digit, so its size follows the
    magnitudes of the rates (64 digits for each doubling), not the number of attempts or of different rates.
    """
    timed = transfer_rate(stream.withColumn("started_at", F.col("started_at").cast("timestamp")))
    return (timed.withWatermark("started_at", delay)
            .groupBy(F.window("started_at", window).alias("w"), "endpoint", "status", first_digit(F.col("mb_per_sec")).alias("digit"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("mb_per_sec").alias("lo"), F.max("mb_per_sec").alias("hi"),
                 F.max("started_at").alias("latest"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "endpoint", "status",
                    "digit", "n", "lo", "hi", "latest"))


def run_available(counts: DataFrame, out: str, checkpoint: str) -> None:
    """Drain what the stream has now; every batch writes the counts that changed, open windows included."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def live_endpoint_summary(counts: DataFrame, attempts: DataFrame, window: str = "1 hour", delay: str = "10 minutes",
                          leaf: int = LEAF_VALUES) -> DataFrame:
    """Window summary from the written counts, with exact medians; ``closed`` once the watermark has passed the window.

    The counts say which digit holds a window's median; where that is more than one value, the rates of this digit are
    read from ``attempts``, the table the stream has taken in.  A row that the stream refused as late must not be in it.
    """
    keys = ["window_start", "window_end", "endpoint", "status", "digit"]
    now = settle(counts.groupBy(*keys).agg(F.max_by(F.struct("n", "lo", "hi"), "batch").alias("c"), F.max("latest").alias("latest"))
                 .select(*keys, "c.*", "latest"), "live")
    seen = counts.agg((F.max("latest") - F.expr(f"interval {delay}")).alias("_mark"))  # one row
    group = ["window_start", "endpoint"]
    digits = now.filter("digit is not null").groupBy(*group, F.col("digit").alias("_d")).agg(
        F.sum("n").alias("_n"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi")).withColumn("_col", F.lit(0))
    timed = transfer_rate(attempts.withColumn("started_at", F.col("started_at").cast("timestamp")))
    rates = timed.select(F.window("started_at", window)["start"].alias("window_start"), "endpoint", F.lit(0).alias("_col"),
                         F.col("mb_per_sec").alias("_v")).filter("_v is not null")
    found, _ = refined(rates, group, placed(digits, Window.partitionBy(*group, "_col"), [(0, 0.5)]), leaf)
    medians = settle(interpolated(found, group, ["median_mb_per_sec"]), "medians")
    out = now.groupBy("window_start", "window_end", "endpoint").agg(
        F.sum("n").alias("attempts"), F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("n"))), F.lit(0)).alias("successes"),
        F.coalesce(F.sum(F.when(F.col("status") == "failed", F.col("n"))), F.lit(0)).alias("failed"))
    out = join_groups(out, medians, group, "left")
    return out.join(F.broadcast(seen)).withColumn("closed", F.col("window_end") <= F.col("_mark")).drop("_mark")

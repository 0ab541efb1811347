"""Result sinks: tab-separated text, NA for null, six decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CONCORDANCE


def as_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All columns as text in the given order, doubles with six decimals, NaN as null."""
    cols = columns or df.columns
    doubles = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}

    def cell(c):
        x = F.col(c)
        if c not in doubles:
            return x.cast("string").alias(c)
        x = x.cast("double")
        # decimals round like the format and take half its time; what keeps a minus sign at zero, or is too large, goes to it
        plain = (F.abs(x) < 1e11) & ((x > 0) | (x <= -1e-6))
        text = F.when(plain, x.cast("decimal(18,6)").cast("string")).when(
            (x == 0) & (x.cast("string") == "0.0"), "0.000000").otherwise(F.format_string("%.6f", x))
        return F.when(x.isNotNull() & ~F.isnan(x), text).alias(c)

    return df.select(*[cell(c) for c in cols])


def write_results(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "errorifexists",
                  by: str = "project", files: int = 4) -> None:
    """Write one folder of TSV files per project, by the job commit protocol.

    The project is a column of the files and names the folder (``in_<by>=``).  A project is written by at most
    ``files`` tasks, however many tasks hold its rows.
    """
    text = as_text(df, columns).withColumn(f"in_{by}", F.col(by))
    part = F.pmod(F.xxhash64(*[c for c in text.columns if c != f"in_{by}"]), F.lit(files))
    (text.withColumn("_part", part).repartition(f"in_{by}", "_part").drop("_part").write.mode(mode).partitionBy(f"in_{by}")
     .option("sep", "\t").option("header", True).option("nullValue", "NA").option("emptyValue", "").csv(path))


def read_results(spark: SparkSession, path: str, schema: T.StructType = CONCORDANCE) -> DataFrame:
    """Read what ``write_results`` wrote; a file whose header is another fails."""
    return (spark.read.schema(schema).option("sep", "\t").option("header", True).option("nullValue", "NA")
            .option("enforceSchema", False).option("recursiveFileLookup", True).csv(path))


def combine_results(spark: SparkSession, path: str, schema: T.StructType = CONCORDANCE, out: str | None = None) -> DataFrame:
    """All per-project results in project order; written as one sorted table of TSV files where ``out`` is given."""
    keys = [c for c in ("project", "SRR_ID", "method") if c in schema.fieldNames()]
    table = read_results(spark, path, schema).orderBy(*keys)
    if out:
        (as_text(table).write.option("sep", "\t").option("header", True).option("nullValue", "NA").option("emptyValue", "").csv(out))
    return table

"""Set operations and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, id_cols: list[str], cols: dict[str, str] | list[str],
            name: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long in one pass; ``cols`` may map a column to the label it becomes."""
    labels = cols if isinstance(cols, dict) else {c: c for c in cols}
    pairs = F.array(*[F.struct(F.lit(v).alias(name), F.col(c).cast("double").alias(value))
                      for c, v in labels.items()])
    return df.select(*id_cols, F.explode(pairs).alias("_e")).select(*id_cols, "_e.*")


def set_report(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Every distinct key of either side with its side: both, left or right."""
    sides = (a.select(*on).withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0))
             .unionByName(b.select(*on).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))))
    flags = sides.groupBy(*on).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    side = F.when((F.col("_a") == 1) & (F.col("_b") == 1), "both").when(F.col("_a") == 1, "left").otherwise("right")
    return flags.select(*on, side.alias("side"))


def append_new(existing: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """``existing`` plus the rows of ``new`` whose key it does not hold yet."""
    fresh = new.join(existing.select(*on).distinct(), on, "left_anti")
    return existing.unionByName(fresh)


def funnel(stages: list[DataFrame]) -> DataFrame:
    """Stack one-row stage results (stage, projects, samples)."""
    return reduce(DataFrame.unionByName, stages)

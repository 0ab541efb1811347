"""Can QC features predict the preferred method?  Evaluation and an out-of-fold forest."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import benefit_label
from ..operators.joins import left_join
from ..operators.ordering import top_n
from ..operators.stats import mutual_information
from ..operators.summaries import box_stats
from ..runtime import settle
from ..schemas import QC_FEATURES

SAMPLE = ["SRR_ID", "project_id"]


def evaluation_table(pred: DataFrame, quality: DataFrame, cls: DataFrame) -> DataFrame:
    """Predictions with their QC features, classification and benefit label."""
    merged = left_join(left_join(pred, quality, SAMPLE), cls.select(*SAMPLE, "t_star"), SAMPLE)
    return benefit_label(merged)


def feature_scores(evaluation: DataFrame, features=QC_FEATURES, bins: int = 8) -> DataFrame:
    return mutual_information(evaluation, list(features), "benefits_from_trimming", bins)


def feature_boxes(evaluation: DataFrame, features: list[str]) -> DataFrame:
    """Box statistics of each feature by benefit."""
    label = F.when(F.col("benefits_from_trimming") == 1, "beneficial").otherwise("untrimmed-optimal")
    long = evaluation.select(label.alias("benefit_label"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("e")
    ).select("benefit_label", "e.*")
    return box_stats(long, ["benefit_label", "feature"], "value")


def top_features(scores: DataFrame, n: int = 6) -> DataFrame:
    return top_n(scores, "mutual_information", n)


def qc_forest(df: DataFrame, features=QC_FEATURES, label: str = "t_star", folds: int = 5, seed: int = 42,
              trees: int = 20, group: str = "project_id", parallelism: int = 2) -> DataFrame:
    """Out-of-fold random-forest predictions of the preferred method.

    Whole groups share a fold (by hash), so a sample is never predicted by a
    model that saw its project.  So many folds are fitted at a time as ``parallelism`` says, with the same forests as one
    by one: a pass of a fit has a task more than the cluster has cores, and the cores that wait for the last one serve
    the other fold.  Each fold being fitted keeps its rows in memory, what has no room on disk.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    key = F.pmod(F.xxhash64(F.col(group)), F.lit(folds)).cast("int")
    clean = settle(df.dropna(subset=[*features, label]).withColumn("fold", key), "forest_input")
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(clean)
    indexed = indexer.transform(clean)

    def predicted(k):
        train, test = indexed.filter(F.col("fold") != k), indexed.filter(F.col("fold") == k)
        if train.isEmpty() or test.isEmpty():
            return None
        stages = [VectorAssembler(inputCols=list(features), outputCol="_x"),
                  RandomForestClassifier(featuresCol="_x", labelCol="_y", predictionCol="_p", numTrees=trees, seed=seed),
                  IndexToString(inputCol="_p", outputCol="Predicted_t_star", labels=indexer.labels)]
        return Pipeline(stages=stages).fit(train).transform(test).select(*SAMPLE, F.col(label).alias("True_t_star"), "Predicted_t_star")

    with ThreadPool(parallelism) as pool:
        inherit = inheritable_thread_target(df.sparkSession)
        found = [pool.apply_async(inherit(lambda k=k: predicted(k))) for k in range(folds)]
        parts = [part for part in (f.get() for f in found) if part is not None]
    if not parts:
        raise ValueError("the forest needs at least two folds with rows")
    return reduce(DataFrame.unionByName, parts)



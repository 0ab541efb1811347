"""A training corpus from raw documents: toxicity, exact and near duplicates, source mix, packing.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written and read again as
the next stage's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shearmark.llm import exact_dedup, mixing, packing, simhash, toxicity
from shearmark.runtime import discard, recording, settle

_left: list[DataFrame] = []


def tidy(stage):
    """Discard what the stage before has settled: its result is written by now and read again as ``docs``.

    Where ``docs`` still reads one of those tables, all of them stay.
    """
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        if not any(t.settled_path.split(":")[-1] in f for t in _left for f in read):
            discard(_left)
        with recording() as made:
            out = stage(spark, docs, sf_dir)
        _left[:] = made
        return out

    return run_stage


@tidy
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not call toxic; null and empty texts stay, an empty table stays empty.

    Rows are judged one by one, so repeated ones share their fate; without toxic or clean labels all stay.
    """
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@tidy
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (white space aside): the longest, then smallest id; null and empty texts are one text."""
    return exact_dedup.deduplicated(docs)


@tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of texts connected by a five-word similarity of 0.8; texts without words are one group."""
    return simhash.near_deduplicated(docs)


@tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate says, at most twice; those without words (null, empty) are drawn alike and add no size."""
    return mixing.mixed_documents(docs)


@tidy
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The placed pieces of all documents, repeats included; a null or empty text is its end id alone."""
    # the workers of earlier stages are still there: small slices
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), slice_bytes=4 << 20, cache_units=100_000)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("SimHash near-dedup", drop_near_copies),
          ("source mix", mix_sources), ("best-fit packing", pack_sequences)]

#: A fitted model, similarity search and tokenization are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; a stage's table goes when the next one's is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        discard(last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of the operators, with production parameters, and their oracle SQL where SQL can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, exact_dedup, mixing, packing, secret_scan, sharding, simhash, substrings, token_counts, token_files, topk,
               toxicity, whitening)

QUERIES, ORACLES = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_best_fit_packing(spark, folder):
    pieces = packing.token_pieces(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query
def op2_exact_dedup(spark, folder):
    return exact_dedup.duplicates(table(spark, folder, "documents")).drop("_row")


ORACLES["op2_exact_dedup"] = exact_dedup.ORACLE


@query
def op3_source_mix(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op3_source_mix"] = mixing.ORACLE


@query
def op4_topk_search(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"))


ORACLES["op4_topk_search"] = topk.ORACLE


@query
def op5_secret_scan(spark, folder):
    return secret_scan.digest(secret_scan.scan(table(spark, folder, "documents")))


@query
def op6_toxicity(spark, folder):
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op7_token_counts(spark, folder):
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_simhash_dedup(spark, folder):
    return simhash.near_groups(table(spark, folder, "documents"))


@query
def op9_token_files(spark, folder):
    out = token_files.write_token_files(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    back = token_files.read_token_files(spark.read.parquet(out))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_sharding(spark, folder):
    shards = [f"shard-{n:03d}" for n in range(64)]
    return sharding.assign_shards(table(spark, folder, "documents"), shards, columns=["doc_id"])


@query
def op11_substring_dedup(spark, folder):
    return substrings.repeated_spans(table(spark, folder, "documents")).drop("spans")


ORACLES["op11_substring_dedup"] = substrings.ORACLE


@query
def op12_collocations(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))


ORACLES["op12_collocations"] = collocations.ORACLE


@query
def op13_embedding_whitening(spark, folder):
    rows = whitening.whiten(table(spark, folder, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))

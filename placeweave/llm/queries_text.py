"""Contract queries over documents: fingerprints, token files, packing, spelling variants, token counts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, fingerprint, packing, pieces, rans, simhash, token_counts, variants


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(common.read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_documents(common.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "token-files")
    rans.write_token_files(common.read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, added_tokens=True)
    found = rans.read_token_files(spark, path)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", rans.ids_crc32("ids").alias("ids_crc32"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2, added_tokens=True)
    return packed.withColumnRenamed("id", "doc_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.read(spark, sf_dir, "documents"), max_bits=2)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_of("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.count_words(common.read(spark, sf_dir, "documents"), least=7, every=31, times=2), least=7, ratio=10)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count_documents(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_fingerprints": op1_fingerprints, "op2_pieces": op2_pieces, "op4_token_files": op4_token_files, "op5_packing": op5_packing, "op10_simhash": op10_simhash,
    "op11_variants": op11_variants, "op12_token_counts": op12_token_counts,
}

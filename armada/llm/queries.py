"""Registered queries of the training-data operators, one ``opN_<name>`` each.

Every query reads the whole ``documents`` or ``embeddings`` table, runs its operator and
derives the digest columns from the operator's real outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.llm.oracle import SQL  # noqa: F401  (part of the registration)
from armada.llm import (filter_audit, licenses, line_quality, neighbours, personal_data, pieces, shards, simhash, spaced_seeds,
                        suffix_dedup, token_counts, token_files, vector_codes)

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
END_ID = 1
TOKEN_LIMIT = 2048
SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def vocabulary_text(name: str) -> str:
    with open(vocabulary(name), encoding="utf-8") as f:
        return f.read()


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that overlap them."""
    return spaced_seeds.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the corpus as token files and read the digests back from them."""
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary_text(WORD_BPE), END_ID)
    return token_files.read_token_files(spark, manifest)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the repeated byte strings."""
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous shards of near equal bytes."""
    placed = shards.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, their number, and whether decoding gives the text back."""
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), vocabulary(PIECE_BPE))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by the compiled transducer."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_text(WORD_BPE), TOKEN_LIMIT)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of the line-first rules for every document."""
    return line_quality.report(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document: matched coverage and spans."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of personal data in every document."""
    return personal_data.find(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of five filters: what each step keeps and removes, by source."""
    return filter_audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth one."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector, and the codebooks' fingerprint."""
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_simhash": op2_simhash,
    "op3_token_files": op3_token_files,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_sharding": op5_sharding,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_license_scan": op9_license_scan,
    "op10_personal_data": op10_personal_data,
    "op11_filter_audit": op11_filter_audit,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_vector_codes": op13_vector_codes,
}



"""Training-data pipeline over ``documents``.

``STAGES`` are (name, function) pairs; each function takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.llm import line_quality, personal_data, pieces, simhash, spaced_seeds, storage
from armada.llm.queries import PIECE_BPE, table, vocabulary


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of a text that may have changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line rules, without the lines that fail."""
    return counted(line_quality.keep_clean(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return spaced_seeds.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return counted(personal_data.masked(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of what the stages before kept."""
    return pieces.encode_pieces(docs, vocabulary(PIECE_BPE))


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", decontaminate),
    ("PII", hide_personal_data),
    ("SentencePiece", encode),
]

# Fingerprints, the random field and piece ids have no SQL form; tests/llm holds
# the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = storage.write_shared(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)

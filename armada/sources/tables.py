"""The given parquet tables and the inputs derived from them.

Every derived input is a deterministic Column expression over the given
tables (md5 of keys where a pseudo-random choice is needed), so Spark and
the SQL oracle compute the same rows and the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armada import config as C
from armada.functions.text import python_list_literal
from armada.functions.vectors import block_sums

# Models whose responses exist in the derived response table, and the
# models of the requested run (one more: it has no responses).
EVAL_MODELS = ["gemma 2B", "llama 3B", "mistral 7B"]
RUN_MODELS = EVAL_MODELS + ["phi 2B"]
# Embeddings are split into train/validation by label, 75 %, seed 1010.
SPLIT_SEED = 1010
TRAIN_SIZE = 0.75


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded questions: labelled documents. ``row_id = doc_id``, task =
    ``source``, prompt = the whole text, answer = quality + 2*toxic (0..3)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, ["doc_id"], "inner").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("task"), F.col("text").alias("prompt"),
        (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("answer"))


def _md5_byte(model_col, key_col):
    h = F.md5(F.concat(model_col, F.lit(":"), key_col.cast("string")))
    return F.conv(F.substring(h, 1, 2), 16, 10).cast("int")


def responses(qs: DataFrame, models=EVAL_MODELS, keep=()) -> DataFrame:
    """Model responses: echo of the prompt plus a continuation chosen by
    ``k = first md5 byte of 'model:row_id'``: k%16 = 0 -> no response (NULL),
    k%16 = 1 -> no letter, else ``' The answer is <chr(65 + k%4)>.'``.
    latency = (k%50 + 1)/100 s. Fan-out is the fixed model list (explode)."""
    m = qs.select("*", F.explode(F.array(*[F.lit(x) for x in models])).alias("model"))
    k = _md5_byte(F.col("model"), F.col("row_id"))
    text = (F.when(k % 16 == 0, F.lit(None).cast("string"))
            .when(k % 16 == 1, F.concat(F.col("prompt"), F.lit(" I cannot tell.")))
            .otherwise(F.concat(F.col("prompt"), F.lit(" The answer is "), F.char(F.lit(65) + k % 4), F.lit("."))))
    return m.select("model", "task", "row_id", "answer", *keep, F.length("prompt").alias("prompt_len"), text.alias("generated_text"),
                    ((k % 50 + 1).cast("double") / 100.0).alias("latency_sec"))


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark questions: question = whole text, choices = its sentences
    (split on '. '), task = registry task ``item_id % 57``."""
    from armada.sources.registry import tasks_frame
    b = table(spark, sf_dir, "benchmark")
    tasks = tasks_frame(spark)
    items = b.select("item_id", F.col("text").alias("question"), F.split("text", r"\. ").alias("choices"),
                     (F.col("item_id") % len(C.TASKS)).cast("int").alias("task_idx"))
    return items.join(F.broadcast(tasks), ["task_idx"], "inner").drop("task_idx")


def question_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question rows as they are stored on disk: choices as a Python list literal."""
    return benchmark_items(spark, sf_dir).withColumn("choices_text", python_list_literal("choices"))


def arm_correct(label, k: int):
    """Correctness of arm k on a context with ``label``: ((label + 3k) % 5) <= k."""
    return (((label + F.lit(3 * k)) % 5) <= k).cast("int")


def contexts(spark: SparkSession, sf_dir: str, cfg=None) -> DataFrame:
    """Router contexts: ``row_id = vec_id``, the 64-d embedding, its label and
    wide per-arm correctness columns (named after the arms)."""
    arms = (cfg.arms if cfg else C.ARMS)
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), "embedding", "label",
                    *[arm_correct(F.col("label"), k).alias(a) for k, a in enumerate(arms)])


def project2(vec):
    """2-d projection of a vector used by the closed-form oracle queries:
    sums of the even- and odd-indexed elements (uses every element)."""
    return block_sums(vec, 2)


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the keyed learners: x = [value / 100], rewards of arms 0 and 1:
    arm k earns 1 when (event_id + k) % 3 = 0."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return ev.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.array((F.col("value") / 100.0).cast("double")).alias("x"),
        F.array(*[F.when((F.col("event_id") + k) % 3 == 0, 1.0).otherwise(0.0) for k in range(2)]).alias("rewards"),
    )

"""Dimension tables: model registry, task registry, arm catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armada import config as C
from armada.functions.text import short_model_name


def models_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.MODEL_REGISTRY, "model string, model_id string")


def tasks_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(C.TASKS)], "task_idx int, task string")


def resolve_models(df: DataFrame, names_col: str, strict: bool = True) -> DataFrame:
    """Split a comma list of model names (no trimming), explode, and look up
    each name's id and short name. An unknown name fails the job when
    ``strict`` (the registry is a fixed 7-row table: broadcast)."""
    spark = df.sparkSession
    ex = df.withColumn("model", F.explode(F.split(F.col(names_col), ",")))
    reg = F.broadcast(models_frame(spark))
    out = ex.join(reg, ["model"], "left")
    if strict:
        out = out.withColumn(
            "model_id",
            F.when(F.col("model_id").isNotNull(), F.col("model_id")).otherwise(
                F.raise_error(F.format_string(C.UNKNOWN_MODEL_ERROR.replace("{}", "%s"), F.col("model")))
                .cast("string")))
    return out.withColumn("model_name", short_model_name("model_id"))

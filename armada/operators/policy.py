"""Outcomes and metrics of a routing policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.operators.ordinal import with_running_sums


def labels_long(df: DataFrame, key: str, arm_cols: Sequence[str]) -> DataFrame:
    """Wide per-arm correctness columns -> ``(key, arm_idx, arm, correct)``."""
    arms = list(arm_cols)
    m = F.create_map(*[x for i, a in enumerate(arms) for x in (F.lit(a), F.lit(i))])
    long = df.unpivot([key], arms, "arm", "correct")
    return long.select(key, m[F.col("arm")].cast("int").alias("arm_idx"), "arm", F.col("correct").cast("int").alias("correct"))


def rewards(labels: DataFrame, arms: DataFrame, p: float) -> DataFrame:
    """``reward = correct - p * price / max(price)`` per (row, arm). ``arms`` is
    the K-row catalogue (broadcast: its size is the number of arms)."""
    from armada.operators.routing import normalised_prices
    a = F.broadcast(normalised_prices(arms).select("arm_idx", "norm_price"))
    return labels.join(a, ["arm_idx"], "inner").withColumn(
        "reward", F.col("correct").cast("double") - F.lit(float(p)) * F.col("norm_price"))


def attach_outcome(decisions: DataFrame, labels: DataFrame, arms: DataFrame, key: str) -> DataFrame:
    """Chosen arm -> its label (equi-join on ``(key, arm_idx)``) and price
    (broadcast K-row catalogue)."""
    lab = labels.select(key, "arm_idx", "correct")
    out = decisions.join(lab, [key, "arm_idx"], "left")
    return out.join(F.broadcast(arms.select("arm_idx", "arm", "price")), ["arm_idx"], "left")


def policy_metrics(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy (correct / all rows), total price and price per 10 000 rows."""
    n = F.count(F.lit(1))
    return outcomes.groupBy(*by).agg(
        n.alias("n"),
        (F.sum(F.coalesce(F.col("correct"), F.lit(0))) / n).alias("accuracy"),
        F.sum("price").alias("total_price"),
        (F.sum("price") / n * F.lit(10000.0)).alias("price_per_10k"),
    )


def arm_mix(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How often each arm was chosen."""
    return outcomes.groupBy(*by, "arm_idx", "arm").agg(F.count(F.lit(1)).alias("n_chosen"))


def progressive_metrics(outcomes: DataFrame, group: Sequence[str], order: Sequence[str],
                        num_partitions: int | None = None) -> DataFrame:
    """Running accuracy and running total price in decision order, per group
    (range-partitioned running sums; no single-task window)."""
    out = with_running_sums(
        outcomes, list(group), list(order),
        {"_rc": F.coalesce(F.col("correct"), F.lit(0)), "running_price": F.col("price")},
        ordinal="step", num_partitions=num_partitions,
    )
    return out.withColumn("running_accuracy", F.col("_rc") / F.col("step")).drop("_rc")

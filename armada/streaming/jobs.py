"""Structured Streaming versions of routing and learning.

T1 ``score_stream``        frozen router over a stream (stateless mapInPandas)
T2 ``learn_by_key_stream`` exact per-key learner with arbitrary state
                           (``applyInPandasWithState``): rows of a key are
                           sorted by order inside each micro-batch, and rows
                           of a later micro-batch are learnt later
T3 ``microbatch_learner``  global learner in ``foreachBatch``: version t of a
                           table of tiles is read, the batch is scored, both
                           are merged into version t+1, and the batch's
                           decisions are written under the batch id (a
                           replayed batch overwrites, never folds twice)
T4 ``running_metrics``     running accuracy and price per run (stateful agg)
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from armada.config import RouterConfig
from armada.operators.online import STAT_SCHEMA, score_and_fold, stage
from armada.operators.routing import ArmModel, score_contexts
from armada.operators.state import STATE_SCHEMA, cold_tiles, merge_tiles, solve_state
from armada.session import fresh_dir, remove_dir


def score_stream(stream: DataFrame, vec: str, model: ArmModel, alpha: float, keep: Sequence[str]) -> DataFrame:
    """T1: choose an arm for every streamed context with a frozen model."""
    return score_contexts(stream, vec, model, alpha, keep=list(keep))


def learn_by_key_stream(stream: DataFrame, key: str, order: Sequence[str], vec: str, rewards: str,
                        cfg: RouterConfig, d: int, keep: Sequence[str] = ()) -> DataFrame:
    """T2: per-key closed loop with the key's (A^-1, b) kept in streaming
    state as packed doubles. A micro-batch's rows of a key (bounded by the
    trigger) are in one task. Output ``key, *keep, arm_idx, ucb, reward`` in append mode."""
    order, keep = list(order), [c for c in keep if c != key]
    k, lam, gamma, alpha = cfg.k, cfg.lam, cfg.gamma, cfg.alpha
    out_schema = T.StructType([stream.schema[key], *[stream.schema[c] for c in keep],
                               T.StructField("arm_idx", T.IntegerType()), T.StructField("ucb", T.DoubleType()),
                               T.StructField("reward", T.DoubleType())])
    state_schema = T.StructType([T.StructField("ainv", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def step(key_tuple, pdfs, state):
        import pandas as pd
        from armada.functions.vectors import context_rows
        from armada.operators.online import ArmLearner, outcome_columns
        learner = ArmLearner(k, d, lam, gamma, alpha)
        if state.exists:  # packed doubles: A^-1 as it is kept, nothing is inverted
            ainv, b = state.get
            learner.ainv = np.frombuffer(ainv).reshape(k, d, d).copy()
            learner.b = np.frombuffer(b).reshape(k, d).copy()
        # A key's rows of one micro-batch come in chunks of no order. Contexts
        # and rewards are kept packed, the other columns chunk by chunk; rows
        # are learnt in order, those of later micro-batches later.
        chunks, places, xs, oks, gains = [], [], [], [], []
        for pdf in pdfs:
            x, ok = context_rows(pdf[vec], d)
            xs.append(x), oks.append(ok)
            gains.append(np.array([[np.nan] * k if r is None else [np.nan if v is None else v for v in r] for r in pdf[rewards]], np.float64))
            places.append(pdf[order]), chunks.append(pdf[[key, *keep]])
        rows = [(c, i) for c, p in enumerate(places) for i in range(len(p))]
        values = [[(False, 0) if pd.isna(v) else (True, v) for p in places for v in p[o]] for o in order]  # NULL first
        for n in sorted(range(len(rows)), key=lambda n: tuple(v[n] for v in values)):
            c, i = rows[n]
            rows[n] = learner.step(xs[c][i], oks[c][i], gains[c][i])
        state.update((learner.ainv.tobytes(), learner.b.tobytes()))
        at = 0
        for chunk in chunks:
            yield outcome_columns(chunk, rows[at:at + len(chunk)])
            at += len(chunk)

    cols = list(dict.fromkeys([key, *keep, *order, vec, rewards]))
    return stream.select(*cols).groupBy(key).applyInPandasWithState(
        step, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def microbatch_learner(state_dir: str, out_dir: str, order: Sequence[str], vec: str, rewards: str,
                       cfg: RouterConfig, d: int, keep: Sequence[str]):
    """T3: a ``foreachBatch`` function for a global learner updated once per
    micro-batch. The state is a table of tiles (``operators.state``), one
    version a batch under ``state_dir/version=<batch_id>`` (version 0 is the
    cold start; the last two are kept, for a replay). Spark reads a version,
    solves it on an executor, and joins it with the batch's statistics into
    the next one; only the solved model passes through the driver, as arrays.
    Decisions go under ``out_dir/batch_id=<id>/_kind=0`` (``read_decisions``)."""
    order = list(order)
    keep = list(dict.fromkeys([*keep, *order]))

    def run(batch_df: DataFrame, batch_id: int):
        spark = batch_df.sparkSession
        state = spark.read.schema(STATE_SCHEMA).parquet(f"{state_dir}/version={batch_id}") if batch_id else cold_tiles(spark, cfg, d)
        staged_dir = fresh_dir(spark, f"stream-{batch_id}")
        stage(batch_df.select(*dict.fromkeys([*keep, vec, rewards])), staged_dir, order)
        stats = score_and_fold(spark.read.parquet(staged_dir), f"{out_dir}/batch_id={batch_id}", solve_state(state, cfg, d), order, vec,
                               rewards, cfg, keep)
        merge_tiles(state, stats, cfg.gamma).write.mode("overwrite").parquet(f"{state_dir}/version={batch_id + 1}")
        remove_dir(spark, staged_dir)
        remove_dir(spark, f"{out_dir}/batch_id={batch_id}/_kind=1")
        remove_dir(spark, f"{state_dir}/version={batch_id - 1}")

    return run


def read_decisions(spark, out_dir: str) -> DataFrame:
    """The decisions that ``microbatch_learner`` has written."""
    stats = [f.name for f in T.StructType.fromDDL(STAT_SCHEMA)]
    return spark.read.parquet(out_dir).where("_kind = 0").drop("_kind", *stats)


def running_metrics(outcomes_stream: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """T4: running count, accuracy and total price per group of a stream of
    outcomes (``correct``, ``price``); use output mode ``complete`` or
    ``update``."""
    n = F.count(F.lit(1))
    return outcomes_stream.groupBy(*group).agg(
        n.alias("n"), (F.sum(F.coalesce(F.col("correct"), F.lit(0))) / n).alias("running_accuracy"),
        F.sum("price").alias("running_price"))


def replay(rows: DataFrame, arrival: str, arrivals: Sequence, path: str, start) -> None:
    """Feed given rows to a stream as they would arrive: for each value of
    ``arrival`` in turn its rows are added to the folder ``path`` and the query
    that ``start(stream)`` returns (``availableNow`` on its own checkpoint) runs
    until it has read them, as one micro-batch of however many files."""
    spark = rows.sparkSession
    schema = rows.drop(arrival).schema
    for value in arrivals:
        rows.where(F.col(arrival).eqNullSafe(F.lit(value))).drop(arrival).write.mode("append").parquet(path)
        start(spark.readStream.schema(schema).parquet(path)).awaitTermination()

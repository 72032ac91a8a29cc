"""Streaming jobs equal their batch operators (availableNow over files)."""

import os
import time

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from armada.config import RouterConfig
from armada.operators.online import learn_by_key, learn_microbatch
from armada.operators.routing import cold_start, solve
from armada.sources.tables import user_events
from armada.streaming.jobs import (
    learn_by_key_stream, microbatch_learner, read_decisions, running_metrics, score_stream,
)

SF = "/root/testdata/sf0.001"
CFG = RouterConfig(arms=("a0", "a1"), prices=(1.0, 1.0), alpha=0.5, lam=2.0, gamma=0.9)


def _two_files(scratch):
    """The events table cut by time into two files, written oldest first."""
    t = pq.read_table(f"{SF}/events.parquet").to_pandas().sort_values(["ts", "event_id"])
    cut = t.ts.min() + (t.ts.max() - t.ts.min()) / 2
    d = f"{scratch}/in"
    os.makedirs(d)
    t[t.ts <= cut].to_parquet(f"{d}/part-0.parquet", index=False)
    time.sleep(1.1)
    t[t.ts > cut].to_parquet(f"{d}/part-1.parquet", index=False)
    return d, cut


def _stream(spark, d):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)
    return raw.select("event_id", "ts", "user_id", "event_type", "value",
                      F.array((F.col("value") / 100.0).cast("double")).alias("x"),
                      F.array(*[F.when((F.col("event_id") + k) % 3 == 0, 1.0).otherwise(0.0)
                                for k in range(2)]).alias("rewards"))


def test_keyed_stream_equals_batch(spark, scratch):
    d, _ = _two_files(scratch)
    out = learn_by_key_stream(_stream(spark, d), "user_id", ["ts", "event_id"], "x", "rewards", CFG, 1,
                              keep=["event_id"])
    q = (out.writeStream.format("memory").queryName("keyed_out").outputMode("append")
         .option("checkpointLocation", f"{scratch}/ck1").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["event_id"]: r["arm_idx"] for r in spark.sql("select * from keyed_out").collect()}
    want = {r["event_id"]: r["arm_idx"] for r in learn_by_key(
        user_events(spark, SF), "user_id", ["ts", "event_id"], "x", "rewards", CFG, 1, keep=["event_id"]).collect()}
    assert len(got) == len(want) and got == want


def test_microbatch_stream_equals_batch_and_replay_is_idempotent(spark, scratch):
    d, cut = _two_files(scratch)
    state_dir, out_dir = f"{scratch}/state", f"{scratch}/dec"
    fn = microbatch_learner(state_dir, out_dir, ["ts", "event_id"], "x", "rewards", CFG, 1, keep=["event_id"])
    q = (_stream(spark, d).writeStream.foreachBatch(fn).option("checkpointLocation", f"{scratch}/ck2")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["event_id"]: r["arm_idx"] for r in read_decisions(spark, out_dir).collect()}
    ev = user_events(spark, SF).withColumn("half", F.when(F.col("ts") <= F.lit(cut.to_pydatetime()).cast("timestamp_ntz"), 0).otherwise(1))
    want = {r["event_id"]: r["arm_idx"] for r in learn_microbatch(
        ev, "half", ["ts", "event_id"], "x", "rewards", CFG, 1, keep=["event_id"]).collect()}
    assert got == want
    v2 = sorted(tuple(r) for r in spark.read.parquet(f"{state_dir}/version=2").collect())
    # replaying batch 1 rewrites version 2 from version 1: same state, no double fold
    batch1 = spark.read.parquet(f"{d}/part-1.parquet")
    batch1 = batch1.select("event_id", "ts", "user_id", "value",
                           F.array((F.col("value") / 100.0).cast("double")).alias("x"),
                           F.array(*[F.when((F.col("event_id") + k) % 3 == 0, 1.0).otherwise(0.0)
                                     for k in range(2)]).alias("rewards"))
    fn(batch1, 1)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{state_dir}/version=2").collect()) == v2


def test_frozen_scoring_and_running_metrics_stream(spark, scratch):
    d, _ = _two_files(scratch)
    model = solve(*cold_start(CFG, 1))
    scored = score_stream(_stream(spark, d), "x", model, CFG.alpha, ["event_id", "user_id"])
    outc = scored.withColumn("correct", (F.col("event_id") % 2).cast("int")).withColumn("price", F.lit(1.0))
    q = (running_metrics(outc, ["arm_idx"]).writeStream.format("memory").queryName("run_metrics")
         .outputMode("complete").option("checkpointLocation", f"{scratch}/ck3").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.sql("select * from run_metrics").collect()
    n = pq.read_table(f"{SF}/events.parquet").num_rows
    assert len(rows) == 1 and rows[0]["arm_idx"] == 0 and rows[0]["n"] == n   # cold start: first arm
    assert abs(rows[0]["running_price"] - n) < 1e-9


def test_keyed_stream_restart_from_checkpoint(spark, scratch):
    """Stop after the first file, restart on the same checkpoint when the
    second file arrives: the restored per-key state continues the loop."""
    t = pq.read_table(f"{SF}/events.parquet").to_pandas().sort_values(["ts", "event_id"])
    cut = t.ts.min() + (t.ts.max() - t.ts.min()) / 2
    d = f"{scratch}/in"
    os.makedirs(d)
    t[t.ts <= cut].to_parquet(f"{d}/part-0.parquet", index=False)
    sink, ck = f"{scratch}/out", f"{scratch}/ck"

    def run_once():
        out = learn_by_key_stream(_stream(spark, d), "user_id", ["ts", "event_id"], "x", "rewards", CFG, 1,
                                  keep=["event_id"])
        q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()

    run_once()
    first = spark.read.parquet(sink).count()
    assert first == int((t.ts <= cut).sum())
    time.sleep(1.1)
    t[t.ts > cut].to_parquet(f"{d}/part-1.parquet", index=False)
    run_once()
    got = {r["event_id"]: r["arm_idx"] for r in spark.read.parquet(sink).collect()}
    want = {r["event_id"]: r["arm_idx"] for r in learn_by_key(
        user_events(spark, SF), "user_id", ["ts", "event_id"], "x", "rewards", CFG, 1, keep=["event_id"]).collect()}
    assert got == want

"""The command line on small files derived from the given tables."""

import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from armada import cli
from armada.sources import tables

SF = "/root/testdata/sf0.001"


def test_cli_evaluate(spark, scratch, capsys):
    qs = tables.questions(spark, SF).toPandas()
    os.makedirs(f"{scratch}/prompts/test")
    for task, g in qs.groupby("task"):
        g[["prompt", "answer"]].to_csv(f"{scratch}/prompts/test/{task}_prompts.csv", index=False)
    cli.main(["evaluate", "--prompts", f"{scratch}/prompts", "--out", f"{scratch}/res", "--model", "llama 3B,gemma 2B"])
    summ = spark.read.option("header", True).csv(f"{scratch}/res/summary")
    assert summ.count() == 2 * qs.task.nunique()
    preds = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
             .csv(f"{scratch}/res/predictions"))
    assert preds.count() == 2 * len(qs)
    assert "gemma-2-2b-it" in capsys.readouterr().out


def test_cli_route_frozen_and_update(spark, scratch, capsys):
    ctx = tables.contexts(spark, SF).withColumn("embedding", F.col("embedding"))
    ctx.where(F.col("row_id") % 2 == 0).write.parquet(f"{scratch}/train")
    ctx.where(F.col("row_id") % 2 == 1).write.parquet(f"{scratch}/test")
    cli.main(["route", "--train", f"{scratch}/train", "--test", f"{scratch}/test", "--past_context",
              "--alpha", "0.5", "--repeats", "2"])
    out = capsys.readouterr().out
    assert out.count("run ") == 2 and "mean accuracy" in out
    cli.main(["route", "--test", f"{scratch}/test", "--repeats", "1"])      # cold start, frozen
    out = capsys.readouterr().out
    assert "price per 10000 1000.00" in out                                  # first (cheapest) arm always
    cli.main(["route", "--test", f"{scratch}/test", "--update", "--update_batch_rows", "50", "--repeats", "1",
              "--alpha", "0.5"])
    assert "mean accuracy" in capsys.readouterr().out

"""End-to-end jobs on the given tables with the offline model stand-ins."""

import pytest
from pyspark.sql import functions as F

from armada.operators.inference import hashing_embedder_factory, offline_scorer_factory
from armada.plans import jobs
from armada.sources import tables

SF = "/root/testdata/sf0.001"


def test_evaluate_with_subset(spark):
    qs = tables.questions(spark, SF)
    report, graded = jobs.evaluate(qs, ["gemma 2B", "llama 3B"], offline_scorer_factory(), subset_ratio=0.5)
    per_task = {r["task"]: r["c"] for r in qs.groupBy("task").agg(F.count("*").alias("c")).collect()}
    rep = report.collect()
    assert {r["model"] for r in rep} == {"gemma 2B", "llama 3B"}
    for r in rep:
        want = round(0.5 * per_task[r["task"]])          # half-even, per task
        assert r["n"] == want
        assert (r["error"] is None) == (want > 0)
    assert set(r["prediction"] for r in graded.collect()) <= {"A", "B", "C", "D", "NONE", "ERROR"}


def test_prepare_vectors_skips_finished_units(spark, scratch):
    items = tables.benchmark_items(spark, SF).select("task", F.col("item_id").alias("row_id"), "question", "choices")
    sink = f"{scratch}/vectors"
    calls = spark.sparkContext.accumulator(0)

    def counting_factory():
        inner = hashing_embedder_factory(16)()

        def fn(texts):
            calls.add(len(texts))
            return inner(texts)
        return lambda: fn

    first, rejected = jobs.prepare_vectors(items, counting_factory(), sink, "hash16", "test")
    n_ok = items.where(F.size("choices") <= 4).count()
    assert first.count() == n_ok and calls.value == n_ok
    assert {r["error"] for r in rejected.collect()} == {"more than four choices"}
    assert first.count() + rejected.count() == items.count()
    again, _ = jobs.prepare_vectors(items, counting_factory(), sink, "hash16", "test")
    assert again.count() == n_ok and calls.value == n_ok     # nothing embedded twice
    v = again.select(F.size("embedding").alias("d")).distinct().collect()
    assert [r["d"] for r in v] == [16]


def test_every_prompt_is_scored_once_and_batches_are_cut(spark):
    qs = tables.questions(spark, SF)
    scored, sizes = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def factory():
        inner = offline_scorer_factory()()

        def fn(batch):
            scored.add(len(batch))
            sizes.add(int(len(batch) > 8))
            return inner(batch)
        return fn

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    report, graded = jobs.evaluate(qs, ["gemma 2B", "llama 3B"], factory, batch_rows=8)
    assert report.count() and graded.count() and report.collect() and graded.groupBy("prediction").count().count()
    assert scored.value == 2 * qs.count() and sizes.value == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_failing_scorer_is_an_error_not_an_accuracy(spark):
    def factory():
        def fn(batch):
            raise RuntimeError("device lost")
        return fn

    report, graded = jobs.evaluate(tables.questions(spark, SF), ["gemma 2B"], factory)
    rows = report.collect()
    assert rows and all(r["error"] == "RuntimeError: device lost" and r["accuracy"] is None for r in rows)
    assert {r["prediction"] for r in graded.collect()} == {"ERROR"}


def test_whole_split_without_tasks(spark):
    qs = tables.questions(spark, SF).drop("task")
    report, graded = jobs.evaluate(qs, ["gemma 2B"], offline_scorer_factory(), split="auxiliary_train")
    assert "task" not in report.columns and "task" not in graded.columns
    assert [r["n"] for r in report.collect()] == [qs.count()]


def test_labels_and_tasks_from_other_tables(spark):
    vec = spark.createDataFrame([(i, [float(i or 0)]) for i in (*range(20), None)], "row_id long, embedding array<double>")
    lab = spark.createDataFrame([(i, (i or 0) % 2) for i in (*range(5, 30), None)], "row_id long, gemma int")
    both, counts = jobs.pair_labels(vec, lab)
    assert both.count() == 16 and counts.get == {"labels_unmatched": 10, "vectors_unmatched": 5}
    assert sorted(both.columns) == ["embedding", "gemma", "row_id"] and both.where("row_id is null").count() == 1
    plan = jobs.pair_labels(vec, lab)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # each side once
    with pytest.raises(Exception, match="not unique by row_id"):
        jobs.pair_labels(vec.unionAll(vec.limit(3)), lab)[0].count()
    prompts = spark.createDataFrame([(i, f"t{(i or 0) % 3}") for i in (*range(20), None)], "row_id long, task string")
    split = jobs.split_data(vec, prompts).collect()
    assert len(split) == 21 and sum(r["split"] == "train" for r in split) == 15
    with pytest.raises(Exception, match="no task for row"):
        jobs.split_data(vec, prompts.where("row_id <> 3")).collect()


def test_learning_repeats_equal_loops(spark):
    import numpy as np
    from armada.config import RouterConfig
    from armada.operators.sampling import permutation_order
    from numpy_learner import HistoryLinUCB
    cfg = RouterConfig(alpha=0.5, lam=2.0, gamma=0.95, p=0.3)
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(30, 4)), rng.integers(0, 2, size=(30, cfg.k))
    df = spark.createDataFrame([(i, x[i].tolist(), *map(int, c[i])) for i in range(30)],
                               "row_id long, v array<double>, " + ", ".join(f"{a} int" for a in cfg.arms))
    from armada.operators.routing import cold_start, solve
    got = jobs.learning_repeats(df, "v", solve(*cold_start(cfg, 4)), cfg, 2, 1)
    for run in range(2):
        ref, want = HistoryLinUCB(cfg.k, 4, cfg.alpha, cfg.lam, cfg.gamma), {}
        for r in permutation_order(df.select("row_id"), "row_id", f"run{run}", name="seq").orderBy("seq").collect():
            i = r["row_id"]
            arm, _ = ref.choose(x[i])
            ref.update(arm, x[i], c[i][arm] - cfg.p * cfg.normalised_prices[arm])
            want[i] = (arm, c[i][arm])
        assert {r["row_id"]: (r["arm_idx"], r["correct"]) for r in got.where(F.col("run") == run).collect()} == want

"""File sources and sinks on small hand-written fixtures."""

import os

from pyspark.sql import functions as F

from armada.sources.files import (
    finished_units, pending_work, read_label_file, read_prompt_files, read_question_files, read_vectors,
    write_predictions, write_summary, write_task_files, write_vectors,
)


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_prompt_files_task_and_position(spark, scratch):
    _write(f"{scratch}/test/anatomy_prompts.csv", 'prompt,answer\n"Q1, with comma",0\n"multi\nline",3\n')
    _write(f"{scratch}/test/virology_prompts.csv", "prompt,answer\nV,2\n")
    rows = sorted((r["task"], r["row_id"], r["prompt"], r["answer"])
                  for r in read_prompt_files(spark, f"{scratch}/test/*_prompts.csv").collect())
    assert rows == [("anatomy", 0, "Q1, with comma", 0), ("anatomy", 1, "multi\nline", 3), ("virology", 0, "V", 2)]


def test_question_files_parse_choices(spark, scratch):
    _write(f"{scratch}/q/anatomy/train.csv", 'question,choices\nWhat?,"[\'a\', ""b\'s""]"\nBad,"(\'x\',)"\n')
    rows = {r["row_id"]: r for r in read_question_files(spark, f"{scratch}/q", "auxiliary_train").collect()}
    assert rows[0]["choices"] == ["a", "b's"] and rows[0]["task"] == "anatomy"
    assert rows[1]["choices"] == ["x"] and rows[0]["split"] == "auxiliary_train"


def test_label_file(spark, scratch):
    _write(f"{scratch}/labels.csv", "gemma,llama8B\n1,0\n0,1\n")
    rows = sorted(tuple(r) for r in read_label_file(spark, f"{scratch}/labels.csv", ["gemma", "llama8B"]).collect())
    assert rows == [(0, 1, 0), (1, 0, 1)]


def test_vector_sink_rerun_and_pending(spark, scratch):
    out = f"{scratch}/vec"
    v = spark.createDataFrame([("e", "test", t, 1, i, [float(i)]) for t in ("a", "b") for i in range(3)],
                              "embedder string, split string, task string, part int, row_id long, embedding array<float>")
    write_vectors(v.where(F.col("task") == "a"), out)
    write_vectors(v.where(F.col("task") == "a"), out)   # rerun: replaces, never duplicates
    assert read_vectors(spark, out).count() == 3
    todo = v.select("embedder", "split", "task", "part").distinct()
    pend = pending_work(todo, finished_units(spark, out), ["embedder", "split", "task", "part"]).collect()
    assert [r["task"] for r in pend] == ["b"]
    write_vectors(v.where(F.col("task") == "b"), out)
    assert read_vectors(spark, out).count() == 6


def test_prediction_and_summary_sinks(spark, scratch):
    preds = spark.createDataFrame([("m", "test", "t", 0, "p", "A", "B")],
                                  "model string, split string, task string, row_id long, prompt string, "
                                  "ground_truth string, prediction string")
    write_predictions(preds, f"{scratch}/pred")
    write_predictions(preds, f"{scratch}/pred")
    assert spark.read.option("header", True).csv(f"{scratch}/pred").count() == 1
    rep = spark.createDataFrame([("m", "test", "t", 0.125, 2.675)], "model string, split string, task string, "
                                                                    "accuracy double, avg_time_sec double")
    write_summary(rep, f"{scratch}/sum")
    r = spark.read.option("header", True).csv(f"{scratch}/sum").collect()[0]
    assert r["accuracy_text"].endswith("%") and float(r["accuracy"]) == 0.125


def test_whole_split_prompt_file(spark, scratch):
    _write(f"{scratch}/auxiliary_train/prompts.csv", "prompt,answer\nA,1\nB,2\nC,0\n")
    rows = sorted((r["task"], r["row_id"], r["prompt"], r["answer"]) for r in
                  read_prompt_files(spark, f"{scratch}/auxiliary_train/prompts.csv", per_task=False).collect())
    assert rows == [(None, 0, "A", 1), (None, 1, "B", 2), (None, 2, "C", 0)]


def test_columns_are_found_by_name(spark, scratch):
    import pytest
    _write(f"{scratch}/p/test/anatomy_prompts.csv", "task,answer,prompt\nt,3,Q\n")
    r = read_prompt_files(spark, f"{scratch}/p/test/*_prompts.csv").collect()[0]
    assert (r["task"], r["prompt"], r["answer"]) == ("anatomy", "Q", 3)
    _write(f"{scratch}/q/anatomy/test.csv", "question,subject,choices,answer\nWhat?,anat,\"['a', 'b']\",1\n")
    r = read_question_files(spark, f"{scratch}/q", "test").collect()[0]
    assert r["question"] == "What?" and r["choices"] == ["a", "b"]
    _write(f"{scratch}/labels.csv", "question,task,qwen,gemma,llama8B,mistral\nq,t,0,1,1,0\n")
    arms = ["gemma", "llama8B", "mistral", "qwen"]
    assert tuple(read_label_file(spark, f"{scratch}/labels.csv", arms).collect()[0]) == (0, 1, 1, 0, 0)
    _write(f"{scratch}/bad.csv", "question,gemma\nq,1\n")
    with pytest.raises(ValueError, match="no column llama8B"):
        read_label_file(spark, f"{scratch}/bad.csv", ["gemma", "llama8B"])


def test_only_a_missing_sink_means_nothing_written(spark, scratch):
    import pytest
    assert finished_units(spark, f"{scratch}/none").count() == 0
    _write(f"{scratch}/broken/embedder=e/split=test/task=t/part=0/x.parquet", "not parquet")
    with pytest.raises(Exception):
        finished_units(spark, f"{scratch}/broken").count()


def test_summary_rounds_ties_to_even(spark):
    from armada.operators.grading import format_summary
    df = spark.createDataFrame([(0.00125, 0.125), (0.00375, 0.375)], "accuracy double, avg_time_sec double")
    got = [tuple(r)[2:] for r in format_summary(df).collect()]
    assert got == [(f"{0.125:.2f}%", f"{0.125:.2f}"), (f"{0.375:.2f}%", f"{0.375:.2f}")]


def test_positions_of_split_files(spark, scratch):
    """Files without line breaks in values are split; places go on over the splits."""
    rows = [f"question {i} {'x' * (i % 50)},{i % 4}" for i in range(4000)]
    for task, part in (("a", rows), ("b", rows[:7]), ("empty", [])):
        _write(f"{scratch}/{task}_prompts.csv", "\n".join(["prompt,answer", *part]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = read_prompt_files(spark, f"{scratch}/*_prompts.csv", multi_line=False)
        got = {(r["task"], r["row_id"]): r["prompt"] for r in df.collect()}
        whole = read_prompt_files(spark, f"{scratch}/*_prompts.csv")
        assert got == {(r["task"], r["row_id"]): r["prompt"] for r in whole.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(t, i): r.split(",")[0] for t, part in (("a", rows), ("b", rows[:7])) for i, r in enumerate(part)}


def test_task_files_are_written_as_they_are_read(spark, scratch):
    rows = [("a_b", i, f' "q" {i},\nline ', i % 4) for i in range(5)] + [("c", 9, "x", 1)]
    df = spark.createDataFrame(rows, "task string, i int, prompt string, answer int")
    for _ in range(2):  # a rerun replaces the files
        write_task_files(df, f"{scratch}/p/test", "{task}_prompts.csv", ["i"])
    got = sorted((r["task"], r["row_id"], r["prompt"], r["answer"]) for r in read_prompt_files(spark, f"{scratch}/p/test/*_prompts.csv").collect())
    assert got == [("a_b", i, f' "q" {i},\nline ', i % 4) for i in range(5)] + [("c", 0, "x", 1)]
    assert sorted(os.path.basename(f) for f in os.listdir(f"{scratch}/p/test") if f.endswith(".csv") and f[0] != ".") == ["a_b_prompts.csv", "c_prompts.csv"]

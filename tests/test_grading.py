"""Grading rules and the run report."""

from pyspark.sql import functions as F

from armada import config as C
from armada.operators.grading import accuracy, alignment_counts, grade, run_report
from armada.sources.registry import resolve_models


def test_grade_rules(spark):
    rows = [
        ("m", "t", 0, "P", "P The answer is A.", 0, 1.0),   # correct
        ("m", "t", 1, "P", "P I think B", 0, 1.0),          # wrong
        ("m", "t", 2, "P", "P no idea", 1, 1.0),            # NONE
        ("m", "t", 3, "P A", None, 0, 1.0),                 # ERROR
        ("m", "t", 4, "A B", "A B then C", 2, 3.0),         # echo removed by length: C
    ]
    df = spark.createDataFrame(rows, "model string, task string, row_id long, prompt string, generated_text string, "
                                     "answer int, latency_sec double")
    g = {r["row_id"]: (r["prediction"], r["correct"]) for r in grade(df).collect()}
    assert g == {0: ("A", 1), 1: ("B", 0), 2: ("NONE", 0), 3: ("ERROR", 0), 4: ("C", 1)}
    acc = accuracy(grade(df), ["model", "task"]).collect()[0]
    assert acc["n"] == 5 and abs(acc["accuracy"] - 0.4) < 1e-12 and abs(acc["avg_time_sec"] - 1.4) < 1e-12


def test_run_report_errors(spark):
    rows = [("m", "t1", 0, "P", "P A", 0, 1.0), ("m", "t2", 0, "P", "P A", 99, 1.0)]
    df = spark.createDataFrame(rows, "model string, task string, row_id long, prompt string, generated_text string, "
                                     "answer int, latency_sec double")
    summary = accuracy(grade(df), ["model", "task"])
    expected = spark.createDataFrame([("m", "t1"), ("m", "t2"), ("m", "t3")], "model string, task string")
    rep = {r["task"]: (r["accuracy"], r["error"]) for r in run_report(summary, expected, ["model", "task"]).collect()}
    assert rep["t1"] == (1.0, None)
    assert rep["t2"][0] is None and rep["t2"][1] == "answer outside 0..25"
    assert rep["t3"] == (None, C.EMPTY_EVAL_ERROR)


def test_alignment_counts(spark):
    r = spark.createDataFrame([("t", 0), ("t", 1), ("t", 5)], "task string, row_id long")
    q = spark.createDataFrame([("t", 0), ("t", 1), ("t", 2)], "task string, row_id long")
    c = alignment_counts(r, q, ["task", "row_id"]).collect()[0]
    assert (c["responses_unmatched"], c["questions_unmatched"]) == (1, 1)


def test_unknown_model_fails(spark):
    import pytest
    df = spark.createDataFrame([("gemma 2B,nope 1B",)], "m string")
    with pytest.raises(Exception, match="nope 1B"):
        resolve_models(df, "m").collect()
    ok = resolve_models(spark.createDataFrame([("llama 3B,gemma 2B",)], "m string"), "m").collect()
    assert [r["model_name"] for r in ok] == ["Llama-3.2-3B-Instruct", "gemma-2-2b-it"]


def test_whole_split_report_with_null_task(spark):
    rows = [("m", None, 0, "P", "P A", 0, 1.0), ("m", None, 1, "P", "P B", 0, 1.0)]
    df = spark.createDataFrame(rows, "model string, task string, row_id long, prompt string, generated_text string, "
                                     "answer int, latency_sec double")
    summary = accuracy(grade(df), ["model", "task"])
    expected = spark.createDataFrame([("m", None)], "model string, task string")
    rep = run_report(summary, expected, ["model", "task"]).collect()
    assert len(rep) == 1 and rep[0]["error"] is None and rep[0]["accuracy"] == 0.5 and rep[0]["n"] == 2

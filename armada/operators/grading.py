"""Grading model responses and reporting accuracy and latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada import config as C
from armada.functions.text import answer_letter, parse_answer, strip_echo
from armada.operators.ordinal import join_keys


def align_responses(responses: DataFrame, questions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pair responses with their questions by key (inner equi-join).

    Rows are paired by key, never by position; ``alignment_counts`` reports
    rows that found no partner instead of dropping them silently."""
    return join_keys(responses, questions, list(keys), "inner")


def alignment_counts(responses: DataFrame, questions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: responses without a question and questions without a response
    (per response model if a ``model`` column exists)."""
    keys = list(keys)
    r = responses.select(*keys).withColumn("_r", F.lit(1))
    q = questions.select(*[k for k in keys if k in questions.columns]).withColumn("_q", F.lit(1))
    both = join_keys(r, q, [k for k in keys if k in questions.columns], "full_outer")
    return both.agg(
        F.sum(F.when(F.col("_q").isNull(), 1).otherwise(0)).cast("long").alias("responses_unmatched"),
        F.sum(F.when(F.col("_r").isNull(), 1).otherwise(0)).cast("long").alias("questions_unmatched"),
    )


def parse_responses(df: DataFrame, prompt: str = "prompt", text: str = "generated_text",
                    prompt_len: str | None = None) -> DataFrame:
    """Add ``_parsed`` (first standalone A-D behind the echoed prompt, which
    is removed by length) and ``_failed`` (no response). With ``prompt_len``
    (the prompt's length in characters) the prompt itself is not needed."""
    if prompt_len:
        rest = F.call_function("substring", F.col(text), F.col(prompt_len) + F.lit(1))
    else:
        rest = strip_echo(F.col(text), F.col(prompt))
    return df.withColumn("_parsed", parse_answer(rest)).withColumn("_failed", F.col(text).isNull())


def grade_parsed(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Add ``ground_truth``, ``prediction`` (A-D, ``NONE`` or ``ERROR``),
    ``correct`` (0/1) and ``answer_ok`` to parsed responses with their answer;
    a failed response is an ``ERROR`` counted wrong."""
    df = df.withColumn("ground_truth", answer_letter(F.col(answer)))
    prediction = F.when(F.col("_failed"), F.lit("ERROR")).otherwise(F.coalesce(F.col("_parsed"), F.lit("NONE")))
    return (df.withColumn("prediction", prediction)
            .withColumn("correct", F.coalesce(F.col("_parsed") == F.col("ground_truth"), F.lit(False)).cast("int"))
            .withColumn("answer_ok", F.col("ground_truth").isNotNull()).drop("_parsed", "_failed"))


def grade(df: DataFrame, prompt: str = "prompt", text: str = "generated_text", answer: str = "answer",
          prompt_len: str | None = None) -> DataFrame:
    """``parse_responses`` and ``grade_parsed`` of responses that carry their answer."""
    return grade_parsed(parse_responses(df, prompt, text, prompt_len), answer)


def accuracy(graded: DataFrame, by: Sequence[str], latency: str | None = "latency_sec") -> DataFrame:
    """Accuracy (``NONE``/``ERROR`` count as wrong) and mean seconds per
    question per group. Partial + final hash aggregation."""
    aggs = [
        F.avg("correct").alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("answer_ok"), 0).otherwise(1)).cast("long").alias("n_bad_answer"),
    ]
    if "scorer_error" in graded.columns:
        aggs.append(F.min("scorer_error").alias("scorer_error"))
    if latency:
        aggs.append((F.sum(latency) / F.count(F.lit(1))).alias("avg_time_sec"))
    return graded.groupBy(*by).agg(*aggs)


def run_report(summary: DataFrame, expected: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every expected group with its metrics, or an ``error`` when the group
    had no rows, when scoring any of its batches failed, or when it held an
    answer that cannot be graded (one failure fails the whole group)."""
    by = list(by)
    rep = join_keys(expected, summary, by, "left")
    bad = F.coalesce(F.col("n_bad_answer"), F.lit(0)) > 0
    empty = F.coalesce(F.col("n"), F.lit(0)) == 0
    if "scorer_error" not in rep.columns:
        rep = rep.withColumn("scorer_error", F.lit(None).cast("string"))
    failed = F.col("scorer_error").isNotNull()
    return (
        rep.withColumn(
            "error",
            F.when(empty, F.lit(C.EMPTY_EVAL_ERROR)).when(failed, F.col("scorer_error"))
            .when(bad, F.lit("answer outside 0..25")),
        )
        .withColumn("accuracy", F.when(F.col("error").isNull(), F.col("accuracy")))
        .withColumn("avg_time_sec", F.when(F.col("error").isNull(), F.col("avg_time_sec")))
        .withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("long"))
        .drop("n_bad_answer", "scorer_error")
    )


def format_summary(report: DataFrame) -> DataFrame:
    """Display strings for a sink: ``dd.dd%`` and ``d.dd``, ties rounded to
    even as in Python; raw doubles stay in the report."""
    two = lambda c: F.format_string("%.2f", F.bround(c, 2))
    return report.withColumn("accuracy_text", F.concat(two(F.col("accuracy") * 100), F.lit("%"))).withColumn(
        "avg_time_text", two(F.col("avg_time_sec")))

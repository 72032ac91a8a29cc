"""File sources (CSV prompt/question/label tables, vector parquet) and sinks.

Rows of CSV files carry no key, so a position is counted while a file is
read. Files with line breaks inside values (the default) are not split, each
is read in order by one task; files without (``multi_line=False``) are split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armada.functions.text import read_choices
from armada.session import fresh_dir, materialize


def _csv(spark: SparkSession, path, types: dict, multi_line: bool = True) -> DataFrame:
    """The named columns of CSV files, wherever they stand in the header;
    other columns are ignored, a missing one fails. Values are read as text
    and cast. Every file must have the same header."""
    raw = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
           .option("enforceSchema", False).csv(path))
    missing = [c for c in types if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {', '.join(raw.columns)}")
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = raw.select(*[quoted(c).cast(t).alias(c) for c, t in types.items()], F.col("_metadata.file_path").alias("_file"),
                      F.col("_metadata.file_block_start").alias("_start"))
    return _with_position(rows, multi_line)


def _with_position(df: DataFrame, whole_files: bool) -> DataFrame:
    """``row_id``: a row's place in its file, counted as the rows go by. A
    file that is not split is read by one task. Otherwise places are counted
    inside each split, the rows are written once, and the splits before a
    split (a row each) give its first place."""
    at = df.columns.index("_file")

    def run(batches):
        import pyarrow as pa
        last, n = None, 0
        for batch in batches:
            keys = list(zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist()))
            places = []
            for key in keys:
                n = n + 1 if key == last else 0
                last = key
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "row_id"])

    placed = df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("row_id", T.LongType())]))
    if whole_files:
        return placed.drop("_start")
    placed = materialize(placed, "csv")
    sizes = placed.groupBy("_file", "_start").agg((F.max("row_id") + 1).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_file", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return placed.join(first, ["_file", "_start"]).withColumn("row_id", F.col("row_id") + F.col("_first")).drop("_start", "_first")


def read_prompt_files(spark: SparkSession, path: str, per_task: bool = True, multi_line: bool = True) -> DataFrame:
    """Prompt CSVs ``(prompt, answer)``. ``per_task``: files named
    ``<task>_prompts.csv`` (task from the file name); else one file for a
    whole split (task NULL). Output ``(task, row_id, prompt, answer)``."""
    df = _csv(spark, path, {"prompt": "string", "answer": "int"}, multi_line)
    task = (F.regexp_extract(F.element_at(F.split("_file", "/"), -1), r"(.*)_prompts\.csv$", 1)
            if per_task else F.lit(None).cast("string"))
    return df.select(task.alias("task"), "row_id", "prompt", "answer")


def read_question_files(spark: SparkSession, root: str, split: str, multi_line: bool = True) -> DataFrame:
    """Question CSVs under ``<root>/<task>/<split>.csv``; ``auxiliary_train``
    reads ``train``. Choices are Python list literals, parsed to
    ``array<string>``: in the JVM, and what that cannot read (tuples, None
    items, ``\\x`` escapes) by Python's own reader; NULL when neither can."""
    file_split = "train" if split == "auxiliary_train" else split
    if split not in ("auxiliary_train", "test"):
        raise ValueError("split must be auxiliary_train or test")
    df = _csv(spark, f"{root.rstrip('/')}/*/{file_split}.csv", {"question": "string", "choices": "string"}, multi_line)
    task = F.element_at(F.split("_file", "/"), -2)
    return df.select(task.alias("task"), F.lit(split).alias("split"), "row_id", "question",
                     F.col("choices").alias("choices_text"), read_choices("choices").alias("choices"))


def read_label_file(spark: SparkSession, path: str, arms: Sequence[str], multi_line: bool = True) -> DataFrame:
    """Wide 0/1 correctness per arm, keyed by position."""
    df = _csv(spark, path, {a: "double" for a in arms}, multi_line)
    return df.select("row_id", *[F.col(a).cast("int").alias(a) for a in arms])


def read_task_file(spark: SparkSession, path: str, arms: Sequence[str], multi_line: bool = True) -> DataFrame:
    """Prompt, task and correctness per arm, keyed by position (the file that
    tells a whole split's rows their task)."""
    df = _csv(spark, path, {"prompt": "string", "task": "string"} | {a: "double" for a in arms}, multi_line)
    return df.select("row_id", "prompt", "task", *[F.col(a).cast("int").alias(a) for a in arms])


def write_task_files(df: DataFrame, root: str, name: str, order: Sequence[str]) -> None:
    """One CSV file per task, ``root`` / ``name`` with ``{task}`` filled in, as the
    readers above expect them: rows in ``order``, ``task`` not a column. The
    files are written by Spark and then named, one step for each task (the
    task registry bounds them); a rerun replaces them."""
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    made = fresh_dir(spark, "task-files")
    (df.repartition("task").sortWithinPartitions("task", *order).write.option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).partitionBy("task").csv(made))
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(made).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(path(f"{made}/task=*/part-*")):
        task = jvm.java.net.URLDecoder.decode(found.getPath().getParent().getName()[len("task="):], "UTF-8")
        target = path(f"{root.rstrip('/')}/{name.format(task=task)}")
        fs.mkdirs(target.getParent())
        fs.delete(target, False)
        if not fs.rename(found.getPath(), target):
            raise OSError(f"cannot name {target}")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vector tables written by ``write_vectors`` (any sub-tree of it)."""
    return spark.read.option("basePath", path.split("/embedder=")[0]).parquet(path)


def write_vectors(vecs: DataFrame, path: str) -> None:
    """``(embedder, split, task, part, row_id, embedding)`` partitioned by
    embedder/split/task/part; reruns overwrite their own partitions only.
    Rows of a unit are brought together (a large unit into several files),
    so there are not tasks x units small files."""
    unit = ["embedder", "split", "task", "part"]
    (vecs.hint("rebalance", *unit).sortWithinPartitions(*unit, "row_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*unit).parquet(path))


def write_predictions(preds: DataFrame, path: str) -> None:
    """Graded predictions, one folder per model/split/task; dynamic overwrite
    makes a rerun replace, never duplicate."""
    cols = [c for c in ("model", "split", "task", "row_id", "prompt", "ground_truth", "prediction") if c in preds.columns]
    parts = [c for c in ("model", "split", "task") if c in preds.columns]
    order = [*parts, "row_id"] if "row_id" in cols else parts
    (preds.select(*cols).hint("rebalance", *parts).sortWithinPartitions(*order).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("header", True).option("escape", '"')
     .partitionBy(*parts).csv(path))


def write_summary(report: DataFrame, path: str) -> None:
    """Summary rows per model/split as CSV (raw doubles plus display text); a
    whole split without tasks has no task column."""
    from armada.operators.grading import format_summary
    out = format_summary(report)
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True)
     .option("escape", '"').partitionBy("model", "split").csv(path))


def pending_work(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work units that have no output yet (left anti join; repeated rows of
    ``done`` do no harm)."""
    from armada.operators.ordinal import join_keys
    return join_keys(todo, done.select(*keys), list(keys), "left_anti")


def finished_units(spark: SparkSession, path: str) -> DataFrame:
    """Partition values already present under a vector sink. Only a missing
    path means that nothing is written yet; any other failure is raised."""
    try:
        found = spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "embedder string, split string, task string, part int")
    return found.select("embedder", "split", "task", "part").distinct()

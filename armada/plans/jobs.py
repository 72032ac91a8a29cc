"""The three end-to-end jobs, composed from the operators:

``evaluate``         prompts -> (sample) -> batch generation -> grading ->
                     accuracy / latency per model and task -> run report
``prepare_vectors``  questions -> instruction prompts -> skip finished
                     units -> batch embedding -> per-unit vector sink
``warm_start`` /     per-arm ridge statistics on a training table -> solved
``route``            model -> one arm per context with outcome and price

All models and tasks run in one job (one scan, one shuffle per grouping);
the model-specific parts are the caller's batch functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from armada import config as C
from armada.config import RouterConfig
from armada.functions.text import instruct_prompt
from armada.functions.vectors import as_double_array
from armada.operators import grading, inference, online, policy, routing, stats
from armada.operators.ordinal import join_keys, with_group_ordinal
from armada.operators.state import solve_tiles
from armada.operators.sampling import fraction_sample, four_way_cut, stratified_split
from armada.session import materialize
from armada.sources import files


def evaluate(prompts: DataFrame, models: Sequence[str], scorer_factory, split: str = "test",
             subset_ratio: float = 1.0, seed: int = 42, expected_tasks: DataFrame | None = None,
             batch_rows: int | None = None):
    """Evaluate ``models`` on a prompt table ``(task, row_id, prompt, answer)``;
    a whole split without tasks has no ``task`` column.

    Every prompt is scored once per model: the graded rows are written to
    the shared folder, and the report, the predictions and whatever else is
    made of them read what was written.

    Returns ``(report, graded)``: the report has one row per expected
    (model, task) with accuracy, mean seconds per question, row count and an
    ``error`` for groups that failed or produced nothing; ``graded`` holds
    every prediction (``ERROR``/``NONE`` included)."""
    if split not in ("auxiliary_train", "test"):
        raise ValueError("split must be auxiliary_train or test")
    by = ["task"] if "task" in prompts.columns else []
    sampled = fraction_sample(prompts, subset_ratio, by, "row_id", seed=seed)
    each = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    # The answer rides along with its prompt through the scorer: responses
    # stay paired by construction, no join re-reads the prompt texts.
    resp = inference.score_prompts(sampled.select(*by, "row_id", "prompt", "answer", each), scorer_factory,
                                   keep=["model", *by, "row_id", "answer"], batch_rows=batch_rows)
    graded = materialize(grading.grade(resp).withColumn("split", F.lit(split)), "graded")
    summary = grading.accuracy(graded, ["model", *by])
    if by:
        tasks = expected_tasks if expected_tasks is not None else prompts.select("task").distinct()
        expected = tasks.select("task", each)
    else:
        expected = prompts.sparkSession.createDataFrame([(m,) for m in models], "model string")
    report = grading.run_report(summary, expected, ["model", *by]).withColumn("split", F.lit(split))
    return report, graded


def instruct_questions(questions: DataFrame) -> DataFrame:
    """``questions`` with their instruction ``prompt`` and the reason for
    which one cannot be embedded (``error``, NULL when it can)."""
    q = questions.withColumn("prompt", instruct_prompt("task", "question", "choices"))
    size = F.size("choices")
    return q.withColumn("error", F.when(F.col("choices").isNull(), F.lit("unreadable choices"))
                        .when(size > len(C.INSTRUCT_LETTERS), F.lit("more than four choices"))
                        .when(F.col("prompt").isNull(), F.lit("no question or task")))


def prepare_vectors(questions: DataFrame, embedder_factory, sink: str, embedder: str, split: str,
                    cut_parts: bool = False, part: int | None = None, batch_rows: int | None = None):
    """Embed instruction prompts of ``(task, row_id, question, choices)`` and
    write them per (embedder, split, task, part); units already present in
    the sink are skipped. ``cut_parts`` cuts every task in four, ``part``
    embeds only one of the four.

    Returns ``(vectors, rejected)``: all vectors of the split (new and old;
    of the part, if one is asked for), and the questions that cannot be
    embedded with their ``error``. Every question is in one of the two."""
    every = instruct_questions(questions)
    cut_parts = cut_parts or part is not None
    # Parts are cut before anything is rejected, as positions in the file.
    every = four_way_cut(every, "task", "row_id", part=part) if cut_parts else every.withColumn("part", F.lit(0))
    rejected = every.where(F.col("error").isNotNull())
    q = every.where(F.col("error").isNull()).withColumn("embedder", F.lit(embedder)).withColumn("split", F.lit(split))
    unit = ["embedder", "split", "task", "part"]
    todo = files.pending_work(q, files.finished_units(q.sparkSession, sink), unit)
    vecs = inference.embed_text(todo, embedder_factory, text="prompt", keep=[*unit, "row_id"], batch_rows=batch_rows)
    files.write_vectors(vecs, sink)
    mine = (F.col("embedder") == embedder) & (F.col("split") == split)
    mine = mine & (F.col("part") == part) if part is not None else mine
    return files.read_vectors(q.sparkSession, sink).where(mine), rejected


def pair_labels(vectors: DataFrame, labels: DataFrame, keys: Sequence[str] = ("row_id",)):
    """Vectors with their labels, kept in two tables and paired by key (a
    NULL key pairs with a NULL key), and an observation that holds
    ``labels_unmatched`` and ``vectors_unmatched``, the rows on either side
    that found no partner, once an action on the pairs has run.

    One full outer join gives both, each side shuffled once: the check that
    vectors are unique by key (a repeated key fails the action) is a window
    over the join's own partitioning."""
    keys = list(keys)
    key = F.struct(*keys)  # equal structs may hold NULLs
    left = vectors.withColumn("_pair", key).withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy("_pair")))
    right = labels.select(key.alias("_pair"), *[c for c in labels.columns if c not in keys], F.lit(True).alias("_labelled"))
    joined = left.join(right, ["_pair"], "full_outer")
    counts = Observation()
    joined = joined.observe(counts, F.count_if(F.col("_copies").isNull()).alias("labels_unmatched"),
                            F.count_if(F.col("_labelled").isNull()).alias("vectors_unmatched"))
    repeated = F.raise_error(F.lit(f"vectors are not unique by {', '.join(keys)}")).cast("boolean")
    both = F.when(F.col("_copies") > 1, repeated).otherwise(F.col("_copies").isNotNull() & F.col("_labelled").isNotNull())
    return joined.where(both).drop("_pair", "_copies", "_labelled"), counts


def attach_task(vectors: DataFrame, prompts: DataFrame) -> DataFrame:
    """Vectors with the task (and the labels) of the prompt at the same
    position; a vector without a prompt is an error, none is dropped."""
    joined = join_keys(vectors, prompts, ["row_id"], "left")
    return joined.withColumn("task", F.when(F.col("task").isNotNull(), F.col("task")).otherwise(
        F.raise_error(F.concat(F.lit("no task for row "), F.col("row_id").cast("string"))).cast("string")))


def split_data(vectors: DataFrame, prompts: DataFrame, train_size: float = 0.75, seed: int = 1010) -> DataFrame:
    """The router's data: every vector with its task and labels, split into
    ``train`` and ``validation`` with exact sizes per task."""
    return stratified_split(attach_task(vectors, prompts), "task", "row_id", train_size, seed)


def vector_dim(df: DataFrame, vec: str) -> int:
    """The common length of a vector column; fails when lengths differ."""
    r = df.agg(F.min(F.size(vec)).alias("lo"), F.max(F.size(vec)).alias("hi")).collect()[0]
    if r["lo"] is None or r["lo"] != r["hi"]:
        raise ValueError(f"vectors in {vec} must all have one length, found {r['lo']}..{r['hi']}")
    return int(r["lo"])


def warm_start(train: DataFrame, vec: str, reward_cols: Sequence[str], cfg: RouterConfig, d: int | None = None):
    """Full-feedback warm start: one shared Gram (A does not depend on
    rewards) and one reward sum per arm, solved once, on one executor, from
    256 x 256 tiles. ``d`` defaults to the (checked) common vector length."""
    d = d or vector_dim(train, vec)
    tiles = stats.ridge_tiles(train, vec, d, list(reward_cols)).withColumn("gram", F.lit(0))
    return solve_tiles(tiles, cfg.k, d, lam=cfg.lam)


def route(contexts: DataFrame, vec: str, model: routing.ArmModel, cfg: RouterConfig, key: str = "row_id",
          labels: DataFrame | None = None) -> DataFrame:
    """Frozen policy: one arm per context; with ``labels`` (long
    ``(key, arm_idx, correct)``) adds the outcome and price."""
    dec = routing.score_contexts(contexts, vec, model, cfg.alpha, keep=[key])
    if labels is None:
        return dec
    return policy.attach_outcome(dec, labels, routing.arms_frame(contexts.sparkSession, cfg), key)


def learning_repeats(contexts: DataFrame, vec: str, model: routing.ArmModel, cfg: RouterConfig, repeats: int,
                     batch_rows: int) -> DataFrame:
    """Runs of the micro-batch learner over ``contexts`` (``row_id``, ``vec``
    and one 0/1 column per arm), each in its own seeded order and from the
    same warm state, as ``(run, row_id, seq, arm_idx, ucb, reward, correct)``.
    The run is a key: all runs are ordered and learnt in the same jobs."""
    norm = cfg.normalised_prices
    rewards = F.array(*[F.col(a).cast("double") - F.lit(cfg.p * norm[k]) for k, a in enumerate(cfg.arms)])
    rows = contexts.select("row_id", as_double_array(vec).alias("_x"), rewards.alias("_rewards"))
    keys = rows.select("row_id", F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("run"))
    hashed = keys.withColumn("_h", F.md5(F.concat(F.lit("run"), F.col("run").cast("string"), F.lit(":"), F.col("row_id").cast("string"))))
    seq = with_group_ordinal(hashed, ["run"], ["_h", "row_id"], name="seq").drop("_h")
    ordered = join_keys(rows, seq.withColumn("_batch", F.floor((F.col("seq") - 1) / batch_rows).cast("long")), ["row_id"])
    d = model.theta.shape[1]
    dec = online.learn_microbatch(ordered, "_batch", ["seq"], "_x", "_rewards", cfg, d, keep=["row_id"],
                                  state=(model.a.copy(), model.b.copy()), run="run")
    # The reward gives the outcome back, so no label is looked up again.
    price = F.get(F.array(*[F.lit(cfg.p * v) for v in norm]), F.col("arm_idx"))
    return dec.select("run", "row_id", "seq", "arm_idx", "ucb", "reward", F.round(F.col("reward") + price, 0).cast("int").alias("correct"))

"""Command line: the three jobs with the flags and defaults of the original
programs, run as Spark jobs.

    python -m armada.cli evaluate --prompts DIR --out DIR [--model "llama 3B,gemma 2B"]
                                  [--split test] [--subset_ratio 1.0] [--batch_size 8]
                                  [--scorer module:factory]
    python -m armada.cli embed    --questions DIR --out DIR [--split auxiliary_train]
                                  [--miscellaneous_train_part K] [--embedder module:factory]
                                  [--model NAME]
    python -m armada.cli route    --train PATH --test PATH [--alpha 0] [--lambda_reg 12.94]
                                  [--gamma 1.0] [--p 0.0] [--past_context] [--update]
                                  [--update_batch_rows 1000] [--repeats 3]

Model inference is a caller-supplied factory (``module:function`` returning
the batch function); without one, the deterministic offline stand-ins are
used. Input layouts: prompts ``DIR/<split>/<task>_prompts.csv`` (test) or
``DIR/<split>/prompts.csv``; questions ``DIR/<task>/<split>.csv``; router
tables are Parquet with ``row_id``, ``embedding`` and one 0/1 column per arm.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from armada import config as C
from armada.config import RouterConfig


def _factory(spec: str | None, default):
    if not spec:
        return default
    mod, _, fn = spec.partition(":")
    return getattr(importlib.import_module(mod), fn)


def _session() -> SparkSession:
    from armada.session import ensure_checkpoint_dir, ship_package
    spark = SparkSession.builder.appName("armada").getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def cmd_evaluate(spark, a) -> None:
    from armada.operators.inference import offline_scorer_factory
    from armada.plans.jobs import evaluate
    from armada.sources import files
    from armada.sources.registry import models_frame
    from armada.functions.text import short_model_name

    names = a.model.split(",")
    known = dict(C.MODEL_REGISTRY)
    for n in names:
        if n not in known:
            raise ValueError(C.UNKNOWN_MODEL_ERROR.format(n))
    per_task = a.split == "test"
    path = f"{a.prompts}/{a.split}/" + ("*_prompts.csv" if per_task else "prompts.csv")
    prompts = files.read_prompt_files(spark, path, per_task=per_task)
    if not per_task:
        prompts = prompts.drop("task")
    factory = _factory(a.scorer, offline_scorer_factory())
    report, graded = evaluate(prompts, names, factory, split=a.split, subset_ratio=a.subset_ratio,
                              batch_rows=a.batch_size)
    ids = models_frame(spark).select("model", short_model_name("model_id").alias("model_name"))
    report = report.join(F.broadcast(ids), ["model"], "left")
    files.write_summary(report, f"{a.out}/summary")
    files.write_predictions(graded, f"{a.out}/predictions")
    cols = [c for c in ("model_name", "task", "split", "accuracy", "avg_time_sec", "n", "error") if c in report.columns]
    show(report.select(*cols).orderBy(*[c for c in ("model_name", "task") if c in cols]))


def cmd_embed(spark, a) -> None:
    from armada.operators.inference import hashing_embedder_factory
    from armada.plans.jobs import prepare_vectors
    from armada.sources import files

    if a.miscellaneous_train_part is not None and a.split != "auxiliary_train":
        raise ValueError(C.PART_SPLIT_ERROR)
    q = files.read_question_files(spark, a.questions, a.split).select("task", "row_id", "question", "choices")
    factory = _factory(a.embedder, hashing_embedder_factory(a.dim))
    vecs, rejected = prepare_vectors(q, factory, a.out, a.model.split("/")[-1], a.split, part=a.miscellaneous_train_part)
    show(vecs.groupBy("task", "part").agg(F.count("*").alias("vectors")).orderBy("task", "part"))
    show(rejected.groupBy("task", "error").agg(F.count("*").alias("rejected")).orderBy("task", "error"))


def show(df) -> None:
    """Print every row (one per model and task, or per unit), streamed."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def cmd_route(spark, a) -> None:
    from armada.operators import policy, routing
    from armada.plans.jobs import learning_repeats, pair_labels, vector_dim, warm_start

    cfg = RouterConfig(alpha=a.alpha, lam=a.lambda_reg, gamma=a.gamma, p=a.p)

    paired = {}

    def table(path, labels):
        rows = spark.read.parquet(path)
        if not labels:
            return rows
        rows, counts = pair_labels(rows, spark.read.parquet(labels).select("row_id", *cfg.arms))
        paired[path] = counts
        return rows

    test = table(a.test, a.test_labels)
    d = vector_dim(test, "embedding")
    norm = cfg.normalised_prices
    if a.past_context:
        train = table(a.train, a.train_labels)
        for k, arm in enumerate(cfg.arms):
            train = train.withColumn(f"_rw{k}", F.col(arm).cast("double") - F.lit(cfg.p * norm[k]))
        model = warm_start(train, "embedding", [f"_rw{k}" for k in range(cfg.k)], cfg, d)
    else:
        model = routing.solve(*routing.cold_start(cfg, d))
    for path, counts in paired.items():  # known since the vectors were read above
        lost = counts.get
        if lost["labels_unmatched"] or lost["vectors_unmatched"]:
            print(f"{path}: {lost['vectors_unmatched']} vectors without labels, {lost['labels_unmatched']} labels without a vector")
    arms = routing.arms_frame(spark, cfg)
    if a.update:
        out = learning_repeats(test, "embedding", model, cfg, a.repeats, a.update_batch_rows)
    else:
        # a frozen policy decides each row alone: the order of a run cannot matter, so it is run once
        dec = routing.score_contexts(test, "embedding", model, cfg.alpha, keep=["row_id", *cfg.arms])
        out = dec.withColumn("correct", F.get(F.array(*cfg.arms), F.col("arm_idx")).cast("int")).withColumn(
            "run", F.explode(F.array(*[F.lit(r) for r in range(a.repeats)])))
    out = out.join(F.broadcast(arms.select("arm_idx", "price")), ["arm_idx"], "left")
    results = policy.policy_metrics(out, ["run"]).orderBy("run").collect()  # one row per run
    for m in results:
        print(f"run {m['run']}: accuracy {m['accuracy']:.4f}, price per 10000 {m['price_per_10k']:.2f}")
    acc = sum(m["accuracy"] for m in results) / len(results)
    price = sum(m["price_per_10k"] for m in results) / len(results)
    print(C.ROUTE_SUMMARY_FORMAT.format(acc=acc, price=price))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="armada")
    sub = p.add_subparsers(dest="cmd", required=True)
    e = sub.add_parser("evaluate")
    e.add_argument("--prompts", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--model", default="llama 3B,gemma 2B")
    e.add_argument("--split", default="test", choices=C.SPLITS)
    e.add_argument("--subset_ratio", type=float, default=1.0)
    e.add_argument("--batch_size", type=int, default=8)
    e.add_argument("--scorer", default=None)
    m = sub.add_parser("embed")
    m.add_argument("--questions", required=True)
    m.add_argument("--out", required=True)
    m.add_argument("--model", default="intfloat/e5-mistral-7b-instruct")
    m.add_argument("--split", default="auxiliary_train", choices=C.SPLITS)
    m.add_argument("--miscellaneous_train_part", type=int, default=None, choices=[1, 2, 3, 4])
    m.add_argument("--embedder", default=None)
    m.add_argument("--dim", type=int, default=64, help="dimension of the offline stand-in embedder")
    r = sub.add_parser("route")
    r.add_argument("--train", default=None)
    r.add_argument("--test", required=True)
    r.add_argument("--train_labels", default=None, help="Parquet with row_id and one 0/1 column per arm, if apart")
    r.add_argument("--test_labels", default=None)
    r.add_argument("--alpha", type=float, default=C.ROUTER_DEFAULTS["alpha"])
    r.add_argument("--lambda_reg", type=float, default=C.ROUTER_DEFAULTS["lam"])
    r.add_argument("--gamma", type=float, default=C.ROUTER_DEFAULTS["gamma"])
    r.add_argument("--p", type=float, default=C.ROUTER_DEFAULTS["p"])
    r.add_argument("--past_context", action="store_true")
    r.add_argument("--update", action="store_true")
    r.add_argument("--update_batch_rows", type=int, default=1000,
                   help="rows per learning step; 1 reproduces the row-by-row loop exactly")
    r.add_argument("--repeats", type=int, default=3)
    return p


def main(argv=None) -> int:
    a = parser().parse_args(argv)
    spark = _session()
    {"evaluate": cmd_evaluate, "embed": cmd_embed, "route": cmd_route}[a.cmd](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())

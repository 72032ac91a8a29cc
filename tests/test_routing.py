"""Routing against an independent numpy learner; tie, NaN, cold-start and
price rules."""

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from armada.config import RouterConfig
from armada.operators.routing import choose, cold_start, score_contexts, solve
from armada.plans import catalogue as Q
from numpy_learner import HistoryLinUCB

SF = "/root/testdata/sf0.001"


def test_choose_rules():
    idx, _ = choose(np.array([[1.0, 1.0, 0.5], [np.nan, 0.2, 0.2], [np.nan, np.nan, np.nan]]))
    assert list(idx) == [0, 1, -1]


def test_route_64d_matches_numpy(spark):
    """q20 (warm start on the train split, frozen policy on validation)
    against plain numpy on the same rows."""
    cfg = Q.ROUTE_CFG
    split = Q._router_split(spark, SF, cfg, two_d=False).select("row_id", "split").toPandas()
    emb = pq.read_table(f"{SF}/embeddings.parquet").to_pandas()
    emb = emb.merge(split, left_on="vec_id", right_on="row_id")
    norm = cfg.normalised_prices
    ref = HistoryLinUCB(cfg.k, 64, cfg.alpha, cfg.lam, 1.0)
    train = emb[emb.split == "train"]
    X = np.vstack(train.embedding.to_numpy()).astype(np.float64)
    for k in range(cfg.k):
        corr = (((train.label.to_numpy() + 3 * k) % 5) <= k).astype(float)
        ref.extra[k] = (X.T @ X, ((corr - cfg.p * norm[k])[:, None] * X).sum(axis=0))
    val = emb[emb.split == "validation"]
    want = {int(r.vec_id): ref.choose(np.asarray(r.embedding, dtype=np.float64))[0] for r in val.itertuples()}
    got = {r["row_id"]: r["arm_idx"] for r in Q.q20_route_64d(spark, SF).collect()}
    assert got == want


def test_cold_start_picks_first_arm(spark):
    cfg = RouterConfig(alpha=1.0, lam=1.0)
    model = solve(*cold_start(cfg, 3))
    df = spark.createDataFrame([(i, [float(i), 1.0, -2.0]) for i in range(20)], "row_id long, x array<double>")
    out = score_contexts(df, "x", model, cfg.alpha, keep=["row_id"]).collect()
    assert {r["arm_idx"] for r in out} == {0}


def test_high_price_sensitivity_picks_cheapest(spark):
    """With a bias feature and a large p every arm's fitted reward is about
    -p * normalised price, so the cheapest arm (arm 0) wins everywhere."""
    from armada.plans.jobs import warm_start
    cfg = RouterConfig(alpha=0.0, lam=1.0, p=100.0)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(200):
        c = [int(v) for v in rng.integers(0, 2, size=cfg.k)]
        rows.append((i, [1.0, float(rng.normal())],
                     *[float(c[k] - cfg.p * cfg.normalised_prices[k]) for k in range(cfg.k)]))
    df = spark.createDataFrame(rows, "row_id long, x array<double>, " + ", ".join(f"r{k} double" for k in range(cfg.k)))
    model = warm_start(df, "x", [f"r{k}" for k in range(cfg.k)], cfg, 2)
    out = score_contexts(df, "x", model, cfg.alpha, keep=["row_id"]).select("arm_idx").distinct().collect()
    assert [r["arm_idx"] for r in out] == [0]


def test_repeats_equal(spark):
    r = Q.q26_repeat_mean(spark, SF).collect()[0]
    m = Q.q21_policy_eval(spark, SF).collect()[0]
    assert r["runs"] == 3 and abs(r["mean_accuracy"] - m["accuracy"]) < 1e-9


def test_exact_ties_go_to_the_first_arm(spark):
    rng = np.random.default_rng(9)
    d, k = 3, 4
    a = np.stack([np.eye(d) * 2 + (lambda m: m @ m.T)(rng.normal(size=(d, d))) for _ in range(k)])
    b = rng.normal(size=(k, d))
    b[2] = b[1]
    a[2] = a[1]                                   # arms 1 and 2 tie exactly
    rows = [(i, [float(v) for v in rng.normal(size=d)]) for i in range(300)] + [(999, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "row_id long, x array<double>")
    got = {r["row_id"]: r["arm_idx"] for r in score_contexts(df, "x", solve(a, b), 0.8, keep=["row_id"]).collect()}
    assert 2 not in got.values() and got[999] == 0


@pytest.mark.parametrize("d", [1, 2, 16, 17, 64, 128, 129, 192])
def test_one_rule_at_every_size(spark, d):
    """A NULL or NaN context is skipped and gets no arm, a NULL reward adds
    nothing to its arm, a wrong length fails - whatever the vector length."""
    from armada.plans.jobs import warm_start
    cfg = RouterConfig(alpha=0.5, lam=1.5)
    rng = np.random.default_rng(d)
    x = rng.normal(size=(40, d))
    r = rng.random((40, cfg.k))
    rows = [(i, x[i].tolist(), *[None if (i, k) == (7, 1) else float("nan") if (i, k) == (8, 2) else float(r[i, k])
                                  for k in range(cfg.k)]) for i in range(40)]
    odd = [(100, None, *[1.0] * cfg.k), (101, [float("nan")] * d, *[1.0] * cfg.k), (102, [None] * d, *[1.0] * cfg.k)]
    cols = [f"r{k}" for k in range(cfg.k)]
    df = spark.createDataFrame(rows + odd, "row_id long, x array<double>, " + ", ".join(f"{c} double" for c in cols))
    model = warm_start(df, "x", cols, cfg, d)
    r[7, 1] = r[8, 2] = 0.0
    assert np.allclose(model.a[0], cfg.lam * np.eye(d) + x.T @ x)
    assert np.allclose(model.b, r.T @ x)
    got = {row["row_id"]: row for row in score_contexts(df, "x", model, cfg.alpha, keep=["row_id"]).collect()}
    for i in (100, 101, 102):
        assert got[i]["arm_idx"] is None and got[i]["ucb"] is None
    inv = np.linalg.inv(model.a[0])
    want = x @ inv @ model.b.T + cfg.alpha * np.sqrt(np.einsum("nd,de,ne->n", x, inv, x))[:, None]
    assert [got[i]["arm_idx"] for i in range(40)] == want.argmax(axis=1).tolist()
    long = spark.createDataFrame([(1, [1.0] * (d + 1))], "row_id long, x array<double>")
    with pytest.raises(Exception, match="numbers instead of"):
        score_contexts(long, "x", model, cfg.alpha, keep=["row_id"]).collect()

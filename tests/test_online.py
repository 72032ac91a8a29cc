"""Closed-loop learners against plain loops."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from armada.config import RouterConfig
from armada.operators.online import learn_by_key, learn_microbatch
from numpy_learner import HistoryLinUCB

SF = "/root/testdata/sf0.001"
CFG = RouterConfig(arms=("a0", "a1"), prices=(1.0, 1.0), alpha=0.5, lam=2.0, gamma=0.9)


def _events():
    ev = pq.read_table(f"{SF}/events.parquet").to_pandas().sort_values(["ts", "event_id"])
    ev["x"] = ev.value / 100.0
    ev["r0"] = (ev.event_id % 3 == 0).astype(float)
    ev["r1"] = ((ev.event_id + 1) % 3 == 0).astype(float)
    return ev


def _spark_events(spark):
    from armada.sources.tables import user_events
    return user_events(spark, SF)


def test_learn_by_key_equals_loop(spark):
    ev = _events()
    want = {}
    for _, g in ev.groupby("user_id"):
        m = HistoryLinUCB(2, 1, CFG.alpha, CFG.lam, CFG.gamma)
        for r in g.itertuples():
            x = np.array([r.x])
            arm, _ = m.choose(x)
            rew = r.r0 if arm == 0 else r.r1
            m.update(arm, x, rew)
            want[r.event_id] = arm
    got = learn_by_key(_spark_events(spark), "user_id", ["ts", "event_id"], "x", "rewards", CFG, 1,
                       keep=["event_id"]).collect()
    assert {r["event_id"]: r["arm_idx"] for r in got} == want


def test_microbatch_equals_loop(spark):
    ev = _events()
    ev["day"] = ev.ts.dt.strftime("%Y-%m-%d")
    ref = HistoryLinUCB(2, 1, CFG.alpha, CFG.lam, CFG.gamma)
    want = {}
    for day, g in ev.groupby("day", sort=True):
        chosen = [(r, np.array([r.x]), ref.choose(np.array([r.x]))[0]) for r in g.itertuples()]
        for r, x, arm in chosen:  # the batch's updates, in order
            want[r.event_id] = arm
            ref.update(arm, x, r.r0 if arm == 0 else r.r1)
    df = _spark_events(spark).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    got = learn_microbatch(df, "day", ["ts", "event_id"], "x", "rewards", CFG, 1, keep=["event_id"]).collect()
    assert {r["event_id"]: r["arm_idx"] for r in got} == want


def test_sherman_morrison_learner_matches_inverse():
    from armada.operators.online import ArmLearner, _pick
    rng = np.random.default_rng(11)
    fast = ArmLearner(3, 4, 1.5, 0.95, 0.7)
    ref = HistoryLinUCB(3, 4, 0.7, 1.5, 0.95)
    for _ in range(300):
        x = rng.normal(size=4)
        s1, s2 = fast.scores(x), ref.scores(x)
        assert np.allclose(s1, s2, rtol=1e-9, atol=1e-9)
        arm, _ = _pick(s1)
        r = float(rng.random())
        fast.update(arm, x, r)
        ref.update(arm, x, r)
    a, b = fast.state()
    for arm in range(3):
        want_a, want_b = ref.state(arm)
        assert np.allclose(a[arm], want_a, rtol=1e-8) and np.allclose(b[arm], want_b)


def test_microbatch_with_one_row_batches_is_the_row_by_row_loop(spark):
    """Batches of one row: the micro-batch learner is the closed loop."""
    ev = _events().head(40)
    ref = HistoryLinUCB(2, 1, CFG.alpha, CFG.lam, CFG.gamma)
    want = {}
    for r in ev.itertuples():
        x = np.array([r.x])
        arm, _ = ref.choose(x)
        ref.update(arm, x, r.r0 if arm == 0 else r.r1)
        want[r.event_id] = arm
    ids = [int(v) for v in ev.event_id]
    # one batch per event, numbered in (ts, event_id) order
    steps = spark.createDataFrame([(e, i) for i, e in enumerate(ids)], "event_id long, step long")
    df = _spark_events(spark).join(steps, ["event_id"])
    got = learn_microbatch(df, "step", ["ts", "event_id"], "x", "rewards", CFG, 1, keep=["event_id"]).collect()
    assert {r["event_id"]: r["arm_idx"] for r in got} == want


def test_learn_by_key_null_key_is_one_learner(spark):
    rows = [(None, i, [0.5], [1.0, 0.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "user_id long, t long, x array<double>, rewards array<double>")
    with_null = learn_by_key(df, "user_id", ["t"], "x", "rewards", CFG, 1, keep=["t"]).orderBy("t").collect()
    keyed = learn_by_key(df.fillna({"user_id": 7}), "user_id", ["t"], "x", "rewards", CFG, 1,
                         keep=["t"]).orderBy("t").collect()
    assert [r["arm_idx"] for r in with_null] == [r["arm_idx"] for r in keyed]
    assert [r["ucb"] for r in with_null] == [r["ucb"] for r in keyed]


@pytest.mark.parametrize("d", [1, 4, 130])
def test_learners_skip_odd_rows_and_keep_batch_values(spark, d):
    """Both learners with NULL and NaN contexts, NULL rewards, a NULL batch
    and batch values that look alike; two lazy results live side by side."""
    rng = np.random.default_rng(d)
    x, r = rng.normal(size=(24, d)), rng.random((24, 2))
    batches = [None, "01", "002", "1"]
    rows, ref, want = [], HistoryLinUCB(2, d, CFG.alpha, CFG.lam, CFG.gamma), {}
    for i in range(24):
        batch = sorted(batches, key=lambda v: (v is not None, v))[i // 6]
        vec = None if i == 3 else [float("nan")] * d if i == 9 else x[i].tolist()
        rows.append((i, batch, vec, [None if i == 14 else float(r[i, 0]), None if i == 14 else float(r[i, 1])]))
    for b in range(4):
        chosen = [(i, ref.choose(x[i])[0]) for i in range(6 * b, 6 * b + 6) if i not in (3, 9)]
        for i, arm in chosen:
            want[i] = (rows[i][1], arm)
            if i != 14:
                ref.update(arm, x[i], r[i, arm])
    want |= {3: (rows[3][1], None), 9: (rows[9][1], None)}
    df = spark.createDataFrame(rows, "i long, batch string, x array<double>, rewards array<double>").repartition(3)
    one = learn_microbatch(df, "batch", ["i"], "x", "rewards", CFG, d)
    two = learn_microbatch(df, "batch", ["i"], "x", "rewards", CFG, d)
    for out in (one, two):
        got = {row["i"]: row for row in out.collect()}
        assert {i: (row["batch"], row["arm_idx"]) for i, row in got.items()} == want
        assert got[14]["reward"] is None and got[3]["reward"] is None and got[9]["ucb"] is None
    # one learner over all rows, row by row
    seq, loop = HistoryLinUCB(2, d, CFG.alpha, CFG.lam, CFG.gamma), {3: None, 9: None}
    for i in range(24):
        if i not in (3, 9):
            loop[i] = seq.choose(x[i])[0]
            if i != 14:
                seq.update(loop[i], x[i], r[i, loop[i]])
    keyed = learn_by_key(df.withColumn("k", F.lit(1)), "k", ["i"], "x", "rewards", CFG, d, keep=["i"]).collect()
    assert {row["i"]: row["arm_idx"] for row in keyed} == loop

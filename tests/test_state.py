"""State tables of tiles against dense numpy, and learners over many blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from armada.config import RouterConfig
from armada.operators import online, state
from armada.operators.routing import _scores, choose, cold_start, solve
from armada.plans import jobs
from armada.sources.tables import user_events
from numpy_learner import HistoryLinUCB

SF = "/root/testdata/sf0.001"
CFG = RouterConfig(arms=("a0", "a1"), prices=(1.0, 1.0), alpha=0.5, lam=2.0, gamma=0.9)


@pytest.mark.parametrize("d", [1, 256, 300, 520])
def test_blocked_factor_equals_plain_inverse(d):
    x = np.random.default_rng(d).standard_normal((2 * d, d))
    a = x.T @ x + np.eye(d)
    inv = state.inverse_factor(a.copy())
    assert np.allclose(inv.T @ inv @ a, np.eye(d), atol=1e-8) and np.allclose(inv, np.tril(inv))


@pytest.mark.parametrize("d", [3, 300])
def test_cold_tiles_and_merge_equal_dense(spark, d):
    cold = state.cold_tiles(spark, CFG, d)
    model, want = state.solve_state(cold, CFG, d), solve(*cold_start(CFG, d))
    assert np.allclose(model.a, want.a) and np.allclose(model.b, want.b) and np.allclose(model.chol_inv[0][0], want.chol_inv[0][0])
    rng = np.random.default_rng(1)
    x, r = rng.standard_normal((5, d)), rng.random(5)
    add, sums = x.T @ x, x.T @ r
    rows = [(1, i, j, 5, add[i:i + 256, j:j + 256].ravel().tolist(), sums[i:i + 256].tolist() if i == j else None)
            for i in range(0, d, 256) for j in range(i, d, 256)]
    stats = spark.createDataFrame(rows, "_arm int, ti int, tj int, n long, v array<double>, bv array<double>")
    model = state.solve_state(state.merge_tiles(cold, stats, 0.9), CFG, d)
    assert np.allclose(model.a[0], 2 * np.eye(d)) and np.allclose(model.a[1], 0.9 ** 5 * 2 * np.eye(d) + add)
    assert np.allclose(model.b[1], sums) and np.allclose(model.theta[1], np.linalg.solve(model.a[1], sums))


@pytest.mark.parametrize("d", [3, 300])
def test_a_direction_discounted_to_nothing_is_solved(spark, d):
    """0.9^10000 is zero as a double: the rows taught only the last direction."""
    rows = [(1, i, j, 10_000, [10.0 if i == j and i + p // w == d - 1 and p % w == w - 1 else 0.0 for p in range(min(256, d - i) * w)],
             [0.0] * (min(256, d - i) - 1) + [4.0 if i + 256 >= d else 0.0] if i == j else None)
            for i in range(0, d, 256) for j in range(i, d, 256) for w in [min(256, d - j)]]
    stats = spark.createDataFrame(rows, "_arm int, ti int, tj int, n long, v array<double>, bv array<double>")
    model = state.solve_state(state.merge_tiles(state.cold_tiles(spark, CFG, d), stats, 0.9), CFG, d)
    assert model.a[1][0, 0] == 0.0 and model.a[1][d - 1, d - 1] == 10.0  # the state itself is kept as it is
    other = solve(model.a, model.b)
    for m in (model, other):
        s = _scores(np.eye(d), m, CFG.alpha)
        assert np.isfinite(s).all() and np.allclose(m.theta[1], [0.0] * (d - 1) + [0.4])
        assert (s[:-1, 1] > 1e100).all() and abs(s[-1, 1] - (0.4 + 0.5 / np.sqrt(10))) < 1e-9
        assert (choose(s)[0] == [1] * (d - 1) + [int(s[-1, 1] > s[-1, 0])]).all()


@pytest.mark.parametrize("d", [4, 300])
def test_a_ridge_below_the_last_digit_is_solved(d):
    """Contexts of a subspace: discounts leave a matrix of lower rank."""
    z = np.random.default_rng(d).standard_normal((d // 2, d))
    a, x = z.T @ z, z[0]
    inv = state.inverse_factor(a.copy())
    model = solve(a[None], (a @ z[0])[None])
    for mean, spread in ((x @ inv.T @ inv @ (a @ z[0]), np.square(inv @ x).sum()),
                         (x @ model.theta[0], np.square(model.chol_inv[0][0] @ x).sum())):
        assert abs(mean - x @ x) < 1e-3 * (x @ x) and abs(spread - 1) < 1e-3
    with pytest.raises(np.linalg.LinAlgError):
        state.inverse_factor(-np.eye(d))


def test_warm_start_equals_numpy_and_an_empty_one_is_cold(spark):
    d, rng = 290, np.random.default_rng(4)
    x, r = rng.standard_normal((400, d)), rng.random((400, 2))
    df = spark.createDataFrame([(v.tolist(), float(p), float(q)) for v, (p, q) in zip(x, r)], "x array<double>, r0 double, r1 double")
    model = jobs.warm_start(df, "x", ["r0", "r1"], CFG, d)
    a = CFG.lam * np.eye(d) + x.T @ x
    assert np.allclose(model.a[1], a) and np.allclose(model.theta, np.linalg.solve(a, x.T @ r).T) and np.allclose(model.b, (x.T @ r).T)
    none = jobs.warm_start(df.limit(0), "x", ["r0", "r1"], CFG, 3)
    assert np.allclose(none.theta, 0) and np.allclose(none.a[0], CFG.lam * np.eye(3))


@pytest.mark.parametrize("block_rows", [7, 60, 300, 10**6])
def test_many_blocks_and_large_batches_give_one_learner(spark, block_rows):
    """Blocks of many batches, batches of many blocks and both kinds mixed."""
    ev = user_events(spark, SF).withColumn("x", F.array(F.col("value") / 100, F.lit(1.0)))
    # batches of 1 to 200 rows in the order of the ids
    batch = F.when(F.col("event_id") < 40, F.col("event_id")).when(F.col("event_id") < 240, 40).otherwise(41 + F.floor(F.col("event_id") / 33))
    df = ev.withColumn("batch", batch.cast("long"))
    got = online.learn_microbatch(df, "batch", ["event_id"], "x", "rewards", CFG, 2, block_rows=block_rows).collect()
    ref, want = HistoryLinUCB(2, 2, CFG.alpha, CFG.lam, CFG.gamma), {}
    rows = sorted((r.batch, r.event_id, r.x, r.rewards) for r in df.collect())
    for b in sorted({r[0] for r in rows}):
        chosen = [(r, ref.choose(np.array(r[2]))) for r in rows if r[0] == b]
        for r, (arm, score) in chosen:
            want[r[1]] = (arm, score)
            ref.update(arm, np.array(r[2]), r[3][arm])
    assert len(got) == len(want) and all(r.arm_idx == want[r.event_id][0] and abs(r.ucb - want[r.event_id][1]) < 1e-7 for r in got)


@pytest.mark.parametrize("block_rows", [40, 10**6])
def test_runs_are_learners_of_their_own(spark, block_rows):
    ev = user_events(spark, SF).where("event_id < 200").withColumn("batch", F.floor(F.col("event_id") / 50))
    both = ev.withColumn("run", F.explode(F.array(F.lit(3), F.lit(8)))).where((F.col("run") == 3) | (F.col("event_id") % 2 == 0))
    got = online.learn_microbatch(both, "batch", ["event_id"], "x", "rewards", CFG, 1, run="run", block_rows=block_rows)
    for run in (3, 8):
        alone = online.learn_microbatch(both.where(F.col("run") == run).drop("run"), "batch", ["event_id"], "x", "rewards", CFG, 1)
        mine = {r.event_id: (r.arm_idx, round(r.ucb, 9), r.reward) for r in got.where(F.col("run") == run).collect()}
        assert mine == {r.event_id: (r.arm_idx, round(r.ucb, 9), r.reward) for r in alone.collect()} and len(mine) == (200 if run == 3 else 100)

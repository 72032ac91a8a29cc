"""Gram / reward sums / discounting against direct numpy computation."""

import numpy as np
from pyspark.sql import functions as F

from armada.operators.online import _merged
from armada.operators.stats import discounted_table, gram, reward_sums


def _dense(rows, d, key=None):
    m = np.zeros((d, d))
    for r in rows:
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["a"]
    return m


def test_gram(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 7))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(300)], "i long, x array<double>")
    want = 2.5 * np.eye(7) + x.T @ x
    got = _dense(gram(df, "x", 7, lam=2.5).collect(), 7)
    assert np.allclose(got, want, atol=1e-9)
    assert np.all(np.linalg.eigvalsh(want) > 0)


def test_reward_sums(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    r = rng.integers(0, 2, size=(50, 2)).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(r[i, 0]), float(r[i, 1])) for i in range(50)],
                               "i long, x array<double>, r0 double, r1 double")
    wide = {(row["arm_idx"], row["i"]): row["b"] for row in reward_sums(df, "x", 3, ["r0", "r1"]).collect()}
    for k in range(2):
        want = (x * r[:, k:k + 1]).sum(axis=0)
        assert np.allclose([wide[(k, i)] for i in range(3)], want)


def test_discounted_equals_sequential(spark):
    rng = np.random.default_rng(2)
    n, d, gamma, lam = 400, 2, 0.97, 1.5
    arms = rng.integers(0, 3, size=n)
    x = rng.normal(size=(n, d))
    r = rng.random(n)
    df = spark.createDataFrame([(i, int(arms[i]), [float(v) for v in x[i]], float(r[i])) for i in range(n)],
                               "t long, arm int, x array<double>, r double")
    table = discounted_table(df, "x", "r", "arm", ["t"], d, gamma, lam).collect()
    A = {k: lam * np.eye(d) for k in range(3)}
    B = {k: np.zeros(d) for k in range(3)}
    for i in range(n):
        k = arms[i]
        A[k] = gamma * A[k] + np.outer(x[i], x[i])
        B[k] = gamma * B[k] + r[i] * x[i]
    for k in range(3):
        got = _dense([row for row in table if row["arm"] == k], d)
        assert np.allclose(got, A[k], atol=1e-9)
        gb = {row["i"]: row["b0"] for row in table if row["arm"] == k and row["i"] == row["j"]}
        assert np.allclose([gb[i] for i in range(d)], B[k], atol=1e-9)


def test_merge_is_associative():
    rng = np.random.default_rng(3)
    g = 0.9
    parts = [(int(rng.integers(1, 5)), rng.normal(size=(2, 2)), rng.normal(size=2)) for _ in range(3)]

    def merge(p, q):
        return _merged(p, q, g)

    left = merge(merge(parts[0], parts[1]), parts[2])
    right = merge(parts[0], merge(parts[1], parts[2]))
    assert left[0] == right[0] and np.allclose(left[1], right[1]) and np.allclose(left[2], right[2])


def test_tiled_plan_across_tile_edges(spark):
    from armada.operators.stats import ridge_stats
    rng = np.random.default_rng(4)
    n, d = 120, 300
    x = rng.normal(size=(n, d))
    r = rng.random(size=(n, 2))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(r[i, 0]), float(r[i, 1])) for i in range(n)],
                               "i long, x array<double>, r0 double, r1 double").repartition(5)
    pdf = ridge_stats(df, "x", d, ["r0", "r1"], lam=0.5).toPandas()
    assert len(pdf) == d * (d + 1) // 2
    m = np.zeros((d, d))
    m[pdf.i, pdf.j] = pdf.a
    want = 0.5 * np.eye(d) + x.T @ x
    assert np.allclose(np.triu(m), np.triu(want), atol=1e-8)
    diag = pdf[pdf.i == pdf.j].sort_values("i")
    assert np.allclose(diag.b0, (x * r[:, :1]).sum(axis=0)) and np.allclose(diag.b1, (x * r[:, 1:]).sum(axis=0))

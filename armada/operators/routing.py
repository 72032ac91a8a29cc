"""Linear upper-confidence-bound routing: solve per-arm ridge regressions,
score contexts against every arm, choose one arm per context.

The arm statistics (K matrices d x d, K vectors d) are the model. They are
collected once per state version - their size depends on K and d, never on
the number of rows - solved with numpy (Cholesky), and shipped to executors
inside the scoring closure. Scoring is one pass over Arrow batches for every
d: ``X @ Theta^T`` plus, when ``alpha > 0``, ``alpha * ||L^-1 x||``. No shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armada.config import RouterConfig
from armada.functions.vectors import context_rows


@dataclass
class ArmModel:
    """Solved state: ``theta`` (K, d) and ``chol_inv`` = ``(factors, factor_of)``:
    the distinct inverse Cholesky factors L^-1 (U, d, d) with
    ``x^T A^-1 x = ||L^-1 x||^2``, and the factor index of every arm (K,).
    Arms sharing one Gram (warm start) share one factor. ``chol_inv`` may
    be None when only means are needed (alpha = 0)."""

    theta: np.ndarray
    chol_inv: np.ndarray
    a: np.ndarray
    b: np.ndarray

    @property
    def k(self) -> int:
        return self.theta.shape[0]

    @property
    def d(self) -> int:
        return self.theta.shape[1]


def cold_start(cfg: RouterConfig, d: int):
    """``A = lam I``, ``b = 0`` for every arm."""
    a = np.repeat((cfg.lam * np.eye(d))[None, :, :], cfg.k, axis=0)
    return a, np.zeros((cfg.k, d))


def state_from_rows(rows, cfg: RouterConfig, d: int):
    """Dense state from ``ridge_stats`` output with one shared Gram
    (``i, j, a``) and per-arm reward sums ``b0..b{K-1}`` on the diagonal.
    ``rows`` is a pandas DataFrame (Arrow transfer) or a list of Rows."""
    import pandas as pd
    a, b = cold_start(cfg, d)
    pdf = rows if isinstance(rows, pd.DataFrame) else pd.DataFrame([r.asDict() for r in rows])
    if len(pdf):
        i = pdf["i"].to_numpy(dtype=np.int64)
        j = pdf["j"].to_numpy(dtype=np.int64)
        m = np.zeros((d, d))
        m[i, j] = pdf["a"].to_numpy(dtype=np.float64)
        m[j, i] = pdf["a"].to_numpy(dtype=np.float64)
        a[:] = m
        diag = pdf[i == j]
        for k in range(cfg.k):
            b[k, diag["i"].to_numpy(dtype=np.int64)] = diag[f"b{k}"].to_numpy(dtype=np.float64)
    return a, b


#: Least diagonal number of a matrix that is solved.
LEAST_DIAGONAL = 1e-300


def kept_diagonal(a: np.ndarray) -> np.ndarray:
    """``a`` with the diagonal numbers that long discounting has brought to
    zero, or near it, raised to ``LEAST_DIAGONAL``: a direction of which nothing
    is left keeps a finite score above every direction that was seen since."""
    diagonal = np.diagonal(a)
    gone = np.flatnonzero((diagonal >= 0.0) & (diagonal < LEAST_DIAGONAL))
    if len(gone):
        a = a.copy()
        a[gone, gone] = LEAST_DIAGONAL
    return a


def lower_factor(a: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Cholesky factor of ``a``. A matrix that only rounding keeps from having
    one (its oldest part, the ridge, is below the last digit of the rest)
    gets some last digits of ``diagonal`` added; any other fails."""
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        for digits in 10.0 ** np.arange(4):
            try:
                return np.linalg.cholesky(a + np.diag(digits * len(a) * np.finfo(np.float64).eps * diagonal))
            except np.linalg.LinAlgError:
                pass
        raise


def solve(a: np.ndarray, b: np.ndarray) -> ArmModel:
    """``theta_k = A_k^-1 b_k`` by Cholesky, once per state version; equal
    matrices are factorised once."""
    k, d = b.shape
    theta = np.empty((k, d))
    factors, factor_of, seen = [], np.empty(k, dtype=np.int64), {}
    for i in range(k):
        key = a[i].tobytes()
        if key not in seen:
            whole = kept_diagonal(a[i])
            lo = lower_factor(whole, np.diagonal(whole))
            seen[key] = len(factors)
            factors.append(np.linalg.solve(lo, np.eye(d)))
        factor_of[i] = seen[key]
        li = factors[factor_of[i]]
        theta[i] = li.T @ (li @ b[i])
    return ArmModel(theta=theta, chol_inv=(np.stack(factors), factor_of), a=a, b=b)


def _factor_set(model: ArmModel):
    ci = model.chol_inv
    if ci is None:
        return None, None
    if isinstance(ci, tuple):
        return ci
    return ci, np.arange(len(ci))


def _scores(x: np.ndarray, model: ArmModel, alpha: float) -> np.ndarray:
    """UCB of every arm for a batch of contexts."""
    mean = x @ model.theta.T
    if alpha == 0.0:
        return mean
    factors, factor_of = _factor_set(model)
    unc = np.stack([np.sqrt(np.square(x @ li.T).sum(axis=1)) for li in factors], axis=1)
    return mean + alpha * unc[:, factor_of]


def decide(vectors, model: ArmModel, alpha: float):
    """Arm (-1: none), its score, all scores, contexts and the mask of usable
    contexts for a column of vectors."""
    x, ok = context_rows(vectors, model.d)
    s = _scores(x, model, alpha)
    s[~ok] = np.nan
    idx, best = choose(s)
    return idx, best, s, x, ok


def choose(scores: np.ndarray):
    """Arg-max per row: first arm wins ties, NaN is never chosen, a row with
    no finite score gets no arm (-1)."""
    s = np.where(np.isnan(scores), -np.inf, scores)
    idx = np.argmax(s, axis=1)
    best = s[np.arange(len(s)), idx]
    idx = np.where(np.isneginf(best) & np.all(np.isneginf(s), axis=1), -1, idx)
    return idx, best


def score_contexts(df: DataFrame, vec: str, model: ArmModel, alpha: float, keep: list,
                   with_scores: bool = False) -> DataFrame:
    """Score every context against every arm and choose one arm.

    Adds ``arm_idx`` (int), ``ucb`` (chosen score) and optionally ``scores``
    (array of K doubles); all NULL for a context that is NULL or holds a
    NULL, NaN or infinite element. A context of another length than the
    model's fails the job. The kept columns pass through Arrow unchanged."""
    keep = list(keep)
    fields = [df.schema[c] for c in keep] + [
        T.StructField("arm_idx", T.IntegerType()), T.StructField("ucb", T.DoubleType())]
    if with_scores:
        fields.append(T.StructField("scores", T.ArrayType(T.DoubleType())))
    theta = model.theta
    linv = model.chol_inv if alpha != 0.0 else None   # means only: ship no factors

    def run(batches):
        import pyarrow as pa
        m = ArmModel(theta=theta, chol_inv=linv, a=None, b=None)
        for batch in batches:
            idx, best, s, _, _ = decide(batch.column(len(keep)), m, alpha)
            none = idx < 0
            cols = [batch.column(i) for i in range(len(keep))] + [
                pa.array(idx.astype(np.int32), mask=none), pa.array(best, mask=none)]
            if with_scores:
                cols.append(pa.array([None if n else list(r) for n, r in zip(none, s)], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(cols, [*keep, "arm_idx", "ucb", *(["scores"] if with_scores else [])])

    return df.select(*[F.col(c) for c in keep], F.col(vec).alias("_context")).mapInArrow(run, T.StructType(fields))


def arms_frame(spark, cfg: RouterConfig) -> DataFrame:
    """The arm catalogue ``(arm_idx, arm, price)``, K rows."""
    rows = [(i, a, float(p)) for i, (a, p) in enumerate(zip(cfg.arms, cfg.prices))]
    return spark.createDataFrame(rows, "arm_idx int, arm string, price double")


def normalised_prices(arms: DataFrame) -> DataFrame:
    """``price / max(price)`` next to each arm (window over the K-row table)."""
    return arms.withColumn("norm_price", F.col("price") / F.max("price").over(Window.partitionBy()))

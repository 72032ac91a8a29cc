"""Model state as tables of tiles.

The statistics of a learner (K matrices d x d and K vectors d) are kept as
rows of 256 x 256 tiles of the upper triangle, with the reward sums on the
diagonal tiles: ``(arm_idx, ti, tj, v, b)``. Spark makes, joins, discounts
and writes these rows; numbers stay packed in arrays on their way through
Arrow. Solving brings the tiles of one matrix, never its cells one by one,
to one executor task, which factorises it block by block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.config import RouterConfig
from armada.operators.routing import ArmModel, kept_diagonal, lower_factor
from armada.operators.stats import TILE
from armada.session import materialize

STATE_SCHEMA = "arm_idx int, ti int, tj int, v array<double>, b array<double>"
FACTOR_SCHEMA = "gram int, ti int, tj int, v array<double>, theta array<double>"


def cold_tiles(spark, cfg: RouterConfig, d: int) -> DataFrame:
    """``A = lam I``, ``b = 0`` of every arm, made by Spark."""
    last = (d - 1) // TILE * TILE
    side = "least({0}, {1} - {{}})".format(TILE, d)
    rows, cols = side.format("ti"), side.format("tj")
    cells = (f"transform(sequence(0, {rows} * {cols} - 1), p -> IF(ti = tj AND p div {cols} = p % {cols}, "
             f"{cfg.lam!r}D, 0D))")
    places = spark.range(cfg.k).selectExpr("CAST(id AS INT) AS arm_idx", f"explode(sequence(0, {last}, {TILE})) AS ti")
    places = places.selectExpr("arm_idx", "ti", f"explode(sequence(ti, {last}, {TILE})) AS tj")
    return places.selectExpr("arm_idx", "ti", "tj", f"{cells} AS v", f"IF(ti = tj, array_repeat(0D, {rows}), NULL) AS b")


def merge_tiles(state: DataFrame, stats: DataFrame, gamma: float) -> DataFrame:
    """The state after a batch: every arm's tiles discounted once per row that
    taught it, plus the batch's statistics ``(_arm, ti, tj, n, v, bv)``."""
    new = stats.select(F.col("_arm").alias("arm_idx"), "ti", "tj", "n", F.col("v").alias("_v"), "bv")
    fade = F.pow(F.lit(float(gamma)), F.col("n").cast("double"))

    def folded(old, add):
        return F.when(F.col("n").isNull(), F.col(old)).otherwise(F.zip_with(old, add, lambda x, y: fade * x + y))

    return state.join(new, ["arm_idx", "ti", "tj"], "left").select("arm_idx", "ti", "tj", folded("v", "_v").alias("v"), folded("b", "bv").alias("b"))


def inverse_factor(a: np.ndarray, block: int = TILE) -> np.ndarray:
    """``L^-1`` of ``a = L L'``, block column by block column; ``a`` is overwritten."""
    d = len(a)
    cuts = [slice(i, min(i + block, d)) for i in range(0, d, block)]
    a = kept_diagonal(a)
    inverse, diagonal = np.zeros_like(a), np.diagonal(a).copy()
    for k, here in enumerate(cuts):
        low = lower_factor(a[here, here], diagonal[here])
        inv = np.linalg.solve(low, np.eye(len(low)))
        a[here, here], inverse[here, here] = low, inv
        below = slice(here.stop, d)
        a[below, here] = a[below, here] @ inv.T
        a[below, below] -= a[below, here] @ a[below, here].T
    for i, here in enumerate(cuts):  # rows of the inverse from the rows above
        if here.start:
            above = slice(0, here.start)
            inverse[here, above] = -inverse[here, here] @ (a[here, above] @ inverse[above, above])
    return inverse


def _tiles_of(table, d: int):
    """(i, j, tile) of every row of an Arrow table, without a Python list of its numbers."""
    at = [table[c].to_numpy().tolist() for c in ("ti", "tj")]
    v = table["v"].combine_chunks()
    cells, starts = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy())])
    for k, (i, j) in enumerate(zip(*at)):
        here, there = slice(i, min(i + TILE, d)), slice(j, min(j + TILE, d))
        yield k, here, there, cells[starts[k]:starts[k + 1]].reshape(here.stop - i, there.stop - j)


def solve_tiles(tiles: DataFrame, k: int, d: int, lam: float = 0.0) -> ArmModel:
    """Solve the matrices of ``(gram, ti, tj, v, b)``: ``b`` of a diagonal tile
    holds its rows' reward sums, for every arm of the matrix beside each
    other. One task per matrix; arms follow one another by ``gram``. The
    driver gets the model: U factors of d x d and K vectors of d."""
    def run(table):
        import pyarrow as pa
        a, b = lam * np.eye(d), None
        for row, here, there, tile in _tiles_of(table, d):
            a[here, there] += tile
            if here == there:
                sums = table["b"][row].values
                sums = sums.to_numpy(zero_copy_only=False).reshape(here.stop - here.start, -1)
                b = np.zeros((d, sums.shape[1])) if b is None else b
                b[here] = sums
        a = np.triu(a) + np.triu(a, 1).T
        inverse = inverse_factor(a)
        theta = inverse.T @ (inverse @ b)
        out = []
        for i in range(0, d, TILE):
            for j in range(0, i + TILE, TILE):
                out.append((table["gram"][0].as_py(), i, j, inverse[i:i + TILE, j:j + TILE].ravel(),
                            theta[i:i + TILE].ravel() if i == j else None))
        types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], ["gram", "ti", "tj", "v", "theta"])

    tiles = materialize(tiles.select("gram", "ti", "tj", "v", "b"), "tiles")
    solved = tiles.groupBy("gram").applyInArrow(run, FACTOR_SCHEMA).toArrow()
    if not solved.num_rows:  # nothing to learn from: the ridge term alone
        a = np.broadcast_to(lam * np.eye(d), (k, d, d))
        return ArmModel(np.zeros((k, d)), (np.eye(d)[None] / np.sqrt(lam), np.zeros(k, np.int64)), a, np.zeros((k, d)))
    grams = solved["gram"].to_numpy()
    names = np.unique(grams)
    factors, thetas = np.zeros((len(names), d, d)), [None] * len(names)
    for row, here, there, tile in _tiles_of(solved, d):
        u = int(np.searchsorted(names, grams[row]))
        factors[u, here, there] = tile
        if here == there:
            part = solved["theta"][row].values.to_numpy(zero_copy_only=False).reshape(here.stop - here.start, -1)
            thetas[u] = np.zeros((d, part.shape[1])) if thetas[u] is None else thetas[u]
            thetas[u][here] = part
    theta = np.concatenate(thetas, axis=1).T
    if theta.shape != (k, d):
        raise ValueError(f"solved {theta.shape} instead of {(k, d)}")
    factor_of = np.repeat(np.arange(len(names)), [t.shape[1] for t in thetas])
    given, first = tiles.toArrow(), np.searchsorted(factor_of, np.arange(len(names)))
    grams, b = given["gram"].to_numpy(), np.zeros((k, d))
    a = np.repeat((lam * np.eye(d))[None], len(names), axis=0)
    for row, here, there, tile in _tiles_of(given, d):
        u = int(np.searchsorted(names, grams[row]))
        a[u, here, there] += tile
        if here == there:
            sums = given["b"][row].values.to_numpy(zero_copy_only=False).reshape(here.stop - here.start, -1)
            b[first[u]:first[u] + sums.shape[1], here] = sums.T
    for u in range(len(names)):
        a[u] = np.triu(a[u]) + np.triu(a[u], 1).T
    a = np.broadcast_to(a[0], (k, d, d)) if len(names) == 1 else a[factor_of]
    return ArmModel(theta=theta, chol_inv=(factors, factor_of), a=a, b=b)


def solve_state(state: DataFrame, cfg: RouterConfig, d: int) -> ArmModel:
    """Solve a learner's state, one matrix an arm."""
    return solve_tiles(state.withColumnRenamed("arm_idx", "gram"), cfg.k, d)

"""Per-arm sufficient statistics of ridge regression as distributed aggregates.

For an arm with contexts x (d-vectors) and rewards r:

    A = lam * I + sum_t w_t x_t x_t^T        b = sum_t w_t r_t x_t

with w_t = 1 (plain) or gamma^(rows of the same arm after t) (discounted).
Results are long tables ``(group..., i, j, a)`` (upper triangle, j >= i) and
``(group..., i, b)``: they are the model, their size is K*d^2 whatever the
number of rows.

One plan for every d: a bounded number of tasks compute ``X^T W X`` and
``X^T W R`` with numpy (one product per Arrow batch) and ship them as
upper-triangle tiles, which are summed in two levels (first within groups of
tasks, then per tile), so one tile key never meets all partials at once.

One rule for every d: a row without a usable context (NULL, or a NULL, NaN
or infinite element) or weight is skipped; a reward that is NULL or NaN adds
nothing to its arm's ``b``; a context of another length fails the job.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armada.functions.vectors import as_double_array, context_rows
from armada.operators.ordinal import with_group_ordinal

TILE = 256
FAN_IN = 32  # partials summed together in the first level


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gram(df: DataFrame, vec, d: int, lam: float | Column = 0.0, weight=None, group: Sequence[str] = ()) -> DataFrame:
    """``lam * I + sum w x x^T`` per group as ``(group..., i, j, a)``, j >= i.

    ``lam`` may be a Column over ``group`` (e.g. a discounted ridge term)."""
    return ridge_stats(df, vec, d, (), lam=lam, weight=weight, group=group)


def ridge_stats(df: DataFrame, vec, d: int, reward_cols: Sequence = (), lam: float | Column = 0.0, weight=None,
                group: Sequence[str] = ()) -> DataFrame:
    """Gram matrix and reward sums in one pass over the rows.

    Output ``(group..., i, j, a, b0, ..., b{K-1})`` for j >= i, where
    ``a = lam [i == j] + sum w x_i x_j`` and, on diagonal rows only,
    ``b_k = sum w r_k x_i`` (NULL elsewhere)."""
    group = list(group)
    kk = len(reward_cols)
    rcols = [_col(c).cast("double").alias(f"_r{k}") for k, c in enumerate(reward_cols)]
    w = F.lit(1.0) if weight is None else _col(weight).cast("double")
    base = df.select(*group, as_double_array(vec).alias("_x"), w.alias("_w"), *rcols)
    lam_c = lam if isinstance(lam, Column) else F.lit(float(lam))
    return _tile_sums(base, d, group, kk).select(
        *group, "i", "j", (F.col("_s") + F.when(F.col("i") == F.col("j"), lam_c).otherwise(F.lit(0.0))).alias("a"),
        *[F.when(F.col("i") == F.col("j"), F.col(f"b{k}")).alias(f"b{k}") for k in range(kk)])


def ridge_tiles(df: DataFrame, vec, d: int, reward_cols: Sequence = (), weight=None) -> DataFrame:
    """Gram matrix and reward sums as tiles ``(ti, tj, v, b)``: first row and
    column, the numbers row by row, and on diagonal tiles the sums of all
    rewards for each row. No ridge term; an empty input has no tiles."""
    rcols = [_col(c).cast("double").alias(f"_r{k}") for k, c in enumerate(reward_cols)]
    w = F.lit(1.0) if weight is None else _col(weight).cast("double")
    base = df.select(as_double_array(vec).alias("_x"), w.alias("_w"), *rcols)
    tiles = _tiles(base, d, [], len(reward_cols))
    return tiles.select((F.col("ti") * TILE).alias("ti"), (F.col("tj") * TILE).alias("tj"), "v", F.col("bv").alias("b"))


def _tile_sums(base: DataFrame, d: int, group: list, kk: int) -> DataFrame:
    """``(group..., i, j, _s, b0..)`` cells, j >= i, of ``X^T W X`` and ``X^T W R``."""
    return _tiles(base, d, group, kk, as_cells=True)


def _tiles(base: DataFrame, d: int, group: list, kk: int, as_cells: bool = False) -> DataFrame:
    """``(group..., ti, tj, fan, v, bv)``, one row a tile, or its cells.

    The input is coalesced (no shuffle) to the cluster's parallelism, so the
    partials, d^2 numbers each, stay few whatever the row count."""
    nt = (d + TILE - 1) // TILE
    gfields = [base.schema[g] for g in group]
    tile_schema = T.StructType(gfields + [
        T.StructField("ti", T.IntegerType()), T.StructField("tj", T.IntegerType()), T.StructField("fan", T.IntegerType()),
        T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("bv", T.ArrayType(T.DoubleType()))])
    cell_schema = T.StructType(gfields + [
        T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
        T.StructField("_s", T.DoubleType())] + [T.StructField(f"b{k}", T.DoubleType()) for k in range(kk)])
    rnames = [f"_r{k}" for k in range(kk)]

    def partial(it):
        import pandas as pd
        from pyspark import TaskContext
        fan = TaskContext.get().partitionId() // FAN_IN
        acc = {}
        for pdf in it:
            x, ok = context_rows(pdf["_x"], d)
            weight = pdf["_w"].to_numpy(dtype=np.float64)
            ok &= np.isfinite(weight)
            pdf, x, weight = pdf[ok], x[ok], weight[ok]
            if pdf.empty:
                continue
            keys = list(pdf[group].itertuples(index=False, name=None)) if group else [()] * len(pdf)
            rewards = np.nan_to_num(pdf[rnames].to_numpy(dtype=np.float64), nan=0.0) if kk else None
            for k, at in pd.Series(range(len(pdf))).groupby(pd.Series(keys), sort=False).indices.items():
                wx = x[at] * weight[at][:, None]
                m = wx.T @ x[at]
                bm = wx.T @ rewards[at] if kk else None
                if k in acc:
                    acc[k] = (acc[k][0] + m, None if bm is None else acc[k][1] + bm)
                else:
                    acc[k] = (m, bm)
        for k, (m, bm) in acc.items():
            for ti in range(nt):
                rows = []
                for tj in range(ti, nt):
                    tile = m[ti * TILE:(ti + 1) * TILE, tj * TILE:(tj + 1) * TILE]
                    bv = bm[ti * TILE:(ti + 1) * TILE].ravel() if (bm is not None and ti == tj) else None
                    rows.append((*k, ti, tj, fan, tile.ravel(), bv))
                yield pd.DataFrame(rows, columns=group + ["ti", "tj", "fan", "v", "bv"])

    def summed(it):
        """One accumulator per tile that the task owns, never a tile's partials together."""
        acc = {}
        for pdf in it:
            for *key, _, v, bv in pdf.itertuples(index=False, name=None):
                key = tuple(key)
                v = np.asarray(v, dtype=np.float64)
                bv = None if bv is None else np.asarray(bv, dtype=np.float64)
                if key in acc:
                    acc[key] = (acc[key][0] + v, None if bv is None else acc[key][1] + bv)
                else:
                    acc[key] = (v, bv)
        return acc

    def added(it):
        import pandas as pd
        for key, (v, bv) in summed(it).items():
            yield pd.DataFrame([(*key, 0, v, bv)], columns=group + ["ti", "tj", "fan", "v", "bv"])

    def cells(it):
        import pandas as pd
        for (*g, ti, tj), (v, bv) in summed(it).items():
            h = min(TILE, d - ti * TILE)
            w = min(TILE, d - tj * TILE)
            ii, jj = np.meshgrid(np.arange(h) + ti * TILE, np.arange(w) + tj * TILE, indexing="ij")
            keep = (jj >= ii).ravel()
            out = pd.DataFrame({"i": ii.ravel()[keep].astype("int32"), "j": jj.ravel()[keep].astype("int32"),
                                "_s": v.reshape(h, w).ravel()[keep]})
            if kk:
                diag = (out["i"] == out["j"]).to_numpy()
                for r in range(kk):
                    col = np.zeros(len(out))
                    if bv is not None:
                        col[diag] = bv.reshape(h, kk)[out["i"].to_numpy()[diag] - ti * TILE, r]
                    out[f"b{r}"] = col
            for name, val in zip(group, g):
                out[name] = val
            yield out[group + ["i", "j", "_s"] + [f"b{r}" for r in range(kk)]]

    tiles = base.coalesce(base.sparkSession.sparkContext.defaultParallelism).mapInPandas(partial, tile_schema)
    tiles = tiles.repartition(*group, "ti", "tj", "fan").mapInPandas(added, tile_schema)
    tiles = tiles.repartition(*group, "ti", "tj")
    return tiles.mapInPandas(cells, cell_schema) if as_cells else tiles.mapInPandas(added, tile_schema)


def reward_sums(df: DataFrame, vec, d: int, reward_cols: Sequence[str]) -> DataFrame:
    """``b_k = sum r_k x`` for K reward columns at once, as ``(arm_idx, i, b)``."""
    diag = ridge_stats(df, vec, d, list(reward_cols)).where("i = j")
    stack = ", ".join(f"{k}, b{k}" for k in range(len(reward_cols)))
    return diag.selectExpr("i", f"stack({len(reward_cols)}, {stack}) as (arm_idx, b)").select(
        F.col("arm_idx").cast("int"), "i", "b")


def discounted_table(df: DataFrame, vec, reward, arm: str, order: Sequence[str], d: int, gamma: float,
                     lam: float, num_partitions: int | None = None) -> DataFrame:
    """Statistics after applying, row by row in ``order``, the discounted
    update ``A <- gamma A + x x^T``, ``b <- gamma b + r x`` to each row's arm,
    starting from ``lam * I`` and 0, as ``(arm, n, i, j, a, b0)`` with ``b0``
    on diagonal rows.

    Unrolled: a row followed by m later rows of its arm weighs ``gamma^m``,
    and the ridge term becomes ``lam * gamma^n``. Ordinals come from the
    block ordinal operator, so one arm may hold most rows."""
    ranked = with_group_ordinal(df, [arm], list(order), name="_ord", count_name="n", num_partitions=num_partitions)
    ranked = ranked.withColumn("_w", F.pow(F.lit(float(gamma)), (F.col("n") - F.col("_ord")).cast("double")))
    ridge = F.lit(float(lam)) * F.pow(F.lit(float(gamma)), F.col("n").cast("double"))
    return ridge_stats(ranked, vec, d, [reward], lam=ridge, weight="_w", group=[arm, "n"])

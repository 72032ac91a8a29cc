"""Closed-loop learning: choose an arm, observe only that arm's reward,
update that arm. The recursion is sequential, so two exact forms are offered:

* ``learn_by_key``: one learner per key (user, tenant, ...). Rows are
  hash-partitioned by key and sorted by ``(key, order)``; a ``mapInPandas``
  pass streams each partition once, carrying one key's state at a time.
  Memory is one Arrow batch plus one state; a hot key is streamed, never
  materialised (its updates are inherently one after another).
* ``learn_microbatch``: one global learner updated between batches (e.g.
  days). Inside a batch the state is frozen; the batch's updates are folded
  with the ordered discounted merge
  ``(n,A,b) + (n',A',b') = (n+n', g^n' A + A', g^n' b + b')`` on the
  executors. Many small batches share a job, a large one is scored in
  parallel. With batches of one row it is the row-by-row learner.

One rule for every d: a context that is NULL or holds a NULL, NaN or infinite
element gets no arm (NULL arm, score and reward) and teaches nothing; a NULL
or NaN reward of the chosen arm teaches nothing; a context of another length
fails the job.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armada.config import RouterConfig
from armada.functions.vectors import context_rows
from armada.operators.ordinal import join_keys, with_running_sums
from armada.operators.routing import ArmModel, _scores, choose, cold_start, decide, solve
from armada.operators.stats import FAN_IN, TILE
from armada.session import fresh_dir, materialize, remove_dir


def _pick(scores):
    """Strict arg-max from -inf: the first arm wins ties, NaN never wins."""
    best, arm = -np.inf, -1
    for i, s in enumerate(scores):
        if s > best:
            best, arm = s, i
    return arm, best


class ArmLearner:
    """One learner's state: per arm ``A^-1`` and ``b``. Updates
    ``A <- gamma A + x x^T`` keep the inverse with Sherman-Morrison
    (O(d^2) per step, no inversion per row)."""

    def __init__(self, k: int, d: int, lam: float, gamma: float, alpha: float):
        self.k, self.d, self.gamma, self.alpha = k, d, gamma, alpha
        self.ainv = np.repeat((np.eye(d) / lam)[None], k, axis=0)
        self.b = np.zeros((k, d))

    def scores(self, x: np.ndarray) -> np.ndarray:
        ax = self.ainv @ x
        return (self.b * ax).sum(axis=1) + self.alpha * np.sqrt(np.maximum(ax @ x, 0.0))

    def update(self, arm: int, x: np.ndarray, r: float):
        g = self.gamma
        inv = self.ainv[arm] / g           # (gamma A)^-1
        u = inv @ x
        self.ainv[arm] = inv - np.outer(u, u) / (1.0 + float(x @ u))
        self.b[arm] = g * self.b[arm] + r * x

    def step(self, x: np.ndarray, usable: bool, rewards):
        """Choose, observe, learn: (arm, score, reward), None where there is none."""
        arm, best = _pick(self.scores(x)) if usable else (-1, None)
        if arm < 0:
            return None, None, None
        r = rewards[arm] if rewards is not None else None
        if r is None or r != r:
            return arm, best, None
        self.update(arm, x, float(r))
        return arm, best, float(r)

    def state(self):
        """Dense ``(A, b)`` arrays (K, d, d) and (K, d)."""
        return np.linalg.inv(self.ainv), np.array(self.b)

    @classmethod
    def from_state(cls, a, b, gamma: float, alpha: float):
        k, d = np.asarray(b).shape
        obj = cls(k, d, 1.0, gamma, alpha)
        obj.ainv = np.linalg.inv(np.asarray(a, dtype=np.float64))
        obj.b = np.asarray(b, dtype=np.float64).copy()
        return obj


def outcome_columns(out, steps):
    """``out`` (pandas) with the columns of a list of ``ArmLearner.step`` results."""
    import pandas as pd
    arms, ucbs, rews = zip(*steps) if steps else ((), (), ())
    return out.assign(arm_idx=pd.array(arms, dtype="Int32"), ucb=pd.array(ucbs, dtype="Float64"),
                      reward=pd.array(rews, dtype="Float64"))


def learn_by_key(df: DataFrame, key: str, order: Sequence[str], vec: str, rewards: str, cfg: RouterConfig, d: int,
                 keep: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Exact per-key LinUCB with discounting. ``vec``: array<double> context;
    ``rewards``: array<double> with every arm's reward (only the chosen one
    is used). Output: ``key, *keep, arm_idx, ucb, reward``."""
    order = list(order)
    keep = [c for c in keep if c != key]
    cols = [key, *keep, *[c for c in order if c not in keep and c != key], vec, rewards]
    src = df.select(*cols)
    src = (src.repartition(num_partitions, key) if num_partitions else src.repartition(key))
    src = src.sortWithinPartitions(key, *order)
    schema = T.StructType([df.schema[key], *[df.schema[c] for c in keep],
                           T.StructField("arm_idx", T.IntegerType()), T.StructField("ucb", T.DoubleType()),
                           T.StructField("reward", T.DoubleType())])
    k, lam, gamma, alpha = cfg.k, cfg.lam, cfg.gamma, cfg.alpha

    def run(it):
        import pandas as pd
        cur, learner = object(), None
        for pdf in it:
            if pdf.empty:
                continue
            x, ok = context_rows(pdf[vec], d)
            steps = []
            for t, (kt, rewards_t) in enumerate(zip(pdf[key].to_numpy(), pdf[rewards].to_numpy())):
                same = (kt == cur) or (pd.isna(kt) and learner is not None and pd.isna(cur))
                if not same:
                    cur = kt
                    learner = ArmLearner(k, d, lam, gamma, alpha)
                steps.append(learner.step(x[t], ok[t], rewards_t))
            yield outcome_columns(pdf[[key, *keep]], steps)

    return src.mapInPandas(run, schema)


PIECE = ["_blk", "_file", "_start"]


def _score_and_fold(model: ArmModel, cfg: RouterConfig, keep: list, order: list):
    """One pass over a batch's staged rows ``(keep..., vec, rewards, PIECE)``:
    every row is scored once with the frozen state, and the decisions that
    are written are the ones whose discounted statistics are folded.

    Emits decision rows, and per (piece, arm) the statistics as tiles of the
    upper triangle. Rows of a piece must arrive in ``order``; if not, it fails."""
    theta, linv, alpha, gamma, k, d = model.theta, model.chol_inv, cfg.alpha, cfg.gamma, cfg.k, model.d
    nk = len(keep)

    def run(batches):
        import pandas as pd
        import pyarrow as pa
        frozen = ArmModel(theta=theta, chol_inv=linv, a=None, b=None)
        acc, last = {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            idx, best, _, x, _ = decide(batch.column(nk), frozen, alpha)
            given = batch.column(nk + 1).to_numpy(zero_copy_only=False)
            got = np.array([np.nan if i < 0 or r is None or r[i] is None else r[i] for i, r in zip(idx, given)], np.float64)
            none = idx < 0
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(0, n).cast(pa.int32()), *[batch.column(i) for i in range(nk)],
                 pa.array(idx.astype(np.int32), mask=none), pa.array(best, mask=none), pa.array(got, mask=np.isnan(got)),
                 *[pa.nulls(n, t) for t in STAT_TYPES()]], names)
            teaches = ~none & np.isfinite(got)
            pieces = pd.MultiIndex.from_arrays([batch.column(nk + 2 + i).to_pandas() for i in range(len(PIECE))])
            placed = pd.DataFrame({c: batch.column(keep.index(c)).to_pandas() for c in order})
            for piece, at in pd.Series(range(n)).groupby(pieces.to_flat_index(), sort=False).indices.items():
                places = list(placed.iloc[at].itertuples(index=False, name=None))
                if any(a > b for a, b in zip(places, places[1:])) or (piece in last and places[0] < last[piece]):
                    raise RuntimeError(f"rows of piece {piece} are not in order")
                last[piece] = places[-1]
                for arm in range(k):
                    sel = at[teaches[at] & (idx[at] == arm)]
                    m = len(sel)
                    if not m:
                        continue
                    w = gamma ** np.arange(m - 1, -1, -1, dtype=np.float64)
                    wx = x[sel] * w[:, None]
                    new = (m, wx.T @ x[sel], wx.T @ got[sel])
                    acc[piece, arm] = _merged(acc[piece, arm], new, gamma) if (piece, arm) in acc else new
        for (piece, arm), (n, a, b) in acc.items():
            for ti in range(0, d, TILE):
                for tj in range(ti, d, TILE):
                    row = [*piece, arm, ti, tj, n, a[ti:ti + TILE, tj:tj + TILE].ravel(), b[ti:ti + TILE] if ti == tj else None]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([1], pa.int32()), *[pa.nulls(1, t) for t in kept_types], pa.nulls(1, pa.int32()),
                         pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()),
                         *[pa.array([v], t) for v, t in zip(row, STAT_TYPES())]], names)

    names = ["_kind", *keep, "arm_idx", "ucb", "reward", *PIECE, "_arm", "ti", "tj", "n", "v", "bv"]
    kept_types: list = []

    def with_types(batches):
        for batch in batches:
            kept_types[:] = [batch.schema.field(i).type for i in range(nk)]
            yield batch

    return lambda batches: run(with_types(batches))


def STAT_TYPES():
    import pyarrow as pa
    return [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(),
            pa.list_(pa.float64()), pa.list_(pa.float64())]


STAT_SCHEMA = "_blk int, _file string, _start long, _arm int, ti int, tj int, n long, v array<double>, bv array<double>"


def _merged(old, new, gamma: float):
    """Ordered merge: the older statistics are discounted once per newer row."""
    f = gamma ** new[0]
    return old[0] + new[0], f * old[1] + new[1], None if old[2] is None else f * old[2] + new[2]


def _merge_pieces(stats: DataFrame, gamma: float, by: Column) -> DataFrame:
    """Merge the statistics of all pieces with equal ``by`` in piece order,
    one tile accumulator at a time (sorted and streamed, never collected)."""
    keys = ["_arm", "ti", "tj", "_by"]
    ranked = stats.withColumn("_by", by)
    ranked = ranked.repartition(*keys).sortWithinPartitions(*keys, *PIECE)
    cols = [*PIECE, "_arm", "ti", "tj", "n", "v", "bv"]

    def run(it):
        import pandas as pd
        key, first, now = None, None, None
        for pdf in it:
            for row in pdf.itertuples(index=False, name=None):
                blk, file, start, arm, ti, tj, n, v, bv, b = row
                new = (int(n), np.asarray(v), None if bv is None else np.asarray(bv))
                if key == (arm, ti, tj, b):
                    now = _merged(now, new, gamma)
                    continue
                if key is not None:
                    yield pd.DataFrame([(*first, *key[:3], *now)], columns=cols)
                key, first, now = (arm, ti, tj, b), (blk, file, start), new
        if key is not None:
            yield pd.DataFrame([(*first, *key[:3], *now)], columns=cols)

    return ranked.select(*cols, "_by").mapInPandas(run, STAT_SCHEMA)


def stage(df: DataFrame, path: str, order: list, by: Sequence[str] = ()) -> None:
    """Write rows range-partitioned and sorted by ``(by, order)``, with the
    range block ``_blk`` of every row, one folder per value of ``by``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
            .withColumn("_blk", F.spark_partition_id()))
    (rows.write.mode("overwrite").partitionBy(*by) if by else rows.write.mode("overwrite")).parquet(path)


def score_and_fold(staged: DataFrame, out: str, model: ArmModel, order: list, vec: str, rewards: str, cfg: RouterConfig,
                   keep: list) -> DataFrame:
    """One step on staged rows with a solved state: writes the decisions to
    ``<out>/_kind=0`` and returns the step's discounted statistics as tiles
    ``(_arm, ti, tj, n, v, bv)``, one row a tile.

    Rows are scored once. The statistics of the pieces (a staged file holds
    one block's rows in order; a large file is read as several splits,
    ordered by offset) are merged on the executors in two ordered levels."""
    spark = staged.sparkSession
    fields = [staged.schema[c] for c in keep]
    schema = T.StructType([T.StructField("_kind", T.IntegerType()), *fields, T.StructField("arm_idx", T.IntegerType()),
                           T.StructField("ucb", T.DoubleType()), T.StructField("reward", T.DoubleType())]
                          + T.StructType.fromDDL(STAT_SCHEMA).fields)
    rows = staged.select(*keep, F.col(vec), F.col(rewards), "_blk", F.col("_metadata.file_path").alias("_file"),
                         F.col("_metadata.file_block_start").alias("_start"))
    (rows.mapInArrow(_score_and_fold(model, cfg, keep, order), schema)
     .write.mode("overwrite").partitionBy("_kind").parquet(out))
    written = spark.read.schema(schema).parquet(out)
    stats = written.where("_kind = 1").select(*[f.name for f in T.StructType.fromDDL(STAT_SCHEMA)])
    return _merge_pieces(_merge_pieces(stats, cfg.gamma, F.floor(F.col("_blk") / FAN_IN)), cfg.gamma, F.lit(0).cast("long"))


def learn_step(staged: DataFrame, out: str, a: np.ndarray, b: np.ndarray, order: list, vec: str, rewards: str,
               cfg: RouterConfig, keep: list):
    """``score_and_fold`` with the state ``(a, b)``; returns the next one.
    K·d² numbers reach the driver, whatever the number of files."""
    d = b.shape[1]
    merged = score_and_fold(staged, out, solve(a, b), order, vec, rewards, cfg, keep)
    a, b = a.copy(), b.copy()
    for r in merged.toPandas().itertuples(index=False):
        i, f = r._3, cfg.gamma ** int(r.n)
        h, w = min(TILE, d - r.ti), min(TILE, d - r.tj)
        here, there = slice(r.ti, r.ti + h), slice(r.tj, r.tj + w)
        tile = np.asarray(r.v).reshape(h, w)
        a[i, here, there] = f * a[i, here, there] + tile
        if r.ti == r.tj:
            b[i, here] = f * b[i, here] + np.asarray(r.bv)
        else:
            a[i, there, here] = a[i, here, there].T
    return a, b


#: Rows of consecutive small steps that one task learns in one job; a step of more rows has a job of its own.
BLOCK_ROWS = 100_000


def _learn_block(states: dict, cfg: RouterConfig, d: int, keep: list, has_run: bool, last: bool):
    """One pass over rows ``(keep..., vec, rewards, _step[, run])`` sorted by
    (run, step, order): a step's rows are scored with the state before it and
    folded when the step ends. One Arrow batch and one state are in memory.

    Emits the decisions and, unless ``last``, the tiles of each run's state."""
    gamma, alpha, k, nk = cfg.gamma, cfg.alpha, cfg.k, len(keep)
    names = ["_kind", *keep, "arm_idx", "ucb", "reward", "_run", "_arm", "ti", "tj", "v", "bv"]

    def run(batches):
        import pyarrow as pa
        now, model, acc, a, b = None, None, {}, None, None
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]

        def fold():
            for arm, (n, add, sums) in acc.items():
                a[arm] = gamma ** n * a[arm] + add
                b[arm] = gamma ** n * b[arm] + sums
            acc.clear()

        def state_rows(of, kept):
            for arm in range(k):
                for ti in range(0, d, TILE):
                    for tj in range(ti, d, TILE):
                        row = [of, arm, ti, tj, a[arm, ti:ti + TILE, tj:tj + TILE].ravel(), b[arm, ti:ti + TILE] if ti == tj else None]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([1], pa.int32()), *[pa.nulls(1, t) for t in kept], pa.nulls(1, pa.int32()), pa.nulls(1, pa.float64()),
                             pa.nulls(1, pa.float64()), *[pa.array([v], t) for v, t in zip(row, types)]], names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kept = [batch.column(i).type for i in range(nk)]
            x, ok = context_rows(batch.column(nk), d)
            given = batch.column(nk + 1).to_numpy(zero_copy_only=False)
            step = batch.column(nk + 2).to_numpy()
            of = batch.column(nk + 3).to_numpy() if has_run else np.zeros(n, np.int32)
            cuts = [0, *(np.flatnonzero((np.diff(step) != 0) | (np.diff(of) != 0)) + 1).tolist(), n]
            arms, best, got = np.full(n, -1), np.full(n, np.nan), np.full(n, np.nan)
            for i, j in zip(cuts, cuts[1:]):
                if now != (of[i], step[i]):
                    if now is not None:
                        fold()
                    if now is None or now[0] != of[i]:
                        if now is not None and not last:
                            yield from state_rows(int(now[0]), kept)
                        a, b = (np.array(y) for y in states[int(of[i])])
                    now, model = (of[i], step[i]), solve(a, b)
                s = _scores(x[i:j], model, alpha)
                s[~ok[i:j]] = np.nan
                arms[i:j], best[i:j] = choose(s)
                got[i:j] = [np.nan if m < 0 or r is None or r[m] is None else r[m] for m, r in zip(arms[i:j], given[i:j])]
                for arm in range(k):
                    sel = i + np.flatnonzero((arms[i:j] == arm) & np.isfinite(got[i:j]))
                    if len(sel):
                        w = gamma ** np.arange(len(sel) - 1, -1, -1, dtype=np.float64)
                        wx = x[sel] * w[:, None]
                        new = (len(sel), wx.T @ x[sel], wx.T @ got[sel])
                        acc[arm] = _merged(acc[arm], new, gamma) if arm in acc else new
            none = arms < 0
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(0, n).cast(pa.int32()), *[batch.column(i) for i in range(nk)], pa.array(arms.astype(np.int32), mask=none),
                 pa.array(best, mask=none), pa.array(got, mask=np.isnan(got)), *[pa.nulls(n, t) for t in types]], names)
        if now is not None and not last:
            fold()
            yield from state_rows(int(now[0]), kept)

    return run


def _states_after(written: DataFrame, states: dict, d: int) -> dict:
    """The runs' states from the tiles that a block has written."""
    rows = written.where("_kind = 1").select("_run", "_arm", "ti", "tj", "v", "bv").toArrow()
    states = {r: (np.array(a), np.array(b)) for r, (a, b) in states.items()}
    for r, arm, ti, tj, v, bv in zip(*(rows[c] for c in rows.schema.names)):
        a, b = states[r.as_py()]
        arm, ti, tj = arm.as_py(), ti.as_py(), tj.as_py()
        here, there = slice(ti, min(ti + TILE, d)), slice(tj, min(tj + TILE, d))
        tile = v.values.to_numpy(zero_copy_only=False).reshape(here.stop - ti, there.stop - tj)
        a[arm, here, there] = tile
        a[arm, there, here] = tile.T
        if ti == tj:
            b[arm, here] = bv.values.to_numpy(zero_copy_only=False)
    return states


def learn_microbatch(df: DataFrame, batch: str, order: Sequence[str], vec: str, rewards: str, cfg: RouterConfig,
                     d: int, keep: Sequence[str] = (), state=None, run: str | None = None,
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Global learner updated after every batch. Returns the decisions
    ``([run,] batch, *keep, arm_idx, ucb, reward)``.

    With ``run`` (an int column) every run is a learner of its own that
    starts from ``state``; all runs are learnt in the same jobs.

    Batches are numbered in order (NULL is a batch of its own and comes
    first) and consecutive ones that begin within the same ``block_rows``
    rows make a block; a batch of more rows is a block alone. The input is
    written once under the shared checkpoint folder, range-partitioned by
    (block, batch, order). A block of small batches is one job: a task for
    each run streams its rows and hands the state on from batch to batch. A
    large batch is scored and folded in parallel (``learn_step``). So the
    number of jobs follows the rows, not the batches, and no task streams
    much more than ``block_rows`` rows of a run."""
    spark = df.sparkSession
    base = fresh_dir(spark, "microbatch")
    order, runs = list(order), [run] if run else []
    keep = list(dict.fromkeys([*runs, batch, *keep, *order]))
    rows = df.select(*dict.fromkeys([*keep, vec, rewards]))
    counts = rows.groupBy(*runs, batch).agg(F.count(F.lit(1)).alias("_n"))
    steps = with_running_sums(counts, runs, [batch], {"_upto": F.col("_n")}, ordinal="_step")
    large = F.col("_n") > block_rows
    block = (2 * F.floor((F.col("_upto") - F.col("_n")) / block_rows) + large.cast("int")).cast("long")
    steps = materialize(steps.select(*runs, batch, "_step", block.alias("_block")), "steps")
    # Blocks of a run: about two for each ``block_rows`` of its rows.
    blocks = sorted(tuple(r) for r in steps.select("_block", *(F.col(c) for c in runs)).distinct().collect())
    states = {r[1] if runs else 0: None for r in blocks}
    states = dict.fromkeys(states, state if state is not None else cold_start(cfg, d))
    out = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in keep] + [
        T.StructField("arm_idx", T.IntegerType()), T.StructField("ucb", T.DoubleType()), T.StructField("reward", T.DoubleType())])
    if not blocks:
        return spark.createDataFrame([], out)
    stage(join_keys(rows, steps, [*runs, batch]), f"{base}/input", [*runs, "_step", *order], ["_block"])
    staged_schema = T.StructType([*rows.schema.fields, steps.schema["_step"], T.StructField("_blk", T.IntegerType())])
    written_schema = T.StructType([T.StructField("_kind", T.IntegerType()), *out.fields,
                                   *T.StructType.fromDDL("_run int, _arm int, ti int, tj int, v array<double>, bv array<double>").fields])
    numbers = sorted({r[0] for r in blocks})
    for number in numbers:
        staged = spark.read.schema(staged_schema).parquet(f"{base}/input/_block={number}")
        path = f"{base}/decisions/_block={number}"
        if number % 2:
            for r in blocks:
                if r[0] == number:
                    of = r[1] if runs else 0
                    own = staged.where(F.col(run) == of) if runs else staged
                    states[of] = learn_step(own, f"{path}-{of}", *states[of], order, vec, rewards, cfg, keep)
            continue
        by = [*runs, "_step"]
        alone = (staged.repartition(len(states), *runs) if runs else staged.coalesce(1)).sortWithinPartitions(*by, *order)
        learn = _learn_block(states, cfg, d, keep, bool(runs), number == numbers[-1])
        (alone.select(*keep, vec, rewards, "_step", *(F.col(c).alias("_of") for c in runs)).mapInArrow(learn, written_schema)
         .write.mode("overwrite").partitionBy("_kind").parquet(path))
        if number != numbers[-1]:
            states = _states_after(spark.read.schema(written_schema).parquet(path), states, d)
    remove_dir(spark, f"{base}/input")
    return spark.read.schema(out).parquet(f"{base}/decisions/*/_kind=0")

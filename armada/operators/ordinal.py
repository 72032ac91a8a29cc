"""Positions and running sums inside groups, without putting a group in one task.

``row_number().over(Window.partitionBy(g).orderBy(o))`` sends every row of a
group to one task; a group holding a third of the data would then be sorted
by a single core. The operators here cut the key space ``(group, order)``
into blocks of bounded size instead:

1. A seeded random sample of the keys (key columns only) is collected - its
   size is set by the number of blocks, not by the data - and sorted; its quantiles become
   block boundaries. They are written into the plan as one array literal,
   so ``block`` is a pure function of a row's key (a binary search of depth
   log2(#blocks)). Every consumer and every retried task computes
   the same block, which a range exchange cannot promise (its sample seed
   depends on the RDD id).
2. Rows are ranked (or summed) inside ``(group, block)``: one balanced
   shuffle, since a block holds about N/#blocks rows whatever the groups are.
3. A small table per ``(group, block)`` (at most #groups + #blocks rows)
   gives each block's offset inside its group (a window over that table);
   it is joined back on ``(group, block)``.

The order must be total (end it with a unique key) for positions to be
exact and repeatable.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armada.session import materialize

SAMPLES_PER_BLOCK = 32
SAMPLE_SEED = 7
SMALL = 1 << 20  # rows of a bucket that one task ranks


def _names(cols) -> list:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def join_keys(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (``<=>``), keeping one
    copy of each key column: a NULL group is a group, never dropped."""
    keys = list(keys)
    if not keys:
        raise ValueError("join_keys needs at least one key")
    r = right.select(*[F.col(k).alias(f"_jk_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_jk_{k}"])
        cond = c if cond is None else (cond & c)
    return left.join(r, cond, how).drop(*[f"_jk_{k}" for k in keys])


def _blocks(df: DataFrame, num_blocks: int | None) -> int:
    if num_blocks:
        return int(num_blocks)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _encode(df: DataFrame, c: str) -> str:
    """SQL text of an orderable stand-in for a key column whose values survive
    a trip through the driver unchanged: timestamps without time zone and
    dates as ISO text (text order = time order), zoned timestamps as epoch
    micros, other atomic types as they are."""
    t = df.schema[c].dataType
    q = "`" + c.replace("`", "``") + "`"
    if isinstance(t, (T.TimestampNTZType, T.DateType)):
        return f"CAST({q} AS STRING)"
    if isinstance(t, T.TimestampType):
        return f"unix_micros({q})"
    if isinstance(t, T.DecimalType):
        return f"CAST({q} AS DOUBLE)"
    if isinstance(t, (T.StringType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DoubleType,
                      T.FloatType, T.BooleanType)):
        return q
    raise TypeError(f"cannot order blocks by column {c} of type {t}")


def _sort_key(row):
    out = []
    for v in row:
        if v is None:
            out.append((0, 0))
        elif isinstance(v, float) and math.isnan(v):
            out.append((2, 0))  # Spark orders NaN above every number
        else:
            out.append((1, v))
    return tuple(out)


def _lit(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"{v}L"
    if isinstance(v, float):
        if math.isnan(v):
            return "CAST('NaN' AS DOUBLE)"
        if math.isinf(v):
            return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
        return f"CAST('{v!r}' AS DOUBLE)"
    if isinstance(v, str):
        return f"CAST(X'{v.encode('utf-8').hex()}' AS STRING)"
    raise TypeError(f"unsupported key value {v!r}")


def block_of(df: DataFrame, keys: Sequence[str], num_blocks: int | None = None) -> Column:
    """Deterministic block id in ``[0, #boundaries]`` of each row's key: the
    number of sampled boundaries <= the key.

    The boundaries are one literal ``array<struct>`` (data, not code) and the
    search is a fixed-depth binary search (``aggregate`` over
    ``sequence(1, depth)``), so the expression stays the same size for any
    number of blocks."""
    n = _blocks(df, num_blocks)
    # A decimal's stand-in may be equal for two values: what follows it must not place a row.
    rough = next((i for i, k in enumerate(keys) if isinstance(df.schema[k].dataType, T.DecimalType)), len(keys))
    enc = [_encode(df, k) for k in keys[:rough + 1]]
    if n <= 1:
        return F.lit(0)
    m = SAMPLES_PER_BLOCK * n
    keys_df = df.select(*[F.expr(e).alias(f"_k{i}") for i, e in enumerate(enc)])
    # A Bernoulli sample sized from a count: about m rows reach the driver
    # whatever the rows and partitions.
    sample = keys_df.sample(False, min(1.0, m / max(keys_df.count(), 1)), SAMPLE_SEED)
    types = [f.dataType.simpleString() for f in sample.schema.fields]
    keys_seen = sorted((tuple(r) for r in sample.collect()), key=_sort_key)
    if not keys_seen:
        return F.lit(0)
    bounds = []
    for i in range(1, n):
        b = keys_seen[min(len(keys_seen) - 1, (i * len(keys_seen)) // n)]
        if not bounds or _sort_key(b) > _sort_key(bounds[-1]):
            bounds.append(b)

    def field(i, v):
        val = "NULL" if v is None else _lit(v)
        return f"'k{i}', CAST({val} AS {types[i]})"

    key = "named_struct(" + ", ".join(f"'k{i}', CAST({e} AS {types[i]})" for i, e in enumerate(enc)) + ")"
    arr = "array(" + ", ".join("named_struct(" + ", ".join(field(i, v) for i, v in enumerate(b)) + ")"
                               for b in bounds) + ")"
    depth = max(1, math.ceil(math.log2(len(bounds) + 1)) + 1)
    m_b = len(bounds)
    sql = (
        f"aggregate(sequence(1, {depth}), named_struct('lo', 0, 'hi', {m_b}), (acc, s) -> "
        f"IF(acc.lo < acc.hi, "
        f"IF({key} < element_at({arr}, CAST((acc.lo + acc.hi) div 2 + 1 AS INT)), "
        f"named_struct('lo', acc.lo, 'hi', CAST((acc.lo + acc.hi) div 2 AS INT)), "
        f"named_struct('lo', CAST((acc.lo + acc.hi) div 2 + 1 AS INT), 'hi', acc.hi)), acc)).lo"
    )
    # A single parsed expression (one driver->JVM call, whatever the size).
    return F.expr(f"CAST({sql} AS INT)")


def with_group_ordinal(
    df: DataFrame,
    group,
    order,
    name: str = "ordinal",
    count_name: str | None = None,
    num_blocks: int | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row inside its group under ``order``
    (and, if ``count_name`` is given, the group's size)."""
    return with_running_sums(df, group, order, {}, ordinal=name, count_name=count_name,
                             num_blocks=num_blocks or num_partitions)


def with_running_sums(
    df: DataFrame,
    group,
    order,
    values: dict,
    ordinal: str | None = None,
    count_name: str | None = None,
    num_blocks: int | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add running (cumulative, current row included) sums of the given
    expressions inside each group in ``order``. ``values`` maps output column
    name -> Column. Optionally adds the 1-based position (``ordinal``) and
    the group size (``count_name``)."""
    group, order = _names(group), _names(order)
    num_blocks = num_blocks or num_partitions
    tmp = {f"_og_v{i}": expr for i, expr in enumerate(values.values())}
    base = df
    for k, expr in tmp.items():
        base = base.withColumn(k, expr.cast("double"))
    base = base.withColumn("_og_blk", block_of(df, [*group, *order], num_blocks))

    # Per-block sizes and sums, then each block's offset inside its group.
    stats = base.groupBy(*group, "_og_blk").agg(
        F.count(F.lit(1)).alias("_og_cnt"), *[F.sum(k).alias(f"_og_s{k}") for k in tmp])
    wg = Window.partitionBy(*group) if group else Window.partitionBy()
    before = wg.orderBy("_og_blk").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_og_ocnt", F.coalesce(F.sum("_og_cnt").over(before), F.lit(0)))
    for k in tmp:
        stats = stats.withColumn(f"_og_o{k}", F.coalesce(F.sum(f"_og_s{k}").over(before), F.lit(0.0)))
    if count_name:
        stats = stats.withColumn(count_name, F.sum("_og_cnt").over(wg))
    stats = stats.drop("_og_cnt", *[f"_og_s{k}" for k in tmp])

    # Inside a block: bounded size, so this window is balanced.
    wb = Window.partitionBy(*group, "_og_blk").orderBy(*order)
    inner = base
    if ordinal:
        inner = inner.withColumn("_og_rn", F.row_number().over(wb))
    for k in tmp:
        inner = inner.withColumn(f"_og_r{k}", F.sum(k).over(wb.rowsBetween(Window.unboundedPreceding, 0)))

    out = join_keys(inner, stats, [*group, "_og_blk"], "inner")
    for (outname, _), k in zip(values.items(), tmp):
        out = out.withColumn(outname, F.col(f"_og_r{k}") + F.col(f"_og_o{k}"))
    if ordinal:
        out = out.withColumn(ordinal, F.col("_og_rn") + F.col("_og_ocnt"))
    drop = ["_og_blk", "_og_ocnt", "_og_rn"] + [c for k in tmp for c in (k, f"_og_r{k}", f"_og_o{k}")]
    return out.drop(*[c for c in drop if c in out.columns])


def hash_lead(c: str) -> Column:
    """Bucket of a hexadecimal hash, in its order: the first 16 bits."""
    return F.conv(F.substring(c, 1, 4), 16, 10).cast("long")


def group_cutoffs(keys: DataFrame, group, order, targets: DataFrame, small: int = SMALL) -> DataFrame:
    """Order values of the row at given ranks inside each group.

    ``keys`` holds the group and order columns (nothing of the payload) and,
    if there is one, ``_lead``, an even bucket in their order; ``targets`` is
    ``(group..., cut, rank)`` with 1-based ranks. One partial aggregate
    counts the rows of every bucket, and running sums over the buckets find
    the one that holds a rank. A bucket of more than ``small`` rows is
    counted again in buckets of its own, as often as needed; the rows of what
    is left are ranked. Buckets are blocks between sampled quantiles of
    (group, order), so they are even for every type and distribution. Returns
    ``(group..., cut, <order columns as _c0, _c1...>)`` for targets whose
    rank exists, written once: a few rows per group that the planner
    broadcasts if their size allows it."""
    group, order = _names(group), _names(order)
    by, before = group, None
    if "_lead" not in keys.columns:
        keys = keys.withColumn("_lead", block_of(keys, [*by, *order]))
    while True:
        counts = keys.groupBy(*by, "_lead").agg(F.count(F.lit(1)).alias("_n"))
        upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy("_lead")))
        held = join_keys(upto, targets, by).where((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_n")))
        at = (F.col("rank") - F.col("_upto") + F.col("_n")).alias("rank")
        held = materialize(held.select(*group, "cut", "_lead", at, "_n"), "held")
        near = join_keys(keys, held.drop("_n"), [*by, "_lead"]).drop("_lead")
        largest = held.agg(F.max("_n")).first()[0] or 0
        # A bucket that does not shrink holds rows equal in every order column.
        if largest <= small or largest == before:
            break
        before, by = largest, [*group, "cut"]
        targets, near = held.select(*by, "rank"), materialize(near.drop("rank"), "near")
        keys = near.withColumn("_lead", block_of(near, [*by, *order]))
    near = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*group, "cut").orderBy(*order)))
    hit = near.where(F.col("_rank") == F.col("rank"))
    return materialize(hit.select(*group, "cut", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(order)]), "cutoffs")


def at_or_before(order, cut_prefix: str = "_c") -> Column:
    """Lexicographic ``(order...) <= (cutoff...)`` against columns _c0, _c1..."""
    order = _names(order)
    expr = None
    for i, c in reversed(list(enumerate(order))):
        cc = F.col(f"{cut_prefix}{i}")
        same = F.col(c).eqNullSafe(cc)
        lt = F.coalesce(F.col(c) < cc, F.col(c).isNull() & cc.isNotNull())  # NULLs come first
        expr = (lt | same) if expr is None else (lt | (same & expr))
    return expr

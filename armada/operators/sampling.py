"""Sampling, slicing and splitting with exact sizes and seeded, repeatable order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armada.operators.ordinal import (
    at_or_before, group_cutoffs, hash_lead, join_keys, with_group_ordinal,
)


def seeded_order(key, seed) -> Column:
    """Hash order of a key under a seed: md5 of ``'<seed>:<key>'`` (hex)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def _with_group(df: DataFrame, group):
    """Group columns, or a constant one when there is no grouping."""
    group = [group] if isinstance(group, str) else list(group or [])
    if group:
        return df, group, []
    return df.withColumn("_g", F.lit(0)), ["_g"], ["_g"]


def fraction_sample(df: DataFrame, fraction: float, group, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``round_half_even(fraction * n)`` rows of every group, chosen by
    the seeded hash order (ties broken by ``key``). ``fraction >= 1`` keeps
    all rows.

    Only keys are ranked: the (hash, key) of the last kept row of each group
    is found on ``(group, hash, key)`` alone, and every row is compared with
    its group's cutoff (a per-group table), so payload columns are not
    shuffled while that table is small."""
    if fraction >= 1.0:
        return df
    if fraction < 0.0:
        raise ValueError("fraction must be >= 0")
    base, gk, extra = _with_group(df.withColumn("_h", seeded_order(key, seed)), group)
    keys = base.select(*gk, "_h", key, hash_lead("_h").alias("_lead"))
    sizes = keys.groupBy(*gk).agg(F.count(F.lit(1)).alias("_n"))
    targets = sizes.select(*gk, F.lit(1).alias("cut"),
                           F.bround(F.lit(float(fraction)) * F.col("_n"), 0).cast("long").alias("rank"))
    cuts = group_cutoffs(keys, gk, ["_h", key], targets.where(F.col("rank") > 0))
    out = join_keys(base, cuts, gk).where(at_or_before(["_h", key]))
    return out.drop("_h", "cut", "_c0", "_c1", *extra)


def four_way_cut(df: DataFrame, group, order, part: int | None = None) -> DataFrame:
    """Cut every group, in ``order``, into four parts: parts 1-3 hold
    ``n // 4`` rows each, part 4 the rest (all rows when ``n < 4``).
    Adds ``part``; keeps only that part when ``part`` is given.

    The three cut points of each group are found on the key columns alone;
    every row is then compared with its group's cut points."""
    order = [order] if isinstance(order, str) else list(order)
    base, gk, extra = _with_group(df, group)
    keys = base.select(*gk, *order)
    sizes = keys.groupBy(*gk).agg(F.floor(F.count(F.lit(1)) / 4).cast("long").alias("_size"))
    targets = sizes.where(F.col("_size") > 0).select(
        *gk, F.explode(F.array(*[F.struct(F.lit(k).alias("cut"), (F.col("_size") * k).alias("rank"))
                                 for k in (1, 2, 3)])).alias("_t")).select(*gk, "_t.cut", "_t.rank")
    cuts = group_cutoffs(keys, gk, order, targets)
    names = [f"_c{i}" for i in range(len(order))]
    wide = cuts.groupBy(*gk).agg(*[F.max(F.when(F.col("cut") == k, F.struct(*names))).alias(f"_k{k}")
                                   for k in (1, 2, 3)])
    out = join_keys(base, wide, gk, "left")
    p = F.lit(4)
    for k in (3, 2, 1):
        p = F.when(F.col(f"_k{k}").isNotNull() & at_or_before(order, cut_prefix=f"_k{k}._c"), F.lit(k)).otherwise(p)
    out = out.withColumn("part", p.cast("int")).drop("_k1", "_k2", "_k3", *extra)
    if part is not None:
        if part not in (1, 2, 3, 4):
            raise ValueError("part must be 1..4")
        out = out.where(F.col("part") == part)
    return out


def stratum_quotas(df: DataFrame, strata: str, train_size: float) -> DataFrame:
    """Train rows per stratum: ``floor(train_size * N)`` in total, shared in
    proportion to stratum sizes by largest remainder (ties: stratum name).
    Works on one row per stratum (the windows see #strata rows)."""
    counts = df.groupBy(strata).agg(F.count(F.lit(1)).alias("_ns"))
    tot = Window.partitionBy()
    c = counts.withColumn("_N", F.sum("_ns").over(tot))
    c = c.withColumn("_ntr", F.floor(F.lit(float(train_size)) * F.col("_N")).cast("long"))
    c = c.withColumn("_base", F.expr("(_ntr * _ns) div _N").cast("long"))
    c = c.withColumn("_rem", (F.col("_ntr") * F.col("_ns")) % F.col("_N"))
    c = c.withColumn("_extra", F.col("_ntr") - F.sum("_base").over(tot))
    c = c.withColumn("_rk", F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col(strata))))
    q = F.col("_base") + F.when(F.col("_rk") <= F.col("_extra"), 1).otherwise(0)
    return c.select(strata, q.cast("long").alias("_quota"))


def stratified_split(df: DataFrame, strata: str, key: str, train_size: float = 0.75, seed: int = 1010) -> DataFrame:
    """Stratified train/validation split with exact per-stratum sizes.
    Adds ``split`` = ``train`` | ``validation``.

    Ranks are computed on ``(stratum, hash, key)`` only; each stratum's
    cutoff (the hash and key of its last training row) is compared with
    every row, so the rows themselves (e.g. long vectors) are not shuffled
    while there are few strata."""
    base = df.withColumn("_h", seeded_order(key, seed))
    keys = base.select(strata, "_h", key, hash_lead("_h").alias("_lead"))
    quotas = stratum_quotas(keys, strata, train_size)
    targets = quotas.where(F.col("_quota") > 0).select(strata, F.lit(1).alias("cut"), F.col("_quota").alias("rank"))
    cuts = group_cutoffs(keys, [strata], ["_h", key], targets)
    out = join_keys(base, cuts, [strata], "left")
    train = F.col("_c0").isNotNull() & at_or_before(["_h", key])
    return out.withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("validation"))).drop(
        "_h", "cut", "_c0", "_c1")


def permutation_order(df: DataFrame, key: str, seed, name: str = "seq", group=(),
                      num_partitions: int | None = None) -> DataFrame:
    """A seeded random permutation as a 1-based ``seq`` column (per group)."""
    return with_group_ordinal(
        df.withColumn("_h", seeded_order(key, seed)), list(group), ["_h", key], name=name,
        num_partitions=num_partitions,
    ).drop("_h")

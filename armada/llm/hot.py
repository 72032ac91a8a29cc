"""Joins of rows with one row per key, when a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.llm import storage

#: Keys that hold at least one row in so many; there are no more of them than this.
HEAVY = 100


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, count_col: str, heavy: int = HEAVY) -> DataFrame:
    """``rows`` with the columns of ``per_key`` (a row for each value of
    ``key``, NULL included; ``count_col``: rows of that key). Keys that hold
    1/``heavy`` of all rows, ``heavy`` of them at most, are broadcast and
    their rows stay where they lie; the others meet by shuffle. Rows whose
    key is not in ``per_key`` are left out. Both should be written tables:
    they are read twice."""
    k = storage.free_name(rows, "_key")
    total = per_key.agg(F.sum(count_col)).first()[0] or 0
    right = per_key.withColumnRenamed(key, k)
    often = F.col(count_col) * heavy >= F.lit(total)
    few, many = F.broadcast(right.where(often)), right.where(~often)
    same = F.col(key).eqNullSafe(F.col(k))
    lying = rows.join(few, same)
    dealt = rows.join(few, same, "left_anti").join(many, same)
    return lying.unionByName(dealt).drop(k)

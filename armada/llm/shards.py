"""Contiguous shards of equal bytes (operator 5), DataFrame functions only.

The keys (id, size, checksum; never the text) are range-partitioned by id
and written once to the shared folder, so that every later pass and every
retry sees the same partitions. Per-partition totals and their prefix sums
give each partition's global base; inside a partition a window adds the
sizes before a document. The total is cut at equal targets: a document goes
to the shard that holds its middle byte, so shards are contiguous in id
order and differ from the target by at most one document.

Defined results: a NULL text has no bytes (and size 1); NULL ids come
first; rows that share an id are kept and ordered by text and position; a text
longer than a shard's target lies in the shard of its middle byte, and shards that
it covers whole stay empty; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armada.llm import storage


def positions(sizes: DataFrame, order: list[str], size_col: str, partitions: int | None = None) -> DataFrame:
    """``sizes`` with ``start`` (sum of ``size_col`` of all rows before),
    ``row`` (number of rows before) and ``total``. ``order`` needs no unique
    end: equal rows are told apart by their place in the input."""
    spark = sizes.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = sizes.withColumn("_at", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(n, *order, "_at").withColumn("_part", F.spark_partition_id())
    fixed = storage.write_shared(ranged, "positions")
    totals = fixed.groupBy("_part").agg(F.sum(size_col).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    # One row per partition from here on: as many as the setting, whatever the data.
    over = Window.orderBy("_part")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte_base"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_base"),
        F.sum("_bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("_part").orderBy(*order, "_at")
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (fixed.withColumn("_sum", F.sum(size_col).over(run)).withColumn("_rank", F.row_number().over(inside))
            .join(F.broadcast(bases), "_part")
            .withColumn("start", F.col("_byte_base") + F.col("_sum") - F.col(size_col))
            .withColumn("row", F.col("_row_base") + F.col("_rank") - 1)
            .drop("_at", "_part", "_byte_base", "_row_base", "_sum", "_rank"))


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = positions(sizes, ["doc_id", "text_crc32", "size"], "size")
    shard = F.expr(f"least({shards - 1}, ((2 * start + size) * {shards}) div (2 * total))").cast("int")
    placed = placed.select("doc_id", "size", "text_crc32", "row", shard.alias("shard"))
    first = placed.groupBy("shard").agg(F.min("row").alias("_first"))  # at most ``shards`` rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("_first")).alias("slot"))

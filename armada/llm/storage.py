"""Files in the folder that driver and executors share.

Python tasks write plain binary files through ``pyarrow.fs`` (local and
mounted folders, HDFS, object stores); on a file system with paths the
readers map the file into memory instead of copying it.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.session import work_dir


def shared_uri(spark: SparkSession, name: str) -> str:
    """A folder of its own for this call under the shared folder, as a URI."""
    path = f"{work_dir(spark, 'llm')}/{name}-{uuid.uuid4().hex[:12]}"
    if "://" in path or path.startswith("file:"):
        return path
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return f"file://{path}" if default.startswith("file:") else default.rstrip("/") + path


def local_path(uri: str) -> str | None:
    """The path behind a ``file:`` URI, else None."""
    if uri.startswith("file://"):
        return uri[len("file://"):]
    return uri[len("file:"):] if uri.startswith("file:") else None


def open_output(uri: str):
    """A writable binary stream; parent folders are made."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs
    store, p = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(p), recursive=True)
    return store.open_output_stream(p)


def map_array(uri: str, dtype) -> np.ndarray:
    """The whole file as a read-only array: memory-mapped where it has a path."""
    path = local_path(uri)
    if path is not None:
        if os.path.getsize(path) == 0:
            return np.empty(0, dtype)
        return np.memmap(path, dtype, mode="r")
    from pyarrow import fs
    store, p = fs.FileSystem.from_uri(uri)
    with store.open_input_file(p) as f:
        return np.frombuffer(f.read(), dtype)


def write_shared(df, name: str):
    """Write ``df`` once as Parquet in a fresh shared folder and read it back,
    so that every consumer and every retry sees the same rows."""
    return write_to(df, shared_uri(df.sparkSession, name))


def write_to(df, uri: str):
    """Write ``df`` as Parquet into a fresh folder and read it back."""
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


BROADCAST_ROWS = 500_000  # (id, hash) rows of 16 bytes that may be broadcast; more are joined by shuffle


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front, so that ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _meeting(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    i, h = free_name(docs, "_id"), free_name(docs, "_h")
    right = rows.select(F.col("id").alias(i), F.col("h").alias(h))
    if rows.count() <= BROADCAST_ROWS:
        right = F.broadcast(right)
    return docs.join(right, F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(h)), how)


def without_rows(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those whose id and ``xxhash64(text)`` are in ``rows``
    (id, h; a written table). No text is shuffled while ``rows`` is small."""
    return _meeting(docs, rows, id_col, text_col, "left_anti")


def only_rows(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` whose id and ``xxhash64(text)`` are in ``rows``."""
    return _meeting(docs, rows, id_col, text_col, "left_semi")

"""Vector codes by product quantisation with active-entry Lloyd (operator 13).

Components become integers, vectors are cut into equal parts, and every part
position has a codebook that starts as that part of the smallest ids. The
state of a part, its entry and the exact squared distance to it, lies beside
the vector in a written table. An assignment compares a part whose entry did
not move with the entries that moved, against the stored distance; a part
whose entry moved rescans all of them. Entries that stayed where they were
cannot have come nearer, so this is the full scan's answer, ties included
(the lower index wins). Sums per entry are added up inside each task, then
across tasks; only codebooks (entries x dimensions numbers) reach the driver.

Arithmetic is exact: integers in doubles while every sum stays below 2**53,
Python integers beyond.

Defined results: a vector that is NULL, holds a NULL or non-finite component
or one of 2**62 / 1024 or more in size (it has no integer form) is left out,
as is one of another length than the vector that comes first by id. Ids come
in order, NULL last, equal ids by vector; repeated rows count each. A length
that the number of parts does not divide gives the first parts one component
more. An error above the largest long is that long. An empty table gives no
rows. Columns other than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.llm import hot, storage
from armada.session import remove_dir

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LARGEST = 2**63 - 1
#: Scaled components below this have an integer form.
LIMIT = float(2**62)
EXACT = 2**53


def _largest(*arrays: np.ndarray) -> int:
    return max(int(np.abs(a).max(initial=0)) for a in arrays)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(n, k) exact squared distances of integer rows; int64, or Python
    integers where these could exceed 2**53."""
    if 4 * x.shape[1] * _largest(x, entries) ** 2 < EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
        return d.astype(np.int64)
    a, b = x.astype(object), entries.astype(object)
    return np.stack([((a - e) ** 2).sum(1) for e in b], axis=1).reshape(len(x), len(b))


def assign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray | None = None, code: np.ndarray | None = None,
           dist: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every row and its squared distance. With ``moved``
    (a mask of entries), ``code`` and ``dist`` of the assignment before, rows
    whose entry stayed are compared with moved entries only. A distance that
    no long holds is -1 and always rescanned."""
    n = len(x)
    if code is None:
        code, dist, stay = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
    else:
        code, dist, stay = code.copy(), dist.copy(), ~moved[code] & (dist >= 0)
        active, rows = np.flatnonzero(moved), np.flatnonzero(stay)
        if len(active) and len(rows):
            d = distances(x[rows], entries[active])
            best = d.argmin(1)
            low, at = d[np.arange(len(rows)), best], active[best]
            nearer = (low < dist[rows]) | ((low == dist[rows]) & (at < code[rows]))
            code[rows[nearer]], dist[rows[nearer]] = at[nearer], low[nearer].astype(np.int64)
    rows = np.flatnonzero(~stay)
    if len(rows):
        d = distances(x[rows], entries)
        best = d.argmin(1)
        low = d[np.arange(len(rows)), best]
        code[rows], dist[rows] = best, np.where(low > LARGEST, -1, low).astype(np.int64)
    return code, dist


def sums(x: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """(entries, width) exact sums of the rows of every entry, as Python integers."""
    if len(x) * max(1, _largest(x)) < EXACT:
        cols = [np.bincount(code, x[:, j], entries) for j in range(x.shape[1])]
        return np.array(cols, np.float64).reshape(-1, entries).T.astype(np.int64).astype(object)
    out = np.zeros((entries, x.shape[1]), object)
    np.add.at(out, code, x.astype(object))
    return out


def _cuts(dims: int, parts: int) -> list[slice]:
    sizes = [dims // parts + (p < dims % parts) for p in range(parts)]
    ends = np.cumsum([0, *sizes]).tolist()
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x) of the vectors that take part, whatever their length."""
    usable = F.forall(vector_col, lambda v: v.isNotNull() & (F.abs(v.cast("double") * scale) < LIMIT))
    return vectors.where(F.col(vector_col).isNotNull() & usable).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
        F.transform(vector_col, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"))


def _assigned(state: DataFrame, books: list[np.ndarray], moved: list[np.ndarray] | None, cuts: list[slice]) -> DataFrame:
    """(vec_id, label, x, code, dist) under ``books``; ``moved`` is None for the first assignment."""
    dims, parts = cuts[-1].stop, len(cuts)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2), dims)
            before = (None, None) if moved is None else (_matrix(batch.column(3), parts), _matrix(batch.column(4), parts))
            found = [assign(x[:, cut], books[p], *(() if moved is None else (moved[p], before[0][:, p], before[1][:, p])))
                     for p, cut in enumerate(cuts)]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.stack(y, 1).ravel()), parts) for y in zip(*found)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], lists[0].cast(pa.list_(pa.int32())), lists[1].cast(pa.list_(pa.int64()))],
                ["vec_id", "label", "x", "code", "dist"])

    label = state.schema["label"].dataType.simpleString()
    return state.mapInArrow(run, f"vec_id long, label {label}, x array<bigint>, code array<int>, dist array<bigint>")


def _moved_entries(state: DataFrame, books: list[np.ndarray], cuts: list[slice]) -> list[np.ndarray]:
    """The entries after an update; those that no part uses stay."""
    dims, parts, sizes = cuts[-1].stop, len(cuts), [len(b) for b in books]

    def run(batches):
        total = [np.zeros((k, cut.stop - cut.start), object) for k, cut in zip(sizes, cuts)]
        count = [np.zeros(k, np.int64) for k in sizes]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, code = _matrix(batch.column(0), dims), _matrix(batch.column(1), parts)
            for p, cut in enumerate(cuts):
                total[p] += sums(x[:, cut], code[:, p], sizes[p])
                count[p] += np.bincount(code[:, p], minlength=sizes[p])
        for p in range(parts):
            used = np.flatnonzero(count[p])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[p][used]),
                 pa.array([[Decimal(int(v)) for v in total[p][e]] for e in used], pa.list_(pa.decimal128(38, 0)))],
                ["part", "entry", "n", "total"])

    pieces = state.select("x", "code").mapInArrow(run, "part int, entry int, n bigint, total array<decimal(38,0)>")
    # Position 0 is the count, so that one pass gives both.
    cells = pieces.select("part", "entry", F.posexplode(F.concat(F.array(F.col("n").cast("decimal(38,0)")), "total")).alias("at", "v"))
    out, found = [b.copy() for b in books], {}
    for r in cells.groupBy("part", "entry", "at").agg(F.sum("v").alias("v")).collect():  # entries x (dimensions + parts) rows
        found.setdefault((r.part, r.entry), {})[r["at"]] = int(r.v)
    for (p, e), cell in found.items():
        out[p][e] = [cell[j + 1] // cell[0] for j in range(out[p].shape[1])]
    return out


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
           scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code array<int>, dist array<long>, error long) of every
    vector that takes part, and the codebooks, one (entries, width) array a part."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col, label_col, scale)
    order = [F.col("vec_id").asc_nulls_last(), "x"]
    first = rows.orderBy(*order).limit(1).collect()
    cuts = _cuts(len(first[0].x) if first else 0, parts)
    rows = rows.where(F.size("x") == cuts[-1].stop)
    start = [r.x for r in rows.orderBy(*order).limit(entries).select("x").collect()]
    start = np.array(start, np.int64).reshape(len(start), cuts[-1].stop)
    books, moved, state, path = [start[:, c] for c in cuts], None, rows, None
    for k in range(rounds + 1):
        before, path = path, storage.shared_uri(spark, f"vector-codes-{k}")
        now = _assigned(state, books, moved, cuts)
        now.write.parquet(path)
        state = spark.read.schema(now.schema).parquet(path)
        if before:
            remove_dir(spark, before)
        if k < rounds:
            after = _moved_entries(state, books, cuts)
            moved = [(a != b).any(1) for a, b in zip(books, after)]
            books = after
    error = F.when(F.exists("dist", lambda d: d < 0), F.lit(LARGEST)).otherwise(
        F.least(F.lit(LARGEST), F.aggregate("dist", F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d).cast("decimal(38,0)"))).cast("long"))
    return state.select("vec_id", "label", "code", "dist", error.alias("error")), books


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in order, comma-joined."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (over equal
    labels, NULL ones together) and codebooks_sha256."""
    codes, books = encode(vectors, id_col, vector_col, label_col)
    sent = F.least(F.lit(LARGEST), F.sum(F.col("error").cast("decimal(38,0)"))).cast("long")
    by_label = storage.write_shared(codes.groupBy("label").agg(sent.alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    digits = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return hot.join_per_key(codes, by_label, "label", "n").select(
        "vec_id", digits.alias("code"), "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))

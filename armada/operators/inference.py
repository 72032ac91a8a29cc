"""Batch inference slots and vector preparation.

Model inference stays with the caller: ``score_prompts`` and ``embed_text``
run a caller-supplied batch function over batches (``mapInPandas``, ``mapInArrow``),
keep the row key next to every output and time each batch. The function is
built once per Python worker (pass a factory). The vector operators below
(``hash_embedding``, ``last_token_pool``) are plain JVM aggregates.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rebatched(batches, rows: int | None):
    """Pandas batches of exactly ``rows`` rows (the last may be shorter), cut
    and joined inside the task; as they come when ``rows`` is None."""
    import pandas as pd
    if not rows:
        yield from (b for b in batches if len(b))
        return
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            whole = pd.concat(held, ignore_index=True)
            for at in range(0, n - n % rows, rows):
                yield whole.iloc[at:at + rows].reset_index(drop=True)
            held, n = [whole.iloc[n - n % rows:].reset_index(drop=True)], n % rows
    if n:
        yield pd.concat(held, ignore_index=True)


#: Bytes of text that an embedder gets at a time where the caller sets no number of rows.
BATCH_BYTES = 4 << 20


def text_batches(batches, text: str, rows: int | None):
    """Arrow batches of exactly ``rows`` rows (the last may be shorter), or of
    about ``BATCH_BYTES`` of text (a longer text alone) when ``rows`` is None."""
    import pyarrow as pa
    import pyarrow.compute as pc
    held, n = [], 0
    for batch in batches:
        if rows:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                whole = pa.Table.from_batches(held)
                for at in range(0, n - n % rows, rows):
                    yield whole.slice(at, rows).combine_chunks().to_batches()[0]
                rest = whole.slice(n - n % rows).combine_chunks()
                held, n = rest.to_batches(), n % rows
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + BATCH_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def score_prompts(df: DataFrame, scorer_factory: Callable[[], Callable], prompt: str = "prompt",
                  keep: Sequence[str] = ("row_id",), batch_rows: int | None = None) -> DataFrame:
    """Generated text for every prompt.

    ``scorer_factory()`` is called once per Python worker and returns
    ``fn(batch) -> sequence of str | None``, where ``batch`` is a pandas
    DataFrame (``keep`` columns + ``prompt``) of ``batch_rows`` rows; a batch
    may hold several models when ``keep`` has a model column. Each text is the
    echoed prompt plus the continuation; None marks a failed row
    (-> ``ERROR``). An exception is the failure of the whole batch: its rows
    have no text and its message in ``scorer_error``, and ``run_report``
    reports their model and task as failed, without an accuracy.
    Adds ``generated_text``, ``scorer_error`` and ``latency_sec`` (the batch's
    wall time shared equally by its rows)."""
    keep = [c for c in keep if c != prompt]
    schema = T.StructType([df.schema[c] for c in keep] + [
        df.schema[prompt], T.StructField("generated_text", T.StringType()),
        T.StructField("scorer_error", T.StringType()), T.StructField("latency_sec", T.DoubleType())])

    def run(it):
        fn = scorer_factory()
        for pdf in rebatched(it, batch_rows):
            t0 = time.perf_counter()
            error = None
            try:
                texts = list(fn(pdf))
                if len(texts) != len(pdf):
                    raise ValueError(f"{len(texts)} texts for {len(pdf)} prompts")
            except Exception as e:
                texts, error = [None] * len(pdf), f"{type(e).__name__}: {e}"
            dt = (time.perf_counter() - t0) / len(pdf)
            yield pdf[keep + [prompt]].assign(generated_text=texts, scorer_error=error, latency_sec=dt)

    return df.select(*dict.fromkeys([*keep, prompt])).mapInPandas(run, schema)


def offline_scorer_factory(model_col: str = "model", key_col: str = "row_id", prompt: str = "prompt"):
    """A deterministic stand-in for a text generator (no model libraries are
    needed): for ``k`` = first md5 byte of ``'<model>:<key>'``, k%16 = 0 fails
    (None), k%16 = 1 answers without a letter, else it answers
    ``chr(65 + k%4)``. The same rule as ``armada.sources.tables.responses``."""
    def factory():
        import hashlib

        def fn(batch):
            out = []
            for m, key, p in zip(batch[model_col], batch[key_col], batch[prompt]):
                k = int(hashlib.md5(f"{m}:{key}".encode()).hexdigest()[:2], 16)
                if k % 16 == 0:
                    out.append(None)
                elif k % 16 == 1:
                    out.append(p + " I cannot tell.")
                else:
                    out.append(f"{p} The answer is {chr(65 + k % 4)}.")
            return out
        return fn
    return factory


def embed_text(df: DataFrame, embedder_factory: Callable[[], Callable[[list], np.ndarray]], text: str = "prompt",
               keep: Sequence[str] = ("row_id",), out: str = "embedding", dtype: str = "float",
               batch_rows: int | None = None) -> DataFrame:
    """Dense vector per text from a caller-supplied batch embedder
    (``list[str] -> ndarray (n, d)``), built once per Python worker. Row
    keys replace positions. Whole texts are passed; any length limit is the
    embedder's own. Without ``batch_rows`` a batch holds about ``BATCH_BYTES``
    of text; kept columns stay in Arrow. A NaN in a vector is a NULL."""
    keep = list(keep)
    elem = T.FloatType() if dtype == "float" else T.DoubleType()
    np_type = np.float32 if dtype == "float" else np.float64
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(elem))])

    def run(it):
        import pyarrow as pa
        fn = embedder_factory()
        for batch in text_batches(it, text, batch_rows):
            vecs = np.asarray(fn(batch.column(text).to_pylist()), dtype=np_type)
            if vecs.shape != (batch.num_rows, vecs.shape[-1]):
                raise ValueError(f"vectors {vecs.shape} for {batch.num_rows} texts")
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * vecs.shape[1]
            packed = pa.ListArray.from_arrays(pa.array(ends), pa.array(vecs.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), packed], [*keep, out])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def last_real(mask: np.ndarray) -> np.ndarray:
    """Position of the last real token of every row of a 0/1 mask with
    contiguous padding on one side: the last position if it is real, else the
    number of real tokens less one; -1 for a row without any."""
    n = mask.sum(axis=1)
    at = np.where(n == 0, -1, np.where(mask[:, -1] == 1, mask.shape[1] - 1, n - 1)) if mask.shape[1] else n - 1
    first = np.where(n == 0, 0, at - n + 1)
    whole = [bool(mask[i, f:f + k].all()) for i, (f, k) in enumerate(zip(first, n))]
    if not all(whole):
        raise ValueError("padding must be contiguous")
    return at


def embed_last_token(df: DataFrame, embedder_factory: Callable[[], Callable[[list], tuple]], text: str = "prompt",
                     keep: Sequence[str] = ("row_id",), out: str = "embedding", dtype: str = "float",
                     batch_rows: int | None = None) -> DataFrame:
    """Dense vector per text: the vector of its last real token.

    ``embedder_factory()`` is called once per Python worker and returns
    ``fn(list[str]) -> (hidden (n, length, d), mask (n, length))`` for a batch
    padded to one length on either side. A batch is pooled where it was
    embedded, so no token leaves its task; the rule is that of
    ``last_token_pool``. A text without a real token has a NULL vector."""
    keep = list(keep)
    np_type = np.float32 if dtype == "float" else np.float64
    elem = T.FloatType() if dtype == "float" else T.DoubleType()
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(elem))])

    def run(it):
        fn = embedder_factory()
        for pdf in rebatched(it, batch_rows):
            hidden, mask = (np.asarray(y) for y in fn(pdf[text].tolist()))
            if len(hidden) != len(pdf) or mask.shape != hidden.shape[:2]:
                raise ValueError(f"hidden states {hidden.shape} and mask {mask.shape} for {len(pdf)} texts")
            res = pdf[keep].copy()
            res[out] = [None if at < 0 else row[at].astype(np_type) for at, row in zip(last_real(mask), hidden)]
            yield res

    return df.select(*dict.fromkeys([*keep, text])).mapInPandas(run, schema)


def offline_token_embedder_factory(left: bool, max_tokens: int | None = None):
    """A deterministic stand-in for a token model: tokens are split on ASCII
    whitespace; a token's vector is (first 16 bits of its md5 / 65536, its
    number from 1); batches are padded on the ``left`` or right. Tokens beyond
    ``max_tokens`` are the model's own limit."""
    def factory():
        import hashlib
        import re
        split = re.compile(r"[ \t\n\r\x0b\x0c]+")

        def fn(texts):
            tokens = [[w for w in split.split(t or "") if w][:max_tokens] for t in texts]
            length = max(map(len, tokens), default=0)
            hidden, mask = np.zeros((len(texts), length, 2)), np.zeros((len(texts), length), np.int64)
            for row, words in enumerate(tokens):
                at = slice(length - len(words), length) if left else slice(0, len(words))
                mask[row, at] = 1
                hidden[row, at, 0] = [int(hashlib.md5(w.encode()).hexdigest()[:4], 16) / 65536 for w in words]
                hidden[row, at, 1] = np.arange(1, len(words) + 1)
            return hidden, mask
        return fn
    return factory


def hashing_embedder_factory(d: int, cache_size: int = 1 << 18):
    """Offline embedder: L2-normalised hashed bag of words (tokens split on
    ASCII whitespace, bucket = first 16 bits of md5 mod d), vectorised per
    batch with numpy; each distinct token is hashed once per worker (bounded
    cache). Same vectors as ``hash_embedding``."""
    def factory():
        import hashlib
        import re
        split = re.compile(r"[ \t\n\r\x0b\x0c]+")
        cache = {}

        def bucket(w):
            b = cache.get(w)
            if b is None:
                if len(cache) >= cache_size:
                    cache.clear()
                b = cache[w] = int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % d
            return b

        def fn(texts):
            m = np.zeros((len(texts), d))
            for row, t in enumerate(texts):
                idx = [bucket(w) for w in split.split(t or "") if w]
                if idx:
                    m[row] = np.bincount(idx, minlength=d)
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        return fn
    return factory


# Token separator for the hashed bag-of-words: ASCII whitespace runs.
TOKEN_SPLIT = r"[ \t\n\r\x{0B}\x{0C}]+"


def hash_bucket(token, d: int):
    """Bucket of a token: first 16 bits of its md5, modulo d."""
    return (F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("int") % F.lit(d)).cast("int")


def hash_embedding(df: DataFrame, key: str, text: str, d: int) -> DataFrame:
    """Hashed bag-of-words of whole texts, long form ``(key, bucket, cnt,
    weight)`` with ``weight = cnt / ||cnt||``. A text is one row, so its
    tokens are split, hashed and counted inside the row: no shuffle."""
    split = F.explode(F.array(F.split(F.coalesce(F.col(text), F.lit("")), TOKEN_SPLIT)))
    words = df.select(key, split.alias("_w"))
    buckets = F.transform(F.filter("_w", lambda t: F.length(t) > 0), lambda t: hash_bucket(t, d))
    rows = words.select(key, F.explode(F.array(F.sort_array(buckets))).alias("_b"))
    # Runs of the sorted buckets: a run ends where the next bucket differs.
    size = F.size("_b")
    ends = F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | (F.get("_b", i) != F.get("_b", i - 1)))
    rows = rows.where(size > 0).select(key, "_b", F.explode(F.array(ends)).alias("_e"))
    counted = F.transform("_e", lambda e, i: F.struct(
        F.get("_b", e - 1).alias("bucket"), (e - F.when(i == 0, 0).otherwise(F.get("_e", i - 1))).cast("long").alias("cnt")))
    rows = rows.select(key, F.explode(F.array(counted)).alias("_c"))
    norm = F.sqrt(F.aggregate("_c", F.lit(0).cast("long"), lambda s, c: s + c["cnt"] * c["cnt"]))
    return rows.select(key, norm.alias("_norm"), F.inline("_c")).select(
        key, "bucket", "cnt", (F.col("cnt") / F.col("_norm")).alias("weight"))


def last_token_pool(tokens: DataFrame, key: str, pos: str, mask: str, hidden: str) -> DataFrame:
    """Vector of the last real token per sequence, from rows ``(key, pos from
    0, mask, hidden)`` with contiguous padding on one side.

    If the last position is real the sequence is padded on the left (or not
    at all) and the last position is taken, else position ``sum(mask) - 1``.
    One partial aggregate, so a very long sequence is combined map-side. A
    sequence without a real token has a row with NULLs."""
    n = F.sum(mask)
    real = F.col(mask) == 1
    picked = tokens.groupBy(key).agg(
        n.alias("_n"), F.max(pos).alias("_last"), F.max_by(mask, pos).alias("_end"),
        F.max(F.when(real, F.col(pos))).alias("_last_real"),
        F.max_by(hidden, F.when(real, F.col(pos))).alias("pooled"), F.min(F.when(real, F.col(pos))).alias("_first_real"))
    at = F.when(F.col("_n") == 0, None).when(F.col("_end") == 1, F.col("_last")).otherwise(F.col("_n") - 1)
    # With contiguous padding that position is the last real one; otherwise the mask is malformed.
    whole = (F.col("_n") == 0) | (F.col("_last_real") - F.col("_first_real") + 1 == F.col("_n"))
    return picked.select(key, F.when(whole, at).otherwise(F.raise_error(F.lit("padding must be contiguous")).cast("long"))
                         .cast("long").alias("pooled_pos"), "pooled")

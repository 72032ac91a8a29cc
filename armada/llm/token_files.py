"""Token ids in flat binary files (operator 3).

Documents are range-partitioned by id; each task encodes its documents in
order and streams three files: ``.ids`` (flat little-endian unsigned
integers), ``.off`` (unsigned 64-bit offsets, one more than documents) and
``.doc`` (64-bit document ids). A task reports its totals; the base of every
partition is the prefix sum of the totals before it, so a document's global
position is base + offset and no task waits for another.

Encoding cuts a text at ASCII white space. The tokenizer's normaliser and
pre-tokeniser never join anything across white space and its special
strings hold none, so the ids of a text are those of its chunks one after
another; every distinct chunk goes to the library once per bounded cache.
Where the tokenizer's words are known (``by_word``), a new chunk of letters and
marks is made of the ids of its words, and new words go to the library many at
a time. A tokenizer without that property is fed whole texts (``by_chunk=False``).

Defined results: a NULL or empty text has only the end id; a NULL document
id sorts first and comes back as NULL; rows that share a document id are
kept, ordered by the text's hash; very long texts are encoded chunk by chunk and
stay one document; an empty table gives no rows; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import itertools
import json
import os
import sys
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.llm import storage

CACHE_CHUNKS = 250_000        # distinct chunks held in each of two generations
BATCH_BYTES = 4 << 20         # text encoded at a time
GROUP_WORDS = 100             # new words that go to the library as one text
NULL_ID = -(1 << 63)
#: ASCII marks that neither begin a contraction nor belong to a letter or a number.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The pre-tokeniser whose words can be told apart here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_TOKENIZERS: dict = {}
_CACHES: dict = {}


class ChunkCache:
    """Bounded map of chunk -> value in two generations: when the young one
    is full it becomes the old one; what is used again moves back."""

    def __init__(self, limit: int = CACHE_CHUNKS):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, chunks: set) -> list:
        young, old = self.young, self.old
        out = []
        for c in chunks.difference(young):
            v = old.get(c)
            if v is None:
                out.append(c)
            else:
                young[c] = v
        return out

    def turn(self) -> None:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}


def tokenizer_of(tokenizer_json: str):
    """The library's tokenizer, built once per worker. A task has one core, so the library's own
    threads stay off unless the worker's environment says otherwise."""
    key = hash(tokenizer_json)
    if key not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        tok = Tokenizer.from_str(tokenizer_json)
        tok.no_truncation()
        tok.no_padding()
        _TOKENIZERS[key] = tok
    return _TOKENIZERS[key]


def slices(column: pa.Array, limit: int = BATCH_BYTES):
    """(start, stop) row ranges of a string column of about ``limit`` bytes."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def by_word(tokenizer_json: str) -> np.ndarray | None:
    """For a tokenizer whose words are runs of letters, runs of marks and single digits, and end in
    a token of their own kind: which ids end a word. None for any other tokenizer."""
    spec = json.loads(tokenizer_json)
    model, norm, pre = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    end, vocab = model.get("end_of_word_suffix"), model.get("vocab")
    known = (model.get("type") == "BPE" and end and not model.get("dropout") and not model.get("ignore_merges")
             and not model.get("continuing_subword_prefix")
             and [n["type"] for n in norm.get("normalizers") or []] == ["NFC", "Replace", "Lowercase"]
             and norm["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and norm["normalizers"][1]["content"] == " "
             and [p["type"] for p in pre.get("pretokenizers") or []] == ["Split", "ByteLevel"]
             and pre["pretokenizers"][0]["pattern"] == {"Regex": PATTERN} and pre["pretokenizers"][0]["invert"]
             and pre["pretokenizers"][0]["behavior"] == "Removed" and not pre["pretokenizers"][1]["add_prefix_space"]
             and not pre["pretokenizers"][1]["use_regex"])
    added = spec.get("added_tokens") or []
    # No special string is letters with marks behind, so none is inside a word or its marks.
    if not known or any(word_and_marks(t["content"].encode()) or not t["content"].isascii() for t in added):
        return None
    ends = np.zeros(max([*vocab.values(), *(t["id"] for t in added)]) + 1, bool)
    ends[[i for t, i in vocab.items() if t.endswith(end)]] = True
    return ends


def word_and_marks(chunk: bytes) -> tuple[bytes, bytes] | None:
    """A chunk as its letters and the marks behind them (either may be empty), if it is no more than that."""
    word = chunk.rstrip(MARKS)
    if word.isalpha():       # of bytes: ASCII letters only
        return word.lower(), chunk[len(word):]
    if word:
        text = "" if word.isascii() else word.decode()
        if not (text.isalpha() and unicodedata.is_normalized("NFC", text) and text.lower().isalpha()):
            return None
    return word, chunk[len(word):]


def encode_column(texts: pa.Array, tokenizer_json: str, dtype: str, end_id: int, by_chunk: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a string column, texts one after another with ``end_id`` behind each, and
    the number of ids of every text. Chunks go to the library, not texts."""
    tok = tokenizer_of(tokenizer_json)
    code = {"<u2": "H", "<u4": "I"}[dtype]

    def ids(parts):
        found = (array(code, e.ids) for e in tok.encode_batch_fast(parts, add_special_tokens=False))
        if sys.byteorder == "big":
            return [np.asarray(x).astype(dtype).tobytes() for x in found]
        return [x.tobytes() for x in found]

    end = np.asarray([end_id], dtype).tobytes()
    if not by_chunk:
        enc = ids([t or "" for t in texts.to_pylist()])
        lengths = np.fromiter((len(e) for e in enc), np.int64, len(enc)) // np.dtype(dtype).itemsize + 1
        return np.frombuffer(b"".join(e + end for e in enc), dtype), lengths
    key = hash(tokenizer_json), dtype
    if key not in _CACHES:
        _CACHES[key] = ChunkCache(), by_word(tokenizer_json)
    cache, ends = _CACHES[key]

    def fill(chunks: list) -> None:
        if ends is None:
            cache.young.update(zip(chunks, ids([c.decode() for c in chunks])))
            return
        # A chunk of letters and marks is two words of the tokenizer's at most; other texts have them, too.
        cut = {c: word_and_marks(c) for c in chunks}
        words = cache.missing({w for parts in cut.values() if parts for w in parts if w})
        whole = [c for c, parts in cut.items() if not parts]
        # Words go together, spaces between: each ends with the one of its ids that ends a word.
        groups = [words[i:i + GROUP_WORDS] for i in range(0, len(words), GROUP_WORDS)]
        for group, enc in zip(groups, tok.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            found = np.asarray(enc.ids, dtype)
            stops = np.flatnonzero(ends[found]) + 1
            if len(stops) != len(group) or len(found) != stops[-1]:
                whole += group
                continue
            raw, at = found.tobytes(), (stops * found.itemsize).tolist()
            cache.young.update(zip(group, [raw[i:j] for i, j in zip([0, *at], at)]))
        cache.young.update(zip(whole, ids([c.decode() for c in whole])))
        get = cache.young.__getitem__
        cache.young.update((c, get(p[0]) + get(p[1]) if p[0] and p[1] else get(p[0] or p[1])) for c, p in cut.items() if p)

    split = pc.ascii_split_whitespace(texts)
    chunks = split.flatten().dictionary_encode()
    known = chunks.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    cache.young[b""] = b""   # beside white space at either end of a text
    found = list(map(cache.young.get, known))
    absent = [i for i, v in enumerate(found) if v is None]
    new = cache.missing({known[i] for i in absent})
    if new:
        fill(new)
    for i in absent:
        found[i] = cache.young[known[i]]
    # Every text's chunks, then the end id, as places in ``flat``.
    found.append(end)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(dtype).itemsize
    flat, starts = np.frombuffer(b"".join(found), dtype), np.cumsum(sizes) - sizes
    stops = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(split), 0)), dtype=np.int64)
    order = np.insert(chunks.indices.to_numpy(zero_copy_only=False), stops, len(found) - 1)
    n = sizes[order]
    upto = np.cumsum(n)
    out = flat[np.repeat(starts[order] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
    cache.turn()
    return out, np.diff(upto[stops + np.arange(len(stops))], prepend=0)


def id_type(tokenizer_json: str, end_id: int) -> str:
    """The narrowest unsigned type that holds every id."""
    top = max([end_id, *json.loads(tokenizer_json)["model"]["vocab"].values(),
               *(t["id"] for t in json.loads(tokenizer_json).get("added_tokens") or [])])
    return "<u2" if top < 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, tokenizer_json: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text", by_chunk: bool = True, partitions: int | None = None) -> dict:
    """Write the corpus; returns the manifest: folder, id type, and one entry
    per partition file with its document and token base."""
    spark = docs.sparkSession
    folder = storage.shared_uri(spark, "tokens")
    dtype = id_type(tokenizer_json, end_id)
    vocab = spark.sparkContext.broadcast(tokenizer_json)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    # The hash keeps rows that share one id from meeting in a single task.
    ordered = (narrow.withColumn("h", F.xxhash64("t")).repartitionByRange(n, "id", "h")
               .sortWithinPartitions("id", "h").select("id", "t"))

    def write(batches):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        stem = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        files, total, n_docs = None, 0, 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                if files is None:
                    files = [storage.open_output(f"{folder}/{stem}.{k}") for k in ("ids", "off", "doc")]
                    files[1].write(np.zeros(1, "<u8").tobytes())
                enc, lengths = encode_column(texts.slice(a, b - a), vocab.value, dtype, end_id, by_chunk)
                files[0].write(enc.astype(dtype, copy=False).tobytes())
                files[1].write((np.cumsum(lengths) + total).astype("<u8").tobytes())
                files[2].write(np.asarray(pc.fill_null(ids.slice(a, b - a), NULL_ID)).astype("<i8").tobytes())
                total += int(lengths.sum())
                n_docs += b - a
        if files is not None:
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pydict({"part": [ctx.partitionId()], "stem": [stem], "docs": [n_docs], "tokens": [total]})

    # One small row per partition reaches the driver; files of failed attempts are in no row.
    rows = sorted(ordered.mapInArrow(write, "part long, stem string, docs long, tokens long").collect())
    doc_base = [0, *itertools.accumulate(r["docs"] for r in rows)]
    token_base = [0, *itertools.accumulate(r["tokens"] for r in rows)]
    return {"folder": folder, "dtype": dtype, "parts": [
        {"stem": r["stem"], "doc_base": d, "token_base": t} for r, d, t in zip(rows, doc_base, token_base)]}


def read_token_files(spark: SparkSession, manifest: dict) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32
    (over the ids as little-endian unsigned 32-bit integers)."""
    folder, dtype, parts = manifest["folder"], manifest["dtype"], manifest["parts"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not parts:
        return spark.createDataFrame([], schema)
    todo = spark.createDataFrame([(p["stem"], p["token_base"]) for p in parts], "stem string, base long")

    def read(batches):
        for batch in batches:
            for stem, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = storage.map_array(f"{folder}/{stem}.ids", dtype)
                off = storage.map_array(f"{folder}/{stem}.off", "<u8")
                doc = storage.map_array(f"{folder}/{stem}.doc", "<i8")
                for a in range(0, len(doc), 4096):
                    cut = np.asarray(off[a:a + 4097], dtype=np.int64)
                    d = np.asarray(doc[a:a + 4096])
                    crc = [zlib.crc32(np.asarray(ids[i:j], "<u4").tobytes()) for i, j in zip(cut[:-1], cut[1:])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(d, mask=d == NULL_ID), pa.array(cut[:-1] + base),
                        pa.array(np.diff(cut)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.repartition(len(parts), "stem").mapInArrow(read, schema)


def decode_ids(manifest: dict, part: int, index: int) -> np.ndarray:
    """Random access: the ids of document ``index`` of partition file ``part``."""
    p = manifest["parts"][part]
    off = storage.map_array(f"{manifest['folder']}/{p['stem']}.off", "<u8")
    ids = storage.map_array(f"{manifest['folder']}/{p['stem']}.ids", manifest["dtype"])
    return np.asarray(ids[int(off[index]):int(off[index + 1])])

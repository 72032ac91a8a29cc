"""Removal of repeated byte strings by sorted suffixes (operator 4).

Every byte that lies in a ``LENGTH``-byte string which also starts earlier
(smaller id, or same document and smaller start) is removed; strings are
judged on the input and never cross documents.

Sorting every suffix would move each byte of the corpus a hundred times, so
only the suffixes at anchors are sorted: a string's anchor is the leftmost
of its ``GRAM``-byte grams with the smallest hash, hence equal strings have
their anchors at the same offset, and a run of neighbouring starts shares
one anchor (about one in 34 bytes is one).

1. A record per anchor holds the suffix's leading tokens (two bytes, then
   the fingerprint of its gram), the fingerprint of the window of text that
   all strings of this anchor cover, and the place. Splitters from a bounded
   sample cut the order of records into buckets; a hot suffix is cut by its
   later tokens and its place, so no bucket holds a whole hot group.
2. A bucket sorts its records locally by multikey quicksort. In a run of
   equal windows all but the first are repeats as a whole. Where one gram
   has different windows, and at the bucket's ends, the first record of
   every window goes on.
3. The windows of those records are fetched and sorted again by gram; in a
   bucket the 100-byte strings at every start are compared. Grams at a
   bucket's ends, which may go on in the neighbour, are compared across
   boundaries: their strings meet in the task that owns the fingerprint.
4. The spans found are joined with the texts and cut out.

Strings are compared by fingerprints of 112 to 128 bits.

Defined results: a NULL text is empty; a NULL id comes before all others;
rows that share an id are ordered by text hash, and rows with equal id and
text are one document and get the same result; very long texts are read whole,
as one row; an empty table gives no rows; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.llm import storage
from armada.llm.token_files import slices

LENGTH = 100
GRAM = 32
BLOCK = 1 << 17                 # bytes hashed at a time
BATCH_BYTES = 8 << 20
BUCKET_RECORDS = 1_000_000      # records that a bucket should hold at most
SAMPLE_DOCS = 4000              # documents (expected) from which splitters are drawn
SAMPLE_PER_BUCKET = 100         # records (expected) that reach the driver for every bucket
SMALL_SEGMENT = 2048            # segments that the quicksort hands to a plain sort
INDEX = (1 << 20) - 1
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
NO_ID = -(1 << 63)
FULL = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _rolled(data: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial fingerprints of all strings of ``length`` bytes, by doubling."""
    n, power, part = 1, base, data.astype(np.uint64) + np.uint64(1)
    done, size = None, 0
    while True:
        if length & n:  # lay this power of two behind what is done
            if done is None:
                done, size = part, n
            else:
                keep = len(data) - size - n + 1
                done, size = done[:keep] * np.uint64(pow(base, n, 1 << 64)) + part[size:size + keep], size + n
        if 2 * n > length:
            return done
        part = part[:-n] * np.uint64(power) + part[n:]
        power = power * power & FULL
        n *= 2


def _lowest(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values."""
    n = 1
    while 2 * n <= width:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    rest = width - n
    return np.minimum(v[:-rest], v[rest:]) if rest else v


class Ranges:
    """Fingerprints of strings of any length inside a block, from prefix sums."""

    def __init__(self, size: int, base: int):
        inverse = pow(base, -1, 1 << 64)
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:], down[1:] = np.uint64(base), np.uint64(inverse)
        self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def of(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[:len(data)], out=sums[1:])
        return (sums[stop] - sums[start]) * self.up[start]


_RANGES: list = []
FIELDS = (("key", "<u8"), ("window", "<u8"), ("doc", "<i8"), ("v", "<i8"), ("start", "<u4"), ("n", "u1"), ("at", "u1"))


def anchors(texts: list[bytes], doc: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Anchor records of the texts, one array per field of ``FIELDS``: the
    suffix's leading tokens, the window's fingerprint, the place (document,
    first start), the number of starts and the anchor's distance from the
    first start."""
    if not _RANGES:
        _RANGES.append(Ranges(BLOCK + LENGTH, BASE_B))
    found, pieces, size = [], [], 0

    def flush():
        nonlocal pieces, size
        if pieces:
            found.append(_block_anchors(pieces, doc, v))
        pieces, size = [], 0

    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - LENGTH + 1), BLOCK):  # starts at .. at + BLOCK - 1
            piece = text[at:at + BLOCK + LENGTH - 1]
            if size + len(piece) > BLOCK + LENGTH - 1:
                flush()
            pieces.append((i, at, piece))
            size += len(piece)
    flush()
    if not found:
        return [np.empty(0, t) for _, t in FIELDS]
    return [np.concatenate(x) for x in zip(*found)]


def _block_anchors(pieces: list, doc: np.ndarray, v: np.ndarray) -> tuple:
    data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    stops = np.cumsum([len(p) for _, _, p in pieces])
    gram = _mix(_rolled(data, GRAM, BASE_A))
    ranked = (gram & np.uint64(FULL ^ INDEX)) | np.arange(len(gram), dtype=np.uint64)
    anchor = (_lowest(ranked, LENGTH - GRAM + 1) & np.uint64(INDEX)).astype(np.int64)
    piece = np.searchsorted(stops, np.arange(len(anchor)), side="right")
    inside = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= stops[piece])
    anchor, piece = anchor[inside], piece[inside]
    first = np.ones(len(anchor), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    heads = np.flatnonzero(first)
    count = np.diff(np.append(heads, len(anchor)))
    start, a, piece = inside[heads], anchor[heads], piece[heads]
    window = _RANGES[0].of(data, start, start + count + (LENGTH - 1))
    n, at = count.astype(np.uint64), (a - start).astype(np.uint64)
    window = _mix(window ^ _mix(n << np.uint64(8) | at))
    lead = data[a].astype(np.uint64) << np.uint64(56) | data[a + 1].astype(np.uint64) << np.uint64(48)
    begins = np.concatenate([[0], stops[:-1]])
    rows = np.array([i for i, _, _ in pieces])[piece]
    base = np.array([x for _, x, _ in pieces])[piece]
    return (lead | gram[a] >> np.uint64(16), window, doc[rows], v[rows],
            (start - begins[piece] + base).astype("<u4"), n.astype("u1"), at.astype("u1"))


def multikey_quicksort(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of the rows whose token sequences are the columns of ``tokens``:
    split in three by a pivot of the current token, the middle part goes on
    with the next token; small segments are sorted directly."""
    order = np.arange(len(tokens[0]))
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == len(tokens):
            continue
        rows = order[low:high]
        if high - low <= SMALL_SEGMENT:
            order[low:high] = rows[np.lexsort([t[rows] for t in tokens[depth:][::-1]])]
            continue
        values = tokens[depth][rows]
        some = np.sort(values[::-(-len(values) // 1024)])
        pivot = some[len(some) // 2]
        less, same = values < pivot, values == pivot
        more = ~(less | same)
        order[low:high] = np.concatenate([rows[less], rows[same], rows[more]])
        a, b = low + int(less.sum()), high - int(more.sum())
        todo += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def _pack(fields: list[np.ndarray]) -> bytes:
    """Columns as byte planes, compressed."""
    planes = [np.ascontiguousarray(f.view(np.uint8).reshape(len(f), f.dtype.itemsize).T).tobytes() for f in fields]
    return len(fields[0]).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, fields=FIELDS) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), np.uint8), 0, []
    for _, kind in fields:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at:at + n * size].reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    return out


def _bucket(fields: list[np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """Number of splitters (rows of key, window, doc, v, start) that are not
    after the record."""
    keys = splitters["key"]
    low, high = np.searchsorted(keys, fields[0], "left"), np.searchsorted(keys, fields[0], "right")
    out = low.copy()
    for r in np.flatnonzero(high > low):  # the record's leading tokens are a splitter's
        place = tuple(f[r] for f in fields[:5])
        while out[r] < high[r] and tuple(splitters[out[r]]) <= place:
            out[r] += 1
    return out


def _with_v(docs: DataFrame, id_col: str, text_col: str):
    """(doc, v, t): v tells rows that share an id apart and is zero if none do."""
    narrow = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    shared = not narrow.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return narrow.select("doc", (F.xxhash64("t") if shared else F.lit(0).cast("long")).alias("v"), "t")


def _splitters(spark, rows: DataFrame, buckets: int, n_docs: int, total: int) -> np.ndarray:
    """Splitters from a bounded sample of anchor records."""
    share = min(1.0, SAMPLE_DOCS / max(1, n_docs))
    thin = min(1.0, SAMPLE_PER_BUCKET * buckets / max(1.0, share * total))

    def draw(batches):
        rng = np.random.default_rng(7)
        for batch in batches:
            f = anchors(batch.column(2).cast(pa.binary()).to_pylist(), np.asarray(batch.column(0)), np.asarray(batch.column(1)))
            keep = rng.random(len(f[0])) < thin
            yield pa.RecordBatch.from_arrays([pa.array(x[keep].astype(np.int64) if x.dtype != np.uint64 else
                                                       x[keep].view(np.int64)) for x in f[:5]],
                                             ["key", "window", "doc", "v", "start"])

    got = rows.sample(False, share, 7).mapInArrow(draw, "key long, window long, doc long, v long, start long").toArrow()
    kinds = [k for _, k in FIELDS[:5]]
    cols = [got.column(i).to_numpy().view(np.uint64) if k == "<u8" else got.column(i).to_numpy() for i, k in enumerate(kinds)]
    table = np.empty(got.num_rows, dtype=[(n, "<u8" if k == "<u8" else "<i8") for n, k in FIELDS[:5]])
    for (name, _), c in zip(FIELDS[:5], cols):
        table[name] = c
    table = table[np.lexsort([table[n] for n, _ in FIELDS[4::-1]])]
    return table[[len(table) * i // buckets for i in range(1, buckets)]] if len(table) else table


def _first_pass(rows: DataFrame, buckets: int, splitters: np.ndarray) -> DataFrame:
    """(doc, v, start, n, at, key): repeated windows (key NULL) and windows to compare."""
    split = rows.sparkSession.sparkContext.broadcast(splitters)  # one row per bucket

    def scatter(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for a, b in slices(texts, BATCH_BYTES):
                f = anchors(texts.slice(a, b - a).to_pylist(), np.asarray(batch.column(0))[a:b], np.asarray(batch.column(1))[a:b])
                order = np.argsort(f[0], kind="stable")
                f = [x[order] for x in f]
                to = _bucket(f, split.value)
                order = np.argsort(to, kind="stable")
                f, to = [x[order] for x in f], to[order]
                cuts = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
                blobs = [_pack([x[i:j] for x in f]) for i, j in zip(cuts[:-1], cuts[1:])]
                if blobs:
                    yield pa.RecordBatch.from_arrays([pa.array(to[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())],
                                                     ["bucket", "blob"])

    def gather(batches):
        blobs = [_unpack(x) for batch in batches for x in batch.column(1).to_pylist()]
        if not blobs:
            return
        f = [np.concatenate(x) for x in zip(*blobs)]
        del blobs
        order = multikey_quicksort(f[:5])
        key, window, doc, v, start, n, at = (x[order] for x in f)
        new_key = np.diff(key, prepend=~key[:1]) != 0
        new = new_key | (np.diff(window, prepend=~window[:1]) != 0)
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))  # first record of the run
        repeat = ~new & ((doc != doc[head]) | (v != v[head]) | (start != start[head]))
        group = np.cumsum(new_key) - 1
        classes = np.bincount(group, weights=new)
        go_on = new & ((classes[group] > 1) | (group == 0) | (group == group[-1]))
        for mask, with_key in ((repeat, False), (go_on, True)):
            for i in range(0, int(mask.sum()), 1 << 18):
                r = np.flatnonzero(mask)[i:i + (1 << 18)]
                keys = pa.array(key[r].view(np.int64)) if with_key else pa.nulls(len(r), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[r]), pa.array(v[r]), pa.array(start[r].astype(np.int64)), pa.array(n[r].astype(np.int32)),
                     pa.array(at[r].astype(np.int32)), keys], ["doc", "v", "start", "n", "at", "key"])

    sent = rows.mapInArrow(scatter, "bucket int, blob binary").repartitionById(buckets, "bucket")
    return storage.write_shared(sent.mapInArrow(gather, "doc long, v long, start long, n int, at int, key long"), "suffix-runs")


def _squeezed(rows: DataFrame) -> DataFrame:
    """(doc, v, z): texts compressed for the exchange."""
    def run(batches):
        c = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = [c.compress(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], ["doc", "v", "z"])
    return rows.mapInArrow(run, "doc long, v long, z binary")


def _windows(rows: DataFrame, open_ones: DataFrame) -> DataFrame:
    """(key, doc, v, start, text): the text that all strings of an anchor cover."""
    wanted = open_ones.groupBy("doc", "v").agg(F.collect_list(F.struct("key", "start", "n")).alias("w"))

    def cut(batches):
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, v, z, w in zip(*(batch.column(i) for i in range(4))):
                text, w = d.decompress(z.as_py()), w.values
                key, start, n = (w.field(i) for i in range(3))
                parts = [text[s:s + m + LENGTH - 1] for s, m in zip(start.to_pylist(), n.to_pylist())]
                yield pa.RecordBatch.from_arrays([key, pa.repeat(doc, len(w)), pa.repeat(v, len(w)), start,
                                                  pa.array(parts, pa.binary())], ["key", "doc", "v", "start", "text"])

    # Rows with equal id and text are one document here.
    joined = _squeezed(rows).join(wanted, ["doc", "v"]).select("doc", "v", "z", "w")
    return joined.mapInArrow(cut, "key long, doc long, v long, start long, text binary")


def _neighbours(doc: np.ndarray, v: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last rows of the runs of neighbouring starts (rows in order)."""
    cut = np.ones(len(p), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (v[1:] != v[:-1]) | (p[1:] > p[:-1] + 1)
    first = np.flatnonzero(cut)
    return first, np.append(first[1:], len(p)) - 1


PLACES = (("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("v", "<i8"), ("start", "<i8"))


def _across(edges: DataFrame, buckets: int) -> DataFrame:
    """(doc, v, start, stop): strings that another bucket holds earlier."""
    def compare(batches):
        blobs = [_unpack(x, PLACES) for batch in batches for x in batch.column(1).to_pylist()]
        if not blobs:
            return
        a, b, doc, v, p = (np.concatenate(x) for x in zip(*blobs))
        order = multikey_quicksort([a, b, doc, v, p])
        a, b, doc, v, p = (x[order] for x in (a, b, doc, v, p))
        again = np.zeros(len(a), bool)
        again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(a))))
        again &= (doc != doc[head]) | (v != v[head]) | (p != p[head])
        doc, v, p = doc[again], v[again], p[again]
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(v), pa.array(p), pa.array(p + LENGTH)],
                                         ["doc", "v", "start", "stop"])

    sent = edges.where("blob is not null").select("bucket", "blob").repartitionById(buckets, "bucket")
    return sent.mapInArrow(compare, "doc long, v long, start long, stop long")


def _second_pass(windows: DataFrame, buckets: int) -> DataFrame:
    """(doc, v, start, stop, bucket, blob): spans of strings that the bucket
    holds earlier (blob NULL); and packed, for the task that owns their
    fingerprints, the first places of the strings that other buckets may
    hold as well."""
    schema = "doc long, v long, start long, stop long, bucket int, blob binary"

    def compare(batches):
        got = [batch for batch in batches if batch.num_rows]
        if not got:
            return
        got = pa.Table.from_batches(got)
        key, doc, v, start = (got.column(i).to_numpy() for i in range(4))
        text = pc.binary_length(got.column(4)).to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(got.column(4).to_pylist()), np.uint8)
        del got
        begin = np.cumsum(text) - text
        count = text - (LENGTH - 1)
        row = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        spot = begin[row] + step
        a, b = (_mix(_rolled(data, LENGTH, base))[spot] for base in (BASE_A, BASE_B))
        p, doc, v, key = start[row] + step, doc[row], v[row], key[row]
        ends = (key == key.min()) | (key == key.max())  # the order of the exchange: signed
        order = multikey_quicksort([a, b, doc, v, p])
        a, b, doc, v, p, ends = (x[order] for x in (a, b, doc, v, p, ends))
        new = (np.diff(a, prepend=~a[:1]) != 0) | (np.diff(b, prepend=~b[:1]) != 0)
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        # The bucket's first place of a string that others may hold: to the task that owns its fingerprint.
        r = np.flatnonzero(new & ends)
        to = (a[r] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        r, to = r[order], to[order]
        cuts = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
        blobs = [_pack([x[r[i:j]] for x in (a, b, doc, v, p)]) for i, j in zip(cuts[:-1], cuts[1:])]
        if blobs:
            none = pa.nulls(len(blobs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(to[cuts[:-1]]), pa.array(blobs, pa.binary())],
                                             ["doc", "v", "start", "stop", "bucket", "blob"])
        again = ~new & ((doc != doc[head]) | (v != v[head]) | (p != p[head]))
        doc, v, p = doc[again], v[again], p[again]
        order = np.lexsort([p, v, doc])
        doc, v, p = doc[order], v[order], p[order]
        if not len(p):
            return
        first, last = _neighbours(doc, v, p)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[first]), pa.array(v[first]), pa.array(p[first]), pa.array(p[last] + LENGTH),
             pa.nulls(len(first), pa.int32()), pa.nulls(len(first), pa.binary())], ["doc", "v", "start", "stop", "bucket", "blob"])

    ranged = windows.repartitionByRange(buckets, "key", "doc", "v", "start")
    return storage.write_shared(ranged.mapInArrow(compare, schema), "suffix-edges")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(doc, v, start, stop): spans whose bytes are to go; they may overlap.
    ``rows``: doc, v, t."""
    spark = rows.sparkSession
    n_docs, n_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    total = 2 * n_bytes // (LENGTH - GRAM + 2)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_RECORDS))
    runs = _first_pass(rows, buckets, _splitters(spark, rows, buckets, n_docs, total))
    whole = runs.where("key is null").select("doc", "v", "start", (F.col("start") + F.col("n") + (LENGTH - 1)).alias("stop"))
    edges = _second_pass(_windows(rows, runs.where("key is not null")), buckets)
    inner = edges.where("blob is null").select("doc", "v", "start", "stop")
    return whole.unionByName(inner).unionByName(_across(edges, buckets))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans
    array<struct<start, stop>> (maximal removed runs) and kept (the remaining
    bytes)."""
    rows = _with_v(docs, id_col, text_col)
    spans = repeated_spans(rows).groupBy("doc", "v").agg(F.collect_list(F.struct("start", "stop")).alias("s"))
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches):
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            for z, s in zip(batch.column(1).to_pylist(), batch.column(2)):
                text, out, left, end = d.decompress(z), [], [], 0
                if s.is_valid:
                    start, stop = (s.values.field(i).to_numpy() for i in range(2))
                    order = np.argsort(start, kind="stable")
                    start, stop = start[order], np.maximum.accumulate(stop[order])
                    gap = np.flatnonzero(np.append(True, start[1:] > stop[:-1]))
                    for x, y in zip(start[gap].tolist(), stop[np.append(gap[1:], len(stop)) - 1].tolist()):
                        left.append(text[end:x])
                        out.append((x, y))
                        end = y
                left.append(text[end:])
                runs.append([{"start": x, "stop": y} for x, y in out])
                kept.append(b"".join(left))
                sizes.append(len(text))
                removed.append(len(text) - len(kept[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(runs, kinds), pa.array(kept, pa.binary())],
                                             ["doc", "n_bytes", "n_removed", "spans", "kept"])

    joined = _squeezed(rows).join(spans, ["doc", "v"], "left").select("doc", "z", "s")
    done = joined.mapInArrow(cut, "doc long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")
    return done.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")

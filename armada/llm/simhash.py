"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 2).

A fingerprint's 64 bits are cut into three segments. At most two differing
bits leave one segment without an error and, among the other two, none with
more than one error unless another one has none; so for one of the three
cyclic pairs (exact segment, fuzzy segment) the first is equal and the
second differs in at most one bit. The fuzzy segment is decoded with the
perfect binary Golay code: its keys are the indices of all codewords within
distance 4, one or six of them, and two words that differ in at most one
bit always share one (the codeword within 3 of either is within 4 of the
other). Keys are joined and the Hamming distance is verified.

Equal fingerprints are one vertex, so copies never meet in a join. Buckets
of more than ``SMALL_BUCKET`` vertices are not expanded into pairs: two
fingerprints differ in at most two bits if and only if some word is within
one bit of both, so their vertices are grouped by the words within one bit
(at most 65 vertices a word), which is exact and linear. Components come
from rounds of minimum labels over written tables.

Defined results: a text without words (NULL, empty) has fingerprint zero
and is linked like any other; NULL ids are skipped when the smallest id of
a component is sought and keep their rows; repeated rows share a fingerprint
and keep a row each; very long texts are hashed whole, with counts of bounded
memory; an empty table gives no rows; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armada.llm import hot, storage, workers
from armada.llm.token_files import slices
from armada.session import remove_dir

SHINGLE = 3
MAX_BITS = 2
SMALL_BUCKET = 64
#: Segment widths, generator polynomial of the binary Golay code, hash seed.
WIDTHS = (22, 21, 21)
GENERATOR = 0xC75
SEED = 42


class Golay:
    """Nearby codewords of 23-bit words, from tables built by rule."""

    def __init__(self):
        remainder = np.zeros(4096, np.int64)
        for m in range(4096):
            r = m << 11
            for bit in range(22, 10, -1):
                if r >> bit & 1:
                    r ^= GENERATOR << (bit - 11)
            remainder[m] = r
        self.check = remainder
        words = (np.arange(4096) << 11) | remainder
        weight = np.array([bin(w).count("1") for w in words.tolist()])
        heavy = words[weight == 7]
        self.error = np.zeros(2048, np.int64)       # syndrome -> error of up to 3 bits
        self.offsets = np.full((2048, 6), -1, np.int64)
        for n in range(4):
            for bits in itertools.combinations(range(23), n):
                e = sum(1 << b for b in bits)
                s = int(remainder[e >> 11]) ^ (e & 2047)
                self.error[s] = e
                self.offsets[s, 0] = 0
                if n == 3:  # the five codewords at distance 4
                    self.offsets[s, 1:] = heavy[(heavy & e) == e] >> 11

    def keys(self, words: np.ndarray) -> np.ndarray:
        """(n, 6) indices of the codewords within distance 4; -1 where there is none."""
        syndrome = self.check[words >> 11] ^ (words & 2047)
        near = (words ^ self.error[syndrome]) >> 11
        off = self.offsets[syndrome]
        return np.where(off < 0, -1, near[:, None] ^ off)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text."""
    import xxhash
    words = (text or b"").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - shingle + 1
    if n < 1:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:n - 1]]).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory on very long texts
        ones += np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h, fp): h tells the texts of rows that share an id apart."""
    def run(batches):
        workers.release()
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for a, b in slices(texts):
                fp = np.array([fingerprint(t, shingle) for t in texts.slice(a, b - a).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                                                  pa.array(fp.view(np.int64))], ["doc_id", "h", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"),
                         F.col(text_col).cast("string").alias("t"))
    return narrow.mapInArrow(run, "doc_id long, h long, fp long")


def fuzzy_keys(distinct: DataFrame) -> DataFrame:
    """(key, fp): the keys of every distinct fingerprint."""
    def run(batches):
        code = Golay()
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            segments, shift = [], 0
            for width in WIDTHS:
                segments.append(((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64))
                shift += width
            for pair in range(3):
                near = code.keys(segments[(pair + 1) % 3])
                rows, cols = np.nonzero(near >= 0)
                keys = (pair << 34) | (segments[pair][rows] << 12) | near[rows, cols]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows].view(np.int64))], ["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b), a < b, that join every two fingerprints within
    ``max_bits`` (2) directly or through others."""
    if max_bits != MAX_BITS:
        raise ValueError("segments and keys are laid out for two differing bits")
    keys = storage.write_shared(fuzzy_keys(distinct), "fuzzy-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = storage.write_shared(keys.join(sizes, "key"), "fuzzy-buckets")
    left = shared.where(F.col("n") <= SMALL_BUCKET).select("key", F.col("fp").alias("a"))
    right = shared.where(F.col("n") <= SMALL_BUCKET).select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    few = left.join(right, (left.key == right.key) & (left.a < right.b) & near).select("a", "b").distinct()
    many = shared.where(F.col("n") > SMALL_BUCKET).select("fp").distinct()
    flips = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    met = (many.select("fp", F.explode(flips).alias("word")).groupBy("word")
           .agg(F.array_sort(F.collect_set("fp")).alias("near")).where(F.size("near") > 1)
           .select(F.col("near")[0].alias("a"), F.explode(F.slice("near", 2, 64)).alias("b")).distinct())
    return few.unionByName(met).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex reachable from every vertex of ``edges``
    (a, b), by alternating large-star and small-star rounds over written
    tables; about log(n) rounds."""
    spark = edges.sparkSession
    folders: list[str] = []  # written tables that the next round reads

    def written(df: DataFrame, name: str) -> DataFrame:
        folders.append(storage.shared_uri(spark, name))
        return storage.write_to(df, folders[-1])

    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "stars")
        # The centre of a large star has as many edges as its component has vertices.
        near = hot.join_per_key(both, low, "u", "n")
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        done = list(folders)
        now = written(small.select("e.*").where("u > v").distinct(), "small-star")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for folder in done:  # the next round reads the table just written alone
            remove_dir(spark, folder)
            folders.remove(folder)
        if state == seen:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, h, fp, root (the component's smallest
    fingerprint) and component_id (its smallest id, the document's own
    included). Documents meet their fingerprint, and fingerprints their
    component, without a shuffle of those that very many share."""
    prints = storage.write_shared(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = storage.write_shared(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")),
                                    "distinct-fingerprints")
    roots = components(links(distinct, max_bits)).withColumnRenamed("v", "fp")
    linked = roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    rooted = storage.write_shared(distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    lowest = storage.write_shared(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n")),
                                  "components")
    placed = hot.join_per_key(rooted, lowest, "root", "n").select("fp", "copies", "root", "component_id")
    placed = storage.write_shared(placed, "placed-fingerprints")
    return hot.join_per_key(prints, placed, "fp", "copies").drop("copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of every component: the one with the smallest id
    (NULL last), then the smallest text hash; equal rows count as one."""
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    rows = storage.write_shared(found.groupBy("root", "doc_id", "h").agg(F.count(F.lit(1)).alias("copies")), "component-rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    best = storage.write_shared(rows.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")), "first-rows")
    judged = hot.join_per_key(rows, best, "root", "n").select(
        F.col("doc_id").alias("id"), "h", "copies", order.eqNullSafe(F.col("best")).alias("first"))
    gone = storage.write_shared(judged.where(~F.col("first") | (F.col("copies") > 1)), "near-copies")
    out = storage.without_rows(docs, gone, id_col, text_col)
    again = gone.where("first")
    if again.isEmpty():
        return out
    # Representatives that the table holds several times over, each once.
    held = storage.only_rows(docs, again, id_col, text_col)
    one = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.lit(0))
    n = storage.free_name(docs, "_n")
    return out.unionByName(held.withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).drop(n))

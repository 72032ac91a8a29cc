"""Audit of how document filters overlap, over a sparse document-term matrix
(operator 11).

Texts are tokenised in shards of about ``SHARD_BYTES``; a shard is a few
blocks of about ``BLOCK`` nonzeros, each with its document keys and its part
of the matrix in compressed sparse rows (row ends, columns, counts), columns
numbered by the shard's own word list, which its first block carries.
The list is dealt out in buckets by word hash, one row for each bucket and
shard, and a bucket numbers its distinct words as they come; bucket bases
from prefix sums make the numbers global and dense. A word stands once a
shard, so no word is hotter than another. Each shard gets its list back as
numbers and its columns are rewritten. Row sums are words, nonzero counts
are distinct words: they decide filters A and B. The other flags come from
the same pass over the text and from the smallest id of equal texts
(SHA-256).

The audit itself needs only the number of documents per part, set of failed
filters and labels; every order and step is a sum over these.

Filters (a document fails): A under 200 words; B distinct words below half
the words; C more than 2 % of the code points are A-Z; D a character of
``#$%&*|``; E the text equals that of a smaller id.

Defined results: a NULL text is empty (fails A only, and E beside another
empty text); a NULL id is smaller than none and has none smaller, and no
label; rows that share an id are documents of their own, not copies of each
other, with the same label (several labels of an id: 1 if any is 1). A NULL
part is the empty string and shares its row. A text of any length is one row
of one shard. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armada.llm import hot, storage

#: Fixed values of the filters.
FILTERS = "ABCDE"
LEAST_WORDS = 200
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHARD_BYTES = 4 << 20
BLOCK = 1 << 16

#: Numbers of the matrix are packed little-endian: ends as 64 bits, counts as 32, columns as 32 (own list) or 64 (global).
KEYS = "shard long, doc_id array<bigint>, part array<string>, digest array<binary>, capitals array<boolean>, symbols array<boolean>"
MATRIX = f"{KEYS}, ends binary, counts binary, columns binary"
LOCAL = f"{MATRIX}, words array<binary>"
FLAGS = "doc_id long, part string, digest binary, words long, distinct long, c boolean, d boolean"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _packed(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([v.tobytes()], pa.binary()) for v in arrays]


def _shard(shard: int, ids: list, parts: list, texts: list[bytes], chars: list[int], buckets: int, block: int):
    """The blocks of a shard, one row each: the texts' keys and flags, and
    their matrix over the shard's own words. ``words`` of the first block has
    the words of every bucket, joined by spaces."""
    number, rows = defaultdict(itertools.count().__next__), []
    for text in texts:
        words = text.split()  # bytes: exactly the six ASCII white-space characters
        rows.append(np.unique(np.fromiter(map(number.__getitem__, words), np.int32, len(words)), return_counts=True))
    known = list(number)
    bucket = np.fromiter(map(zlib.crc32, known), np.int64, len(known)) % buckets
    order = np.argsort(bucket, kind="stable")
    renumbered = np.empty(len(known), "<i4")
    renumbered[order] = np.arange(len(known))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    known = [known[i] for i in order.tolist()]
    listed = [b" ".join(known[a:b]) for a, b in zip(cuts, cuts[1:])]
    filled = np.cumsum([len(r[0]) for r in rows])
    starts = [0, *(np.flatnonzero(np.diff(filled // block)) + 1).tolist(), len(rows)]
    for a, b in zip(starts, starts[1:]):
        own = texts[a:b]
        ends = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows[a:b]])]).astype("<i8")
        lists = [pa.array([v], pa.list_(t)) for v, t in (
            (ids[a:b], pa.int64()), (parts[a:b], pa.string()), ([hashlib.sha256(t).digest() for t in own], pa.binary()),
            ([100 * (len(t) - len(t.translate(None, CAPITALS))) > 2 * n for t, n in zip(own, chars[a:b])], pa.bool_()),
            ([len(t.translate(None, SYMBOLS)) < len(t) for t in own], pa.bool_()), (listed if a == 0 else [], pa.binary()))]
        numbers = _packed(ends, np.concatenate([r[1] for r in rows[a:b]]).astype("<i4"),
                          renumbered[np.concatenate([r[0] for r in rows[a:b]])])
        yield pa.RecordBatch.from_arrays([pa.array([shard]), *lists[:-1], *numbers, lists[-1]], _names(LOCAL))


def local_blocks(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                 shard_bytes: int = SHARD_BYTES, block: int = BLOCK) -> DataFrame:
    """A row for each block, columns numbered by its shard's word list."""
    def run(batches):
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId() << 33
        held, size = ([], [], [], []), 0
        for batch in batches:
            chars = pc.utf8_length(batch.column(2)).to_pylist()
            texts = batch.column(2).cast(pa.binary())
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, chars):
                text = row[2].as_py()
                for column, v in zip(held, (row[0], row[1], text, row[3])):
                    column.append(v)
                size += len(text)
                if size >= shard_bytes or len(held[0]) >= 1 << 16:
                    yield from _shard(shard, *held, buckets, block)
                    held, size, shard = ([], [], [], []), 0, shard + 1
        if held[0]:
            yield from _shard(shard, *held, buckets, block)

    narrow = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(part_col).cast("string"), F.lit("")),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return narrow.mapInArrow(run, LOCAL)


def numbered(blocks: DataFrame, buckets: int) -> DataFrame:
    """(shard, bucket, ranks, first, words, n): the numbers inside the bucket
    of a shard's words, and the words met here first, numbered from
    ``first`` on; ``n`` is how many these are."""
    def run(batches):
        at, number = None, None
        for batch in batches:
            for shard, bucket, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at:
                    at, number = bucket, defaultdict(itertools.count().__next__)
                words, first = blob.split(b" "), len(number)
                ranks = np.fromiter(map(number.__getitem__, words), "<i8", len(words))
                new = [words[i] for i in np.flatnonzero(ranks >= first).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.array([bucket], pa.int32()), pa.array([ranks.astype("<i4").tobytes()], pa.binary()),
                     pa.array([first], pa.int64()), pa.array([b" ".join(new)], pa.binary()), pa.array([len(new)], pa.int64())],
                    ["shard", "bucket", "ranks", "first", "words", "n"])

    listed = blocks.select("shard", F.posexplode("words").alias("bucket", "words")).where(F.octet_length("words") > 0)
    return listed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        run, "shard long, bucket int, ranks binary, first long, words binary, n long")


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
            shard_bytes: int = SHARD_BYTES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks, numbers), both written: blocks over their shards' own words,
    and per shard and bucket the global numbers of these words (``base`` +
    ``ranks``) with the words met there first."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = storage.write_shared(local_blocks(docs, buckets, id_col, text_col, part_col, shard_bytes, block), "local-blocks")
    ranked = storage.write_shared(numbered(blocks, buckets), "dictionary")
    sizes = ranked.groupBy("bucket").agg(F.sum("n").alias("held"))  # a row for each bucket of the setting
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return blocks, ranked.join(F.broadcast(bases), "bucket")


def _relabelled(blocks: pa.Table, numbers: pa.Table):
    """(row, ends, counts, columns) of every block of one shard, columns as global numbers."""
    given = sorted(numbers.to_pylist(), key=lambda g: g["bucket"])
    ids = [np.frombuffer(g["ranks"], "<i4") + np.int64(g["base"]) for g in given]
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    for batch in blocks.to_batches():
        for i in range(batch.num_rows):
            row = {c: batch.column(c).slice(i, 1) for c in batch.schema.names}
            ends, counts, columns = (np.frombuffer(row[c][0].as_py(), t) for c, t in (("ends", "<i8"), ("counts", "<i4"), ("columns", "<i4")))
            yield row, ends, counts, ids[columns]


def _per_shard(blocks: DataFrame, numbers: DataFrame, run, schema: str) -> DataFrame:
    """``run(blocks, numbers)`` for every shard; a shard is bounded by its bytes of text."""
    left, right = blocks.drop("words"), numbers.select("shard", "bucket", "base", "ranks")
    return left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(run, schema)


def matrix(blocks: DataFrame, numbers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, dictionary): keys, flags and ``ends``, ``counts`` and global
    ``columns`` of every block, packed; and (id, word) with dense ids."""
    def run(left, right):
        rows = [[row[c] for c in _names(KEYS)] + _packed(ends, counts, columns.astype("<i8"))
                for row, ends, counts, columns in _relabelled(left, right)]
        return pa.concat_tables([pa.table(r, _names(MATRIX)) for r in rows])

    words = numbers.where("n > 0").select((F.col("base") + F.col("first")).alias("_first"), F.posexplode(
        F.split(F.col("words").cast("string"), " ")).alias("_at", "word")).select((F.col("_first") + F.col("_at")).alias("id"), "word")
    return _per_shard(blocks, numbers, run, MATRIX), words


def flagged(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """A row for each document: doc_id, part, digest, words (row sum of the
    global matrix), distinct (its nonzero count) and the flags a to d."""
    def run(left, right):
        out = []
        for row, ends, counts, _ in _relabelled(left, right):
            running = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            keys = {c: row[c].flatten() for c in _names(KEYS)[1:]}
            out.append(pa.table([keys["doc_id"], keys["part"], keys["digest"], pa.array(running[ends[1:]] - running[ends[:-1]]),
                                 pa.array(np.diff(ends)), keys["capitals"], keys["symbols"]], _names(FLAGS)))
        return pa.concat_tables(out)

    rows = _per_shard(blocks, numbers, run, FLAGS)
    return rows.withColumn("a", F.col("words") < LEAST_WORDS).withColumn("b", 100 * F.col("distinct") < 50 * F.col("words"))


def combinations(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the set of filters
    they fail (bit i: filter i), with those labelled quality = 1 and toxic = 1."""
    mask = sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate("abcd")), F.lit(0))
    # Rows that share id, part and text are told apart by nothing below: counted together.
    rows = storage.write_shared(flagged(*encoded(docs, id_col, text_col, part_col)).withColumn("mask", mask).groupBy("doc_id", "part", "digest", "mask").agg(
        F.count(F.lit(1)).alias("n")), "flags")
    first = storage.write_shared(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("held")), "texts")
    copies = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << 4)
    full = hot.join_per_key(rows, first, "digest", "held").groupBy(
        "doc_id", "part", (F.col("mask") + copies).alias("mask")).agg(F.sum("n").alias("n"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    full = storage.write_shared(full, "failed")
    none = F.lit(0).alias("good"), F.lit(0).alias("toxic")
    marked = full.where("doc_id is not null").join(known, "doc_id", "left").fillna(0, ["good", "toxic"]).unionByName(
        full.where("doc_id is null").select("*", *none))
    return marked.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(counted: DataFrame) -> DataFrame:
    """All orders and steps of every part: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley."""
    steps = {}  # (filter, set applied before) -> the orders and steps at which this happens
    for order in itertools.permutations(range(len(FILTERS))):
        for at, f in enumerate(order):
            steps.setdefault((f, sum(1 << g for g in order[:at])), []).append(("".join(FILTERS[g] for g in order), at + 1))
    cases = F.expr("array({})".format(", ".join("named_struct('own', {}, 'before', {}, 'places', array({}))".format(
        1 << f, before, ", ".join(f"named_struct('filter_order', '{o}', 'step', {s})" for o, s in places))
        for (f, before), places in steps.items())))
    meets = F.col("mask").bitwiseAND(F.col("own")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(when, what="n"):
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")

    each = counted.select("*", F.explode(cases).alias("case")).select(
        "part", "mask", "n", "good", "toxic", "case.own", "case.before", "case.places")
    sums = each.groupBy("part", "own", "before").agg(
        total(~meets & ~earlier).alias("kept"), total(meets & ~earlier).alias("removed"), total(meets & earlier).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(meets & ~earlier, "good").alias("good_lost"),
        total(meets & ~earlier, "toxic").alias("toxic_lost"), F.first("places").alias("places"))
    placed = sums.select("*", F.size("places").alias("orders"))
    shapley = F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "own"))  # 16 rows a part and filter
    return placed.withColumn("shapley", shapley).select(
        "part", F.explode("places").alias("place"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        "shapley").select("part", "place.filter_order", "place.step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                          "toxic_lost", "shapley")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs`` by ``source``."""
    return audit(combinations(docs, labels))

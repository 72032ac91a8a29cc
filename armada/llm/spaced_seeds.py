"""Benchmark decontamination by spaced seeds (operator 1), DataFrame functions only.

A text becomes lower-case tokens of letters and digits. Fixed masks laid
over every position keep some tokens of a span and ignore the others, so a
substituted token under an ignored position does not change the hash. Test
and training hashes are joined; every hit fixes an alignment of an item
with a document, and the tokens of the item are compared along it: an
overlap counts if at least ``MIN_SAME`` of the whole item's tokens are equal,
or of a stretch of ``MIN_OVERLAP`` of them or more (a part quoted between
other text, the lines that are left of an item), or of an item below
``SHORT`` tokens with one token put in or left out.

The test side is small beside the corpus but may grow: it goes out in
blocks of items, about ``BLOCK_HASHES`` seeds and ``BLOCK_BYTES`` of tokens each. A block's seeds
are broadcast and joined in a pass over the documents that shuffles no whole text; more
blocks than one are written one after another. Every hit takes with it the tokens
of the document that lie beside the item, and no others, and goes at once into one row per document, item
and alignment: a document that quotes a thousand items is never held a thousand
times. Only these rows are exchanged and compared.

The masks depend on the item's length and lose nothing: however the tokens
that ``MIN_SAME`` lets be others lie in an item or in a stretch of
``MIN_OVERLAP`` tokens or more, one mask finds only equal tokens somewhere. This
is checked for every pattern of up to 21 tokens (see the tests); anything longer
splits into parts of 11 to 21, one of which has no more than its share.

Defined results: NULL and empty texts have no tokens and no overlaps; items
of fewer than ``MIN_TOKENS`` tokens say nothing, and in scripts without
spaces every letter is a token; repeated rows of a document or an item give the
rows once, of equally good alignments the first; very long texts are compared
as a whole, token by token, and fit into a task as any row does; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armada.llm import storage

#: The fewest tokens of an item and its masks (1 keeps a token, 0 ignores it).
MASKS = ((11, ("101111", "111001001")), (9, ("11011", "1101001")), (5, ("1111", "11101", "11011", "10111")))
UNSPACED = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]"
HIGH = "[\\x{0E00}-\\x{1FFF}\\x{2E80}-\\x{10FFFF}]"  # where these scripts lie
MIN_TOKENS = 5             # shorter items say nothing
MIN_SAME = 0.8             # share of equal tokens
MIN_OVERLAP = 12           # tokens of an item that must lie inside the document, or the whole item
SHORT = 25                 # items below are also compared with one token put in or left out
BLOCK_HASHES = 200_000     # seeds broadcast at a time,
BLOCK_BYTES = 64 << 20     # and the size of their items' tokens


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; a letter of a script without spaces is a run of its own.
    ASCII texts, and texts without a character from where such scripts lie, take cheaper patterns of the same meaning."""
    t = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    apart = F.regexp_replace(t, f"({UNSPACED}\\p{{M}}*)", " $1 ")
    wide = F.split(F.when(t.rlike(HIGH), apart).otherwise(t), "[^a-z0-9\\p{L}\\p{M}\\p{N}]+", -1)
    runs = F.when(F.octet_length(t) == F.length(t), F.split(t, "[^a-z0-9]+", -1)).otherwise(wide)
    return F.filter(runs, lambda x: x != "")


def _let(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select("*", F.explode(F.array(value)).alias(name))


def masks_of(n: int) -> tuple[str, ...]:
    """The masks for an item of ``n`` tokens."""
    return next((masks for least, masks in MASKS if n >= least), ())


def _seed(hashes: Column, place: Column, mask: str, last: Column) -> Column:
    """The mask's hash at a place of an array of token hashes, NULL beyond ``last`` places."""
    kept = [F.get(hashes, place + i) for i, c in enumerate(mask) if c == "1"]
    return F.when(place + (len(mask) - 1) < last, F.xxhash64(F.lit(mask), *kept))


def _with_seeds(df: DataFrame, name: str, masks: list[str]) -> DataFrame:
    """A row for every mask at every place of the token hashes ``h``: the place as ``name``, the seed.
    Places are taken from the array by index, so that all of it is generated code."""
    df = df.select("*", F.posexplode("h").alias(name, "_first"))
    seeds = F.array(*[_seed(F.col("h"), F.col(name), m, F.size("h")) for m in masks])
    return df.select("*", F.explode(seeds).alias("seed")).where(F.col("seed").isNotNull()).drop("_first", "h")


def _hashed(df: DataFrame, words: str) -> DataFrame:
    return _let(df, "h", F.transform(F.col(words), lambda x: F.xxhash64(x)))


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", min_same: float = MIN_SAME) -> DataFrame:
    """One row per document and item that overlap: the id columns, position
    (of the item's first token in the document, may be negative), n_same,
    n_compared and same (their ratio) of the alignment with most equal tokens."""
    test = items.select(F.col(item_col).alias("_item"), tokens(F.col(item_text_col)).alias("item"))
    test = test.where(F.size("item") >= MIN_TOKENS).distinct().select(F.monotonically_increasing_id().alias("_key"), "*")
    test = storage.write_shared(test, "items")          # a key stays the same in every pass
    n_items = F.size("item")
    parts, masks = [], []
    for (least, mine), below in zip(MASKS, (None, *(n for n, _ in MASKS))):
        rows = test.where(n_items >= least) if below is None else test.where(n_items.between(least, below - 1))
        if below is None or not rows.isEmpty():     # the corpus takes the masks that some item needs
            rows = _hashed(rows.select("_key", n_items.alias("n"), "item"), "item").drop("item")
            parts.append(_with_seeds(rows, "q", list(mine)))
            masks += [m for m in mine if m not in masks]
    seeds = reduce(DataFrame.unionByName, parts)
    # An item's tokens go out once (offsets and padding of 16 bytes each).
    size = test.agg(F.coalesce(F.sum(F.octet_length(F.array_join("item", "")) + 16 * n_items), F.lit(0))).first()[0]
    blocks = max(1, -(-seeds.count() // BLOCK_HASHES), -(-size // BLOCK_BYTES))

    corpus = _let(docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("t")), "words", tokens(F.col("t")))
    corpus = _with_seeds(_hashed(corpus.drop("t"), "words"), "i", masks)
    if blocks == 1:
        found = [_compared(corpus, seeds, test, min_same)]
    else:                                               # of one plan, all broadcasts would be held at once
        mine = [F.pmod(F.xxhash64("_key"), F.lit(blocks)) == b for b in range(blocks)]
        found = [storage.write_shared(_compared(corpus, seeds.where(x), test.where(x), min_same), "overlaps") for x in mine]
    hits = reduce(DataFrame.unionByName, found)
    best = F.max(F.struct("c.whole", "c.n_same", "c.n_compared", (-F.col("position")).alias("p"))).alias("b")
    return hits.groupBy("_doc", "_item").agg(best).select(
        F.col("_doc").alias(id_col), F.col("_item").alias(item_col), (-F.col("b.p")).cast("long").alias("position"),
        F.col("b.n_same").cast("long").alias("n_same"), F.col("b.n_compared").cast("long").alias("n_compared"),
        (F.col("b.n_same") / F.col("b.n_compared")).alias("same"))


def _compared(corpus: DataFrame, seeds: DataFrame, test: DataFrame, min_same: float) -> DataFrame:
    """The alignments that agree, as ``c``. Join, part and distinct rows are one step of generated code, in which
    a document's hits would otherwise wait together, each with all of its tokens."""
    met = corpus.join(F.broadcast(seeds), "seed")
    position = F.col("i") - F.col("q")
    start = F.greatest(position - 1, F.lit(0))          # a token more on either side, for a gap
    part = F.slice(F.col("words"), start + 1, position + F.col("n") + 1 - start)
    met = met.select("_doc", "_key", position.alias("position"), part.alias("words")).distinct()
    met = met.join(F.broadcast(test), "_key")
    met = met.select("*", F.least(F.col("position"), F.lit(1)).alias("at"))     # of the item's first token in the part
    met = _let(met, "equal", _equal(F.col("at")))
    met = _let(met, "c", _agreement(min_same)).select("_doc", "_item", "position", "c")
    return met.where(F.col("c").isNotNull())


def _equal(at: Column) -> Column:
    """Whether (1 or 0) the tokens of the item that lie inside the document are equal along a hit, in their order."""
    skip = F.greatest(-at, F.lit(0))                    # item tokens before the document's start
    part = F.slice(F.col("words"), F.greatest(at, F.lit(0)) + 1, F.size("item") - skip)
    item = F.slice(F.col("item"), skip + 1, F.size("item"))
    pairs = F.zip_with(part, item, lambda a, b: a == b)  # NULL beyond the end of either
    return F.transform(F.filter(pairs, lambda x: x.isNotNull()), lambda x: x.cast("int"))


def _agreement(min_same: float) -> Column:
    """(whole, n_same, n_compared) of the item if it agrees along the hit as a
    whole, else of its best stretch, else of the item with one gap; NULL if none does."""
    equal, n_item = F.col("equal"), F.size("item")

    def of(whole, n_same, n_compared):
        return F.struct(F.lit(whole).alias("whole"), n_same.alias("n_same"), n_compared.alias("n_compared"))

    n_same, n = F.size(F.array_remove(equal, 0)), F.size(equal)
    out = F.when((n >= F.least(F.lit(MIN_OVERLAP), n_item)) & (n_same >= min_same * n), of(True, n_same, n))
    stretch, gap = _stretch(min_same), _one_gap()
    some = F.when((n >= MIN_OVERLAP) & (n_same >= min_same * MIN_OVERLAP), F.filter(
        F.transform(F.array(stretch), lambda x: of(False, x["n_same"], x["n"])), lambda x: x["n_compared"] > 0))
    found = F.get(F.filter(F.transform(F.array(gap), lambda x: of(False, x, n_item)),
                           lambda x: x["n_same"] >= min_same * x["n_compared"]), F.lit(0))
    return out.otherwise(F.coalesce(F.get(some, F.lit(0)), F.when(n_item < SHORT, found)))


def _stretch(min_same: float) -> Column:
    """(n, n_same) of the stretch of at least ``MIN_OVERLAP`` tokens along a hit in which equal
    tokens outweigh the others most; n is 0 if none has ``min_same`` equal tokens.
    A running sum of weights against its least value ``MIN_OVERLAP`` tokens back or more."""
    hit, miss = 1000 - round(1000 * min_same), -round(1000 * min_same)
    weight = lambda x: F.when(x == 1, F.lit(hit)).otherwise(F.lit(miss))
    state = lambda i, s, back, low, best: F.struct(
        i.alias("i"), s.alias("s"), back.alias("back"), low.alias("low"), best.alias("best"))
    point = lambda s, i: F.struct(s.alias("s"), i.alias("i"))
    score = lambda s, n: F.struct(s.alias("s"), n.alias("n"))

    def step(a, x):
        i, s = a["i"] + 1, a["s"] + weight(x)           # tokens so far and their weight
        start = i - MIN_OVERLAP                         # the last place where a stretch can begin
        back = F.when(start > 0, a["back"] + weight(F.get(F.col("equal"), start - 1))).otherwise(F.lit(0))
        low = F.when(start > 0, F.least(a["low"], point(back, start))).otherwise(a["low"])
        return state(i, s, back, low, a["best"])

    def scored(a, x):
        b = step(a, x)
        return F.element_at(F.transform(F.array(b), lambda b: state(
            b["i"], b["s"], b["back"], b["low"], F.when(b["i"] >= MIN_OVERLAP, F.greatest(
                b["best"], score(b["s"] - b["low"]["s"], b["i"] - b["low"]["i"]))).otherwise(b["best"]))), 1)

    zero = state(F.lit(0), F.lit(0), F.lit(0), point(F.lit(0), F.lit(0)), score(F.lit(-1), F.lit(0)))
    return F.aggregate(F.col("equal"), zero, scored, lambda a: F.struct(
        a["best"]["n"].alias("n"), ((a["best"]["s"] - miss * a["best"]["n"]) / 1000).cast("int").alias("n_same")))


def _one_gap() -> Column:
    """Most equal tokens of the item if it leaves the hit's diagonal for a neighbouring
    one, or comes from it, at one place; a token that only the document has counts as one unequal."""
    words, item = F.col("words"), F.col("item")

    def along(d):
        return F.transform(item, lambda x, i: F.coalesce(
            (F.get(words, F.col("at") + d + i) == x).cast("int"), F.lit(0)))

    def turned(first, second):
        """Tokens equal on ``first`` up to some place and on ``second`` from there on."""
        gain = F.aggregate(F.zip_with(first, second, lambda a, b: a - b), F.struct(F.lit(0).alias("s"), F.lit(0).alias("top")),
                           lambda a, x: F.struct((a["s"] + x).alias("s"), F.greatest(a["top"], a["s"] + x).alias("top")),
                           lambda a: a["top"])
        return gain + F.size(F.array_remove(second, 0))

    return F.element_at(F.transform(F.array(F.struct(along(-1).alias("a"), along(0).alias("b"), along(1).alias("c"))), lambda x: F.greatest(
        turned(x["a"], x["b"]) - 1, turned(x["b"], x["c"]) - 1, turned(x["b"], x["a"]), turned(x["c"], x["b"]))), 1)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text overlaps an item; rows are told
    apart by id and text, so a NULL or repeated id is judged by its own text."""
    row = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"))
    found = find_overlaps(docs.select(row.alias("_row"), F.col(text_col).alias("t")), items, "_row", "t",
                          item_col, item_text_col)
    leaks = storage.write_shared(found.select("_row.id", "_row.h").distinct(), "leaks")
    return storage.without_rows(docs, leaks, id_col, text_col)

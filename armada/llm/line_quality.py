"""Line-first quality rules (operator 8), DataFrame functions only.

Every line is judged alone; lines that break a rule are removed and a
document is rejected if too much of its text went with them. Documents that
fail the base rules (few words, many repeated words) are rejected as well.

Line rules:

* punctuation: marks and doubled exclamation or question marks on too many
  words, or a line of few words that does not end like a sentence;
* navigation: items between separators, or nothing but a menu word;
* boilerplate: a stock phrase in a line of few words (a long line loses the
  short sentences that hold one, its other characters stay as they are), or a
  line equal to an earlier line of the document.

All work happens inside the row: no shuffle, memory bounded by a document.

Defined results: a NULL text is an empty text, has no words and fails;
lines without a word are kept as they are (they hold nothing to lose);
repeated rows are judged one by one; very long texts are judged whole, inside
their row; an empty table gives no rows; other columns pass through unchanged,
and names of theirs that clash with working columns are stepped around.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armada.llm import storage

#: White space between words, symbol characters, end of a sentence.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MARKS = "[#*$%&|<>]+|[!?]{2,}"
ENDING = "[.!?:;…。！？\"'”’»)\\]]\\s*$"
SENTENCE = "(?<=[.!?…])(?=[\\x20\\x09-\\x0D])|(?<=[。！？])"  # white space goes with the sentence after it
SEPARATORS = "(^|\\s)[|>»›·•/\\\\]+(?=\\s|$)"
MENU = "(?i)^\\W*(home|menu|search|login|log in|sign in|sign up|register|next|previous|back|top|contact|about|help|" \
       "sitemap|share|tweet|print|read more|skip to content|skip to main content)\\W*$"
BOILERPLATE = "(?i)javascript|cookie policy|uses cookies|privacy policy|terms of (use|service)|all rights reserved|" \
              "lorem ipsum|click here|subscribe to our|sign up for our|404 not found|powered by wordpress"

MIN_WORDS = 50
MAX_REPEATED = 50           # percent of words in repeated windows
MAX_MARKS = 0.3             # marks a word
MAX_SEPARATORS = 0.2        # separators a word
SHORT_LINE = 4              # words; shorter lines need an ending
LONG_LINE = 40              # words; such lines are judged by sentence for stock phrases
MAX_LOST = 0.3              # share of the words' characters


def _let(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once, whatever reads it afterwards."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _in(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.translate(text, SPACES, "")).cast("long")


def _repeated(words: Column) -> Column:
    """Words covered by 3-word windows that are found twice or more."""
    windows = F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("s"), i.alias("i"))))

    def places(s):
        same = lambda a, b: s[a]["s"] == s[b]["s"]
        hit = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(
            ((k > 0) & same(F.greatest(k - 1, F.lit(0)), k))
            | ((k < F.size(s) - 1) & same(k, F.least(k + 1, F.size(s) - 1))), s[k]["i"]))
        return F.sort_array(F.filter(hit, lambda x: x.isNotNull()))

    covered = F.aggregate(
        _in(windows, places), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"])
    return covered.cast("long")


def _marked_lines(lines: Column) -> Column:
    """Lines in their order as (i, l, again): again if an earlier line is equal."""
    plain = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("l"), F.lit(False).alias("again")))
    by_text = F.sort_array(F.transform(lines, lambda x, i: F.struct(x.alias("l"), i.alias("i"))))

    def back(s):
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.struct(
            s[k]["i"].alias("i"), s[k]["l"].alias("l"),
            ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["l"] == s[k]["l"])).alias("again"))))

    return F.when(F.size(F.array_distinct(lines)) == F.size(lines), plain).otherwise(_in(by_text, back))


def _left(x: Column) -> Column:
    """What stays of a line, NULL if nothing does. A phrase fails a line of few
    words; of a long line it fails the sentences of few words that hold it."""
    line = x["l"]
    words = lambda t: F.regexp_count(t, F.lit(WORD))
    kept = F.filter(F.split(line, SENTENCE, -1), lambda t: ~t.rlike(BOILERPLATE) | (words(t) >= LONG_LINE))
    return F.when(_line_fails(x), F.lit(None)).when(~line.rlike(BOILERPLATE), line).when(
        words(line) >= LONG_LINE, F.when(F.exists(kept, lambda t: t.rlike(WORD)), F.array_join(kept, "")))


def _line_fails(x: Column) -> Column:
    line = x["l"]
    n = F.regexp_count(line, F.lit(WORD))
    marks = F.regexp_count(line, F.lit(MARKS))
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    punctuation = ((marks >= 2) & (marks > MAX_MARKS * n)) | ((n < SHORT_LINE) & ~line.rlike(ENDING))
    navigation = ((separators >= 2) & (separators > MAX_SEPARATORS * n)) | line.rlike(MENU)
    return (n > 0) & (punctuation | navigation | x["again"])


def judge(docs: DataFrame, text_col: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, clean_text (the lines that
    stay), lost (share of the words' characters removed) and kept."""
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"column {into} is there already")
    t, w, h, m, k = (storage.free_name(docs, f"{into}_{x}") for x in ("text", "words", "hashes", "marked", "left"))
    df = docs.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    bare = F.btrim(F.col(t), F.lit(SPACES))
    df = _let(df, w, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1)))
    df = _let(df, h, F.transform(F.col(w), lambda x: F.xxhash64(x)))
    df = _let(df, m, _marked_lines(F.split(F.col(t), "\n", -1)))
    df = _let(df, k, F.array_join(F.transform(F.col(m), _left), "\n"))
    words, hashes, marked, left = F.col(w), F.col(h), F.col(m), F.col(k)
    n = F.size(words)
    # Equal windows have equal hashes, so distinct hashes prove that no window is repeated.
    windows = F.transform(F.slice(hashes, 1, F.greatest(n - 2, F.lit(0))),
                          lambda x, i: F.xxhash64(x, hashes[i + 1], hashes[i + 2]))
    repeated = F.when((n < 4) | _in(windows, lambda a: F.size(F.array_distinct(a)) == F.size(a)), F.lit(0).cast("long")
                      ).otherwise(_repeated(words))
    again = F.size(F.filter(marked, lambda x: x["again"] & x["l"].rlike(WORD)))
    df = _let(df, into, F.struct(
        n.cast("long").alias("n_words"), _chars(F.col(t)).alias("word_chars"),
        (F.length(F.col(t)) - F.length(F.translate(F.col(t), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        again.cast("long").alias("n_dup_lines"), repeated.alias("n_repeat_words"), left.alias("clean_text")))
    q = F.col(into)
    base = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED * q["n_words"])
    lost = F.when(q["word_chars"] == 0, F.lit(0.0)).otherwise(1 - _chars(q["clean_text"]) / q["word_chars"])
    full = q.withField("base_failed", base).withField("lost", lost)
    full = full.withField("kept", ~base & (lost <= MAX_LOST))
    return df.withColumn(into, full).drop(t, w, h, m, k)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base figures and the verdict."""
    q = judge(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return q.select("doc_id", *[F.col("quality")[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def keep_clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that stay, with their columns as they came and the
    failing lines gone from the text."""
    name = storage.free_name(docs, "_quality")
    q = judge(docs, text_col, name).where(F.col(name)["kept"])
    return q.withColumn(text_col, F.col(name)["clean_text"]).drop(name)

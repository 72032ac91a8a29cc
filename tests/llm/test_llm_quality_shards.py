"""Operators 5 and 8 against plain Python on small and odd inputs."""
import re
import zlib
from collections import Counter

import pytest

from armada.llm import line_quality, shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def clean(n, seed=0):
    return "\n".join(" ".join(f"w{seed}x{i}y{j}" for j in range(14)) + "." for i in range(n))


def figures(text):
    t = text or ""
    w = WORD.findall(t)
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


ODD = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "a a a a a a", "x y z é漢😀 b",
       "one\none\n\none\n \n", "ab " * 400, "l1 l2 l3\n" * 60, clean(6), clean(6) + "\n" + clean(6), "w " * 40_000,
       " ".join(f"u{i}" for i in range(30_000))]


def test_base_figures_equal_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:7] for r in line_quality.report(df).collect()}
    assert got == {i: figures(t) for i, t in enumerate(ODD)}


@pytest.mark.parametrize("line,fails", [
    ("A plain sentence that ends here.", False), ("Home | News | Sport | Contact | About us", True),
    ("word### of*** the%%% day&&& is$$$", True), ("LOUD!! WORDS!! EVERY!! WHERE!!", True), ("menu", True),
    ("We use cookies, see our privacy policy for more.", True), ("Short title", True), ("Is it so?", False),
    ("A long line that has no ending but many words in it", False), ("", False)])
def test_line_rules(spark, line, fails):
    df = spark.createDataFrame([(1, clean(8) + "\n" + line)], "doc_id long, text string")
    kept = line_quality.keep_clean(df).collect()[0].text
    assert kept == clean(8) + ("" if fails else "\n" + line)


def test_rejects_what_loses_too_much_and_keeps_columns(spark):
    menu = "\n".join("Home | News | Sport | Games | Weather | Contact | About | Help | Jobs | Press | Top" for _ in range(1))
    rows = [(1, clean(6), "x", 1), (2, clean(5) + "\n" + "\n".join(f"{menu} | {i}" for i in range(9)), "y", 2),
            (None, clean(7), None, None), (4, None, "z", 4), (1, clean(6), "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _quality string, _quality_words int")
    out = line_quality.keep_clean(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r["_quality"] or "") for r in out.collect()) == [(0, ""), (1, "x"), (1, "x")]
    assert line_quality.report(df.limit(0)).count() == 0


def long_line(*stock, n=50, seed=0):
    """Sentences of ten words, with odd white space between them and ``stock`` sentences in their midst."""
    parts = [" ".join(f"l{seed}n{i}k{j}" for j in range(10)) + "." for i in range(n // 10)]
    parts[2:2] = stock
    return "  ".join(parts[:3]) + " \t" + " ".join(parts[3:])


def test_long_lines_lose_only_sentences_with_a_stock_phrase(spark):
    phrase = "Please click here."
    one = " ".join(f"v{i}" for i in range(45)) + " click here for more"
    rows = [(1, long_line(phrase)), (2, "漢字です。click here! " + long_line()), (3, long_line(one + ".")),
            (4, f"{phrase} " + long_line() + " "), (5, long_line(*[f"{phrase[:-1]} {i}." for i in range(40)])),
            (6, long_line("Is a privacy policy here?", "x.y Lorem ipsum…", n=200)), (7, clean(5) + "\n" + phrase)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_quality.keep_clean(df).collect()}
    assert got[1] == rows[0][1].replace(f"  {phrase}", "")
    assert got[2] == "漢字です。" + " " + long_line() and got[3] == rows[2][1] and got[4] == " " + long_line() + " "
    assert got[7] == clean(5) and "Lorem" not in got[6] and "privacy" not in got[6] and "x.y" not in got[6] and "n19k9." in got[6]

    import duckdb

    from armada.llm.oracle import QUALITY
    both = df.unionByName(spark.createDataFrame(
        list(enumerate(ODD, 100)) + [(50 + i, long_line(*[f"{phrase[:-1]} {j}." for j in range(i)], seed=i)) for i in range(12)],
        "doc_id long, text string"))
    con = duckdb.connect()
    con.register("documents", both.toArrow())
    columns = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"
    verdicts = sorted(map(tuple, line_quality.report(both).select(*columns.split(", ")).collect()))
    assert verdicts == sorted(con.execute(f"SELECT {columns} FROM ({QUALITY})").fetchall())
    assert len({v[-1] for v in verdicts if v[0] < 100}) == 2


def test_repeated_lines_are_removed(spark):
    text = clean(6) + "\n" + clean(1)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert line_quality.keep_clean(df).collect()[0].text == clean(6)


def test_shards_are_contiguous_gapless_and_near_equal(spark):
    rows = [(i, "x" * (i * 37 % 501)) for i in range(3000)] + [(5, None), (None, "null id"), (None, "null id"), (7, "x" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(shards.assign_shards(df, 16).collect(), key=lambda r: (r.shard, r.slot))
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (d, len(t or "") + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    ids = [r.doc_id if r.doc_id is not None else -1 for r in got]
    assert ids == sorted(ids)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for s in range(16):
        part = [r for r in got if r.shard == s]
        assert [r.slot for r in part] == list(range(len(part)))
        assert abs(sum(r.size for r in part) - total / 16) <= largest
    assert shards.assign_shards(df.limit(0), 16).count() == 0


def test_a_text_longer_than_a_shard_and_clashing_columns(spark):
    rows = [(i, "y" * 9, 0, 1, "a") for i in range(40)] + [(20, "x" * 100_000, 0, 1, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, _at int, total string")
    got = shards.assign_shards(df, 16).collect()
    place = {r.size: r.shard for r in got if r.size > 10}
    assert len(got) == 41 and place == {100_001: 7 + (place[100_001] == 8)} and {r.shard for r in got} == {0, place[100_001], 15}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(16))


def test_few_documents(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [(r.shard, r.slot) for r in shards.assign_shards(df, 16).collect()] == [(8, 0)]

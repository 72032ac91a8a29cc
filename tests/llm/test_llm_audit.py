"""Operator 11 against plain Python."""
import itertools
import re

import numpy as np

from armada.llm import filter_audit as audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string"


def failures(rows):
    """(part, set of failed filters) of every (id, text, source) row."""
    texts = [t or "" for _, t, _ in rows]
    ids = {}
    for (i, _, _), t in zip(rows, texts):
        if i is not None:
            ids.setdefault(t, []).append(i)
    out = []
    for (i, _, part), t in zip(rows, texts):
        w = WORD.findall(t)
        f = {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and min(ids[t]) < i else set()
        out.append((part or "", frozenset(f)))
    return out


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = [(p, f, i in good, i in toxic) for (p, f), (i, _, _) in zip(failures(rows), rows)]
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        removed = {}
        for order in itertools.permutations("ABCDE"):
            gone = set()
            for step, x in enumerate(order):
                meets, earlier = [x in d[1] for d in own], [bool(d[1] & gone) for d in own]
                now = [d for d, m, e in zip(own, meets, earlier) if m and not e]
                out[part, "".join(order), step + 1] = [
                    sum(not m and not e for m, e in zip(meets, earlier)), len(now), sum(m and e for m, e in zip(meets, earlier)),
                    sum(d[1] == {x} for d in own), sum(d[2] for d in now), sum(d[3] for d in now), x]
                removed[x] = removed.get(x, 0) + len(now)
                gone.add(x)
        for key in out:
            if key[0] == part:
                out[key][6] = removed[out[key][6]]
    return {k: tuple(v) for k, v in out.items()}


LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [(1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (4, "same words " * 150, "a"), (5, "SHOUT " + LONG.upper(), "b"), (6, LONG + " 5 % of it", None),
        (7, None, "a"), (8, "", "b"), (9, " \t\n", "b"), (None, LONG, "a"), (None, None, None), (2, LONG, "a"), (2, "other", "c"),
        (10, "é漢😀 A b c\x0b\x0cd", ""), (11, "x " * 30_000, "a"), (12, "|", "d"), (-5, "x " * 30_000, "d"), (13, "y" * 300_000, "d")]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, None, 1), (5, 1, 1), (None, 1, 1), (99, 1, 1), (7, 1, None)]


def frames(spark, rows, labels):
    return (spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def result(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_audit_equals_plain_python(spark):
    assert result(audit.report(*frames(spark, ROWS, LABELS))) == plain(ROWS, LABELS)


def test_a_hot_text_and_a_hot_source(spark):
    rows = [(i, LONG if i % 3 else f"{LONG} {i % 7}", "hot" if i % 4 else f"s{i % 5}") for i in range(600)] + [(None, LONG, "hot")] * 200
    labels = [(i, i % 2, i % 5 == 0 and 1 or 0) for i in range(0, 600, 3)]
    assert result(audit.report(*frames(spark, rows, labels))) == plain(rows, labels)


def test_empty_tables_and_clashing_columns(spark):
    docs, labels = frames(spark, ROWS, LABELS)
    assert audit.report(docs.limit(0), labels).count() == 0
    assert result(audit.report(docs, labels.limit(0))) == plain(ROWS, [])
    more = docs.selectExpr("*", "1 as mask", "'x' as digest", "2 as n", "3 as quality", "4 as shard", "'z' as words", "5 as _key")
    assert result(audit.report(more, labels.selectExpr("*", "1 as part", "2 as n", "3 as good"))) == plain(ROWS, LABELS)


def test_the_matrix_gives_the_texts_word_counts_back(spark):
    docs, _ = frames(spark, [r for r in ROWS if r[0] is not None and len(r[1] or "") < 100_000], LABELS)
    shards, words = audit.matrix(*audit.encoded(docs, shard_bytes=2_000, block=300))
    listed = words.collect()
    word = {r.id: r.word.encode() for r in listed}
    assert sorted(r.id for r in listed) == list(range(len(listed))) and len(set(word.values())) == len(listed)
    got = []
    for s in shards.collect():
        ends, columns, counts = (np.frombuffer(b, t).tolist() for b, t in ((s.ends, "<i8"), (s["columns"], "<i8"), (s.counts, "<i4")))
        assert ends[0] == 0 and ends[-1] == len(columns) == len(counts)
        for i, a, b in zip(s.doc_id, ends, ends[1:]):
            got.append((i, sorted((word[c], n) for c, n in zip(columns[a:b], counts[a:b]))))
    assert shards.count() > 2
    want = [(i, sorted((w, t.encode().split().count(w)) for w in set(t.encode().split())))
            for i, t in ((r.doc_id, r.text or "") for r in docs.collect())]
    assert sorted(got) == sorted(want)

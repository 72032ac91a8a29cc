"""Operator 9 against exact search, planted edits and unbanded alignment."""
import random
import re

import numpy as np

from armada.llm import licenses as L

INDEX = L.Index(L.TEMPLATES)


def words(n, r):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def test_every_template_is_found_where_it_stands():
    r = random.Random(1)
    for k, (name, template) in enumerate(L.TEMPLATES):
        before, after = " ".join(words(40, r)), " ".join(words(40, r))
        got = L.find(INDEX, f"{before}\n{template.upper()}. {after}")
        best = max(got, key=lambda f: f[5])
        assert INDEX.names[best[2]] == name
        first, last = L.TOKEN.search(template), list(L.TOKEN.finditer(template))[-1]
        assert (best[0], best[1]) == (len(before) + 1 + first.start(), len(before) + 1 + last.end()) and best[4] == 1.0


def test_substitutions_and_gaps_are_tolerated_and_clean_text_is_left_alone():
    r = random.Random(2)
    long = [k for k, s in enumerate(INDEX.sequences) if len(s) >= 15]
    for k in long:
        w = re.findall(r"[^\W_]+", L.TEMPLATES[k][1])
        w[5] = "changed"
        w[9:9] = ["inserted", "words"]
        del w[-2]
        got = L.find(INDEX, " ".join(words(30, r) + w + words(30, r)))
        assert len(got) == 1 and INDEX.names[got[0][2]] == L.TEMPLATES[k][0] and 0.8 <= got[0][4] < 1
    for _ in range(50):
        assert L.find(INDEX, " ".join(words(300, r) + ["licensed", "under", "the", "stars"])) == []


def test_whole_texts_are_told_apart_and_edits_in_them_tolerated():
    """Random edits in license texts, some of which hold others or share most of their words."""
    r = random.Random(6)
    whole = [k for k, s in enumerate(INDEX.sequences) if len(s) >= 100]
    assert len(L.TEMPLATES) >= 30 and len(whole) >= 7
    for k in whole:
        for _ in range(6):
            w = re.findall(r"[^\W_]+", L.TEMPLATES[k][1])
            for _ in range(len(w) // 12):
                i = r.randrange(5, len(w) - 5)
                w[i:i + 1] = r.choice([["changed"], [w[i].upper()], []])
            i = r.randrange(5, len(w) - 5)
            w[i:i] = ["put", "in"]
            got = L.find(INDEX, " ".join(words(30, r) + w + words(30, r)))
            assert [INDEX.names[f[2]] for f in got] == [L.TEMPLATES[k][0]] and got[0][4] >= 0.8
            a, b, _, matched, _, _ = got[0]
            assert matched >= 0.8 * len(INDEX.sequences[k])


def test_the_token_count_before_the_alignment_loses_nothing(monkeypatch):
    r = random.Random(7)
    texts = []
    for _ in range(60):
        w = words(20, r)
        for _ in range(4):
            t = L.tokens(r.choice(L.TEMPLATES)[1])
            a = r.randrange(max(1, len(t) // 4))
            w += [x if r.random() > .1 else "other" for x in t[a:]] + words(r.randrange(20), r)
        texts.append(" ".join(w))
    got = [L.find(INDEX, t) for t in texts]
    free = L.Index(L.TEMPLATES)
    free.member[:] = True
    assert got == [L.find(free, t) for t in texts] and sum(map(len, got)) > 60


def full(template, text):
    """Unbanded local alignment score."""
    h, best = np.zeros((len(template) + 1, len(text) + 1)), 0
    for i, a in enumerate(template, 1):
        for j, b in enumerate(text, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (L.MATCH if a == b else L.MISS), h[i - 1, j] + L.GAP, h[i, j - 1] + L.GAP)
            best = max(best, h[i, j])
    return best


def test_wide_band_equals_full_alignment():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(1, 5, rng.integers(3, 15)), rng.integers(0, 5, rng.integers(1, 25))
        assert L.align(a, b, -len(a), len(b))[0] == full(a, b)


def test_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.license, r.start, r.stop) for r in L.scan(docs).collect()}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        for name, t in L.TEMPLATES:
            for m in re.finditer(r"[\W_]+".join(map(re.escape, L.tokens(t))), r.text, re.I):
                want.add((r.doc_id, name, m.start(), m.end()))
    assert want <= got and all(c >= 0.8 for c in [x.coverage for x in L.scan(docs).collect()])
    assert {d for d, *_ in got} == {d for d, *_ in want}


def test_odd_rows(spark, monkeypatch):
    notice = "Released under the MIT License."
    rows = [(1, None, 1), (2, "", 1), (None, notice, 1), (3, notice, 1), (3, notice, 1), (4, f"{notice} " * 300, 1), (5, "İ" * 50 + " " + notice, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = [(r.doc_id, r.start) for r in L.scan(df).collect()]
    assert sorted(x for x in got if x[0] in (3, 5)) == [(3, 0), (3, 0), (5, 51)]
    assert (None, 0) in got and sorted(s for d, s in got if d == 4) == [32 * i for i in range(300)]
    assert L.scan(df.limit(0)).count() == 0 and L.scan(df, ()).count() == 0
    # pieces: the same finds when a text is cut
    text = " ".join(words(200, random.Random(4)) + [notice] + words(200, random.Random(5)) + [notice])
    whole = L.find(INDEX, text)
    monkeypatch.setattr(L, "PIECE", 300)
    assert len(whole) == 2 and L.find(INDEX, text) == whole


def test_a_find_across_pieces_is_found_however_long(monkeypatch):
    """Anything may stand between the tokens of a notice, and a notice anywhere to the ends of pieces."""
    monkeypatch.setattr(L, "PIECE", 2_000)
    notice = L.TEMPLATES[4][1]  # the permission notice
    plain = " ".join(f"w{i}" for i in range(3_000))
    for gap, before in ((" ", 1_950), (" " * 600, 1_990), (" -- ", 1_000), ("." * 5_000, 0), (" ", 15_000)):
        text = plain[:before] + " " + gap.join(notice.split(" ")) + " " + plain
        (start, end, k, matched, coverage, _), = L.find(INDEX, text)
        assert L.TEMPLATES[k] == ("MIT", notice) and coverage == 1.0
        assert text[start:end].startswith("Permission") and end - start >= len(notice)
    assert L.find(INDEX, "-" * 50_000) == [] and L.find(INDEX, "x" * 50_000) == []
    many = " | ".join([notice] * 40)
    assert len(L.find(INDEX, many)) == 40


def test_the_notice_of_a_megabyte_boundary():
    notice = (" " * 800).join(L.TEMPLATES[4][1].split(" "))
    assert len(notice) > 16_000
    text = "y" * 9 + "-" * ((1 << 20) - 400) + " " + notice + " end" * 100
    assert [(f[0], f[1] - f[0], f[4]) for f in L.find(INDEX, text)] == [(text.index("Permission"), len(notice), 1.0)]

"""Operator 10: base spans against the plain patterns, added spans on small texts."""
import hashlib
import random
import re

import numpy as np

from armada.llm import personal_data as pii

#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in digits(m[0])]
        if 12 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


CASES = ["mail a.b+c%d@x-y.co.uk, also @x.y and a@b", "a@b@c.de x@y.z@q.r", "1.2.3.4.5 256.1.1.1 0001.2.3.4 1.2.3",
         "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (851) 555-9673, +44.20.7946.0958 +123", "9" * 7000, "." * 300, ""]


def test_base_spans():
    r = random.Random(1)
    for _ in range(30_000):
        CASES.append("".join(r.choice("0125.@a-+ () é") for _ in range(r.randint(0, 30))))
    for t in CASES:
        if len(t) < 4000:
            assert pii.base_spans(t) == plain(t)
    assert pii.base_spans("9" * 7000) == []


def test_long_texts_take_linear_time():
    for t in ("a" * 300_000 + " @", "1" * 300_000, "1 " * 150_000, "+" * 300_000, "a@" * 100_000, "1." * 100_000):
        pii.base_spans(t)


def corpus(n):
    r, rows = random.Random(2), []
    for i in range(n):
        w = [r.choice("alpha beta gamma delta eps zeta".split()) for _ in range(40)]
        phone = f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"
        value = (phone, f"{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}",
                 f"u{i}@mail{i % 9}.example.com", str(r.randrange(10**15, 10**16)), f"{r.randrange(100)}", f"v{r.randrange(9)}.0")[i % 6]
        for _ in range(1 + i % 3):
            w.insert(r.randrange(40), value)
        rows.append((i, " ".join(w)))
    return rows


def test_consistency_spreads_to_other_mentions(spark):
    rows = corpus(1500)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(df)
    # A mention that the pattern misses is found where its value is known from elsewhere, else not.
    text = "Call +1 (851) 555-9673 now. Later he wrote 1 (851) 555-9673 again, not 555-1234 nor 12."
    base = pii.base_spans(text)
    assert pii.joined(base) == "phone:5:22"
    assert [text[a:b] for _, _, b in model.added(text, base) for a in (b - 8,)] == ["555-9673"]
    alone = "He wrote 555-9673 again, not 555-1234 nor 12."
    assert pii.base_spans(alone) == [] and model.added(alone, []) == []
    # numbers that fail the check stay outside, as do plain numbers
    got = {r.doc_id: r for r in pii.find(df, model=model).collect()}
    for i, t in rows:
        assert got[i].base_sha256 == hashlib.sha256(pii.joined(plain(t)).encode()).hexdigest()
        assert got[i].spans == pii.joined(plain(t))


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "write to a@b.example", 1), (4, "a@b.example " * 2000, 1), (4, "a@b.example", 1), (4, "a@b.example", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    model = pii.train(df)
    got = pii.find(df, model=model).collect()
    assert sorted((r.doc_id or 0, r.n_email) for r in got) == [(0, 1), (1, 0), (2, 0), (4, 1), (4, 1), (4, 2000)]
    clean = pii.masked(df, model=model)
    assert clean.columns == df.columns
    assert {r.text for r in clean.collect()} == {None, "", "write to <EMAIL>", "<EMAIL> " * 2000, "<EMAIL>"}
    nothing = df.limit(0)
    assert pii.find(nothing).count() == 0 and pii.masked(nothing).count() == 0


def test_messages_equal_enumeration_on_a_tree():
    rng = np.random.default_rng(3)
    model = pii.Model(rng.normal(size=(pii.FEATURES, pii.LABELS)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    field = pii.Field("12 34 56", [])
    field.value[:] = -1
    p = model.marginals(field)
    unary = pii._norm(model.weights[field.features].sum(1))
    joint = np.exp(unary[0][:, None, None] + unary[1][None, :, None] + unary[2] + model.chain[:, :, None] + model.chain[None])
    joint /= joint.sum()
    assert np.allclose(p, [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))], atol=5e-3)


def test_overlapping_spans_are_masked_once():
    assert pii.mask("ab cd ef", [(0, 0, 4), (3, 1, 5), (6, 2, 8)]) == "<EMAIL> <CARD>"


def test_model_is_the_same_on_any_files(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE_DOCS", 300)
    df = spark.createDataFrame(corpus(1200), "doc_id long, text string")
    models = [pii.train(df.repartition(n)) for n in (1, 7, 50)]
    twice = pii.train(df.where("doc_id < 600").unionByName(df.where("doc_id >= 600")).coalesce(3))
    for m in (*models[1:], twice):
        for a, b in ((m.weights, models[0].weights), (m.chain, models[0].chain), (m.skip, models[0].skip)):
            assert np.array_equal(a, b)


def test_runs_inside_others():
    r = random.Random(4)
    for _ in range(300):
        runs = {(a, a + r.randint(1, 6)) for a in (r.randrange(12) for _ in range(r.randrange(12)))}
        assert pii._outer(runs) == {(a, b) for a, b in runs if not any((x, y) != (a, b) and x <= a and b <= y for x, y in runs)}


def test_many_mentions_of_one_number_are_told_by_one_rule():
    one = "call +1 (851) 555-9673 or 1 (851) 555-9673 "
    sizes = {len(pii.Field(one * n, pii.base_spans(one * n)).member) / n for n in (2, 150, 400)}
    assert len(sizes) == 1

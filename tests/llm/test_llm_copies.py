"""Operators 1, 2 and 4 against brute force."""
import itertools
import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from armada.llm import simhash, spaced_seeds, suffix_dedup


def words(n, r, size=5000):
    return [f"w{r.randrange(size)}" for _ in range(n)]


def test_golay_keys_meet_within_one_bit():
    code = simhash.Golay()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 5000)
    y = x ^ (1 << rng.integers(0, 23, 5000))
    for a, b in zip(code.keys(x), code.keys(y)):
        assert set(a[a >= 0]) & set(b[b >= 0])
    assert {int((k >= 0).sum()) for k in code.keys(x)} <= {1, 6}


def reference_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    r = random.Random(2)
    for t in (None, "", " \n", "One", "One TWO", "É é x A b c", "a " * 70_000, *(" ".join(words(n, r)) for n in (3, 4, 50, 400))):
        assert simhash.fingerprint(None if t is None else t.encode()) == reference_print(t)


def brute_components(values):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for a in values:
        for b in values:
            if bin(a ^ b).count("1") <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("small", [64, 2])
def test_links_lose_nothing(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    r = random.Random(3)
    values = {r.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for v in list(values):
        for _ in range(r.randrange(8)):
            for _ in range(r.choice([1, 2, 2, 3, 4])):
                v ^= 1 << r.randrange(64)
            values.add(v)
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = {r.v: r.root for r in simhash.components(simhash.links(df)).collect()}
    for v in values:
        got.setdefault(signed(v), signed(v))
    group = lambda m: {frozenset(k for k in m if m[k] == x) for x in set(m.values())}
    assert group(got) == group({signed(k): signed(v) for k, v in brute_components(values).items()})


def test_long_chain_is_one_component(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r.root for r in simhash.components(df).collect()} == {0}
    assert simhash.components(df.limit(0)).count() == 0


def test_near_duplicates_and_keep_one(spark):
    r = random.Random(4)
    base = words(300, r)
    rows = [(10, " ".join(base)), (3, " ".join(base).upper().replace("W", "w")), (None, " ".join(base)),
            (5, ""), (6, None), (7, " \t"), (20, "alone here now"), (20, "other text for the same id"),
            (30, "again and again"), (30, "again and again")]
    df = spark.createDataFrame([(*x, "e", 1) for x in rows], "doc_id long, text string, _n string, fp int")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert {(10, 3), (3, 3), (None, 3), (5, 5), (6, 5), (7, 5), (20, 20), (30, 30)} == got
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 20, 20, 30]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_overlaps_survive_substitutions(spark):
    r = random.Random(5)
    items = [(i, " ".join(words(n, r))) for i, n in enumerate((15, 20, 40, 59, 6, 8, 3))]
    rows, expected = [], set()
    for d in range(60):
        body, i = words(80, r, 10**6), d % 7
        if d < 42:
            item = items[i][1].split()
            for k in range(4, len(item), 9 if d >= 14 else 1000):
                if len(item) >= 15:
                    item[k] = f"sub{d}"
            body[30:30] = [w.upper() + "," for w in item]
            if i != 6:
                expected.add((d, i))
        rows.append((d, " ".join(body)))
    rows += [(100, None), (101, ""), (102, items[0][1]), (None, items[1][1])]
    expected |= {(102, 0), (None, 1)}
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, _leak int")
    test = spark.createDataFrame([*items, (99, None), (98, ""), items[0]], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in spaced_seeds.find_overlaps(docs, test).collect()}
    assert got == expected
    left = spaced_seeds.decontaminate(docs, test)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in expected}
    assert spaced_seeds.find_overlaps(docs.limit(0), test).count() == 0
    assert spaced_seeds.find_overlaps(docs, test.limit(0)).count() == 0


def test_test_side_in_blocks(spark, monkeypatch):
    r = random.Random(6)
    items = [(i, " ".join(words(20, r))) for i in range(30)]
    docs = spark.createDataFrame([(i, "some text before " + t + " and after") for i, t in items], "doc_id long, text string")
    test = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(spaced_seeds, "BLOCK_HASHES", 200)
    assert {(r.doc_id, r.item_id) for r in spaced_seeds.find_overlaps(docs, test).collect()} == {(i, i) for i, _ in items}


QUOTES = """
import random
from pyspark.sql import SparkSession
from armada.llm import spaced_seeds
from armada.session import ensure_checkpoint_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
ensure_checkpoint_dir(spark)
r = random.Random(14)
words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
items = [(i, words(60)) for i in range(150)]
rows = [(0, words(9)), (1, "\\n".join(words(60) + " " + t for _, t in items))]
found = spaced_seeds.find_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
got = sorted((x.doc_id, x.item_id, x.position, x.n_same, x.n_compared) for x in found.collect())
assert got == [(1, i, 60 + 120 * i, 60, 60) for i in range(150)], got[:3]
"""


def test_a_document_that_quotes_every_item_fits_a_small_heap():
    """18 000 tokens with 16 000 hits, which held 7 GB when each hit had all tokens."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_")} | {
        "PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_SUBMIT_ARGS": "--driver-memory 600m pyspark-shell"}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", QUOTES], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_blocks_are_not_held_at_once(spark, monkeypatch):
    r = random.Random(15)
    items = [(i, " ".join(words(20, r))) for i in range(30)] + [(i % 3, " ".join(words(8, r))) for i in range(6)]
    docs = spark.createDataFrame([(i, f"before {t} and {items[-i][1]}") for i, (_, t) in enumerate(items)], "doc_id long, text string")
    test = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, spaced_seeds.find_overlaps(docs, test).collect()))
    monkeypatch.setattr(spaced_seeds, "BLOCK_HASHES", 200)
    found = spaced_seeds.find_overlaps(docs, test)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == whole and len(whole) >= 36


def brute_removed(rows):
    first, out = set(), {}
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            s = b[p:p + 100]
            if s in first:
                gone[p:p + 100] = True
            first.add(s)
        out[d] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()),
                  bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def removed(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()}


def test_repeated_strings(spark):
    r = random.Random(7)
    base, rows = "".join(r.choice("ab ") for _ in range(3000)), [(None, None), (998, ""), (999, "x" * 150_000)]
    for i in range(250):
        a, k = r.randint(0, 2500), r.random()
        noise = "".join(r.choice("ab ") for _ in range(r.randint(0, 200)))
        rows.append((i, "x" * r.randint(0, 400) if k < .3 else noise + base[a:a + r.randint(50, 500)] + noise[::-1] if k < .6
                     else "ab" * r.randint(0, 300) + base[:r.randint(0, 300)] if k < .8 else "é漢" * r.randint(0, 200) + base[100:230]))
    df = spark.createDataFrame([(*x, 0, "q") for x in rows], "doc_id long, text string, v int, doc string").repartition(5)
    assert removed(df) == brute_removed(rows)


def test_hot_window_crosses_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_RECORDS", 50)
    r = random.Random(8)
    hot = "".join(r.choice("abcdefgh ") for _ in range(260))
    rows = [(i, "".join(r.choice("xyz ") for _ in range(r.randint(60, 160))) + hot[r.randrange(40):] + f" end {i}") for i in range(150)]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == brute_removed(rows)


def test_equal_rows_and_shared_ids(spark):
    r = random.Random(9)
    a, b = ("".join(r.choice("abcdef ") for _ in range(300)) for _ in range(2))
    df = spark.createDataFrame([(1, a), (1, a), (2, a + b), (2, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    first_long = df.where("doc_id = 2").orderBy(F.xxhash64("text")).first().text == a + b
    assert got == sorted([(1, 300, 0), (1, 300, 0), *([(2, 600, 300), (2, 300, 300)] if first_long else [(2, 600, 600), (2, 300, 0)])])
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(10)
    tokens = [rng.integers(0, 3, 20_000).astype(np.uint64), rng.integers(0, 50, 20_000), rng.integers(0, 1 << 40, 20_000)]
    order = suffix_dedup.multikey_quicksort(tokens)
    assert (order == np.lexsort(tokens[::-1])).all() or all((t[order] == t[np.lexsort(tokens[::-1])]).all() for t in tokens)


def test_overlaps_of_parts(spark):
    r = random.Random(11)
    item, short = words(100, r), words(20, r)
    body = lambda n: words(n, r, 10**6)
    rows = [(0, [*body(40), *item[25:75], *body(40)]), (1, [*item[:50], "inserted", *item[50:]]), (2, [*item[:50], *item[51:]]),
            (3, [*body(9), *short[:10], "inserted", *short[10:], *body(9)]), (4, [*body(9), *short[:10], *short[11:], *body(9)]),
            (5, [*body(30), *item[40:52], *body(30)]), (6, [*body(30), *item[40:49], *body(30)]), (7, [*body(30), *item[:50:2], *body(30)])]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string")
    test = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(short))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in spaced_seeds.find_overlaps(docs, test).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 0)}
    assert got[0, 0].position == 15 and got[0, 0].n_same == 50 == got[0, 0].n_compared
    assert all(x.same >= 0.8 for x in got.values())
    assert {x.doc_id for x in spaced_seeds.decontaminate(docs, test).collect()} == {6, 7}


def test_no_allowed_substitution_is_lost(spark):
    r = random.Random(12)
    items = [words(n, r) for n in range(5, 31) for _ in range(3)]
    rows, expected = [], set()
    for i, item in enumerate(items):
        for k in range(12):
            copy = list(item)
            for j in r.sample(range(len(item)), len(item) // 5):
                copy[j] = f"sub{k}"
            d = len(rows)
            rows.append((d, [*words(20, r), *copy, *words(20, r)]))
            expected.add((d, i))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string")
    test = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in spaced_seeds.find_overlaps(docs, test).collect()}

    def agree(t, v):
        for p in range(1 - len(v), len(t)):
            pairs = [t[p + k] == v[k] for k in range(len(v)) if 0 <= p + k < len(t)]
            if len(pairs) >= min(12, len(v)) and sum(pairs) >= 0.8 * len(pairs):
                return True
        return False
    assert expected <= got and expected <= {(d, i) for d, i in got if agree(rows[d][1], items[i])}
    assert {(d, i) for d, t in rows[::6] for i, v in enumerate(items) if agree(t, v)} <= got
    text = "今日は天気がとても良いので公園へ散歩に行きました"
    han = spark.createDataFrame([(0, "前文。" + text + "。後文"), (1, "別の文章です。関係はありません")], "doc_id long, text string")
    one = spark.createDataFrame([(0, text)], "item_id long, text string")
    assert [(x.doc_id, x.item_id) for x in spaced_seeds.find_overlaps(han, one).collect()] == [(0, 0)]


def test_masks_lose_no_pattern():
    for n in range(5, 22):
        places = [{s + i for i, c in enumerate(m) if c == "1"} for m in spaced_seeds.masks_of(n) for s in range(n - len(m) + 1)]
        for changed in itertools.combinations(range(n), n // 5):
            assert any(p.isdisjoint(changed) for p in places), (n, changed)


def test_overlaps_equal_their_sql(spark, tmp_path):
    """Parts, gaps and substitutions in items of 5 to 40 tokens, a script without spaces, a very long text."""
    import duckdb

    from armada.llm.oracle import DECONTAMINATION
    r = random.Random(13)
    items = [words(n, r, 400) for n in (5, 6, 8, 9, 10, 11, 12, 15, 18, 22, 24, 25, 30, 40) for _ in range(3)]
    rows = [(None, "naïve café"), (-1, None), (-2, "")]
    for d in range(500):
        part = list(r.choice(items))
        if r.random() < .4:
            a = r.randrange(len(part))
            part = part[a:a + r.randint(8, 40)] or part
        for _ in range(r.randrange(6)):
            j, k = r.randrange(len(part)), r.random()
            part[j:j + 1] = [] if k < .2 else [part[j], "more"] if k < .4 else [f"sub{j}"]
            part = part or ["x"]
        rows.append((d, " ".join([*words(r.randrange(15), r, 400), *part, *words(r.randrange(15), r, 400)])))
    rows += [(1000, "天地玄黃宇宙洪荒日月盈昃 end"), (1001, "naïve " * 60_000 + " ".join(items[20])), rows[7], rows[8]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    test = spark.createDataFrame([*((i, " ".join(t)) for i, t in enumerate(items)), (99, "天地玄黃宇宙洪荒"), (100, None)],
                                 "item_id long, text string")
    want = duckdb.connect()
    want.register("documents", docs.toArrow())
    want.register("benchmark", test.toArrow())
    key = lambda x: tuple((v is None, v) for v in x)
    columns = "doc_id, item_id, position, n_same, n_compared, same"
    expected = sorted(want.execute(f"SELECT {columns} FROM ({DECONTAMINATION})").fetchall(), key=key)
    got = sorted(map(tuple, spaced_seeds.find_overlaps(docs, test).select(*columns.split(", ")).collect()), key=key)
    assert len(got) > 200 and got == expected

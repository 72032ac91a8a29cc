"""Operators 12 and 13 against plain numpy and plain Python."""
import hashlib
import math

import numpy as np
import pytest

from armada.llm import neighbours, vector_codes
from armada.llm.queries import table

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Lloyd with Python integers, every assignment a full scan."""
    kept = [(i, [math.floor(1024 * float(c)) for c in v], label) for i, v, label in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if kept:
        kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    dims = len(kept[0][1]) if kept else 0
    sizes = [dims // parts + (p < dims % parts) for p in range(parts)]
    cuts = [(sum(sizes[:p]), sum(sizes[:p + 1])) for p in range(parts)]
    books = [[x[a:b] for _, x, _ in kept[:entries]] for a, b in cuts]

    def near(p, x):
        a, b = cuts[p]
        return min((sum((u - w) ** 2 for u, w in zip(x[a:b], e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        got = [[near(p, x)[1] for p in range(parts)] for _, x, _ in kept]
        for p, (a, b) in enumerate(cuts):
            for k in set(g[p] for g in got):
                own = [x[a:b] for (_, x, _), g in zip(kept, got) if g[p] == k]
                books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out = [(i, "".join(f"{near(p, x)[1]:02x}" for p in range(parts)), sum(near(p, x)[0] for p in range(parts)), label)
           for i, x, label in kept]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, c, min(e, 2**63 - 1), min(2**63 - 1, sum(o[2] for o in out if o[3] == label)), digest) for i, c, e, label in out), key=repr)


def coded(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    return sorted((tuple(r) for r in vector_codes.report(df).collect()), key=repr)


def test_codes_equal_plain_lloyd_on_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = np.float32(rng.standard_normal((420, 8)) * 0.3)
    x[300:] = x[7]                       # a large group of copies
    rows = [(i, v.tolist(), [None, 0, 1][i % 3]) for i, v in enumerate(x)]
    rows += [(5, rows[5][1], 9), (5, rows[6][1], 9), (None, rows[8][1], None), (1000, None, 1), (1001, [0.5] * 7 + [None], 1),
             (1002, [float("nan")] + [0.0] * 7, 1), (1003, [float("inf")] + [0.0] * 7, 1), (1004, [0.0] * 8, 1), (1005, [1.0] * 4, 1)]
    assert coded(spark, rows) == plain_codes(rows)


@pytest.mark.parametrize("rows", [
    [], [(1, None, 1)], [(3, [0.25, -0.5], 1), (2, [0.1, 0.2], None)], [(1, [], 1), (2, [], 1)],
    [(i, [1e6 * (i - 3), -2.5e9, 0.1, 1e-9], 1) for i in range(7)] + [(9, [1e30, 0.0, 0.0, 0.0], 1)]])
def test_codes_of_few_and_large_vectors(spark, rows):
    usable = [r for r in rows if r[1] is None or all(abs(c) < 2**52 for c in r[1])]
    rows32 = [(i, None if v is None else np.float32(v).tolist(), label) for i, v, label in usable]
    assert coded(spark, rows) == plain_codes(rows32, entries=256)


def test_active_entries_give_the_full_scan():
    rng = np.random.default_rng(2)
    x = rng.integers(-4, 4, (3000, 3))   # many ties
    book = x[:40].copy()
    code, dist = vector_codes.assign(x, book)
    for _ in range(6):
        after = book.copy()
        at = rng.choice(40, 5, replace=False)
        after[at] += rng.integers(-1, 2, (5, 3))
        moved = (after != book).any(1)
        book = after
        code, dist = vector_codes.assign(x, book, moved, code, dist)
        full = vector_codes.assign(x, book)
        assert (code == full[0]).all() and (dist == full[1]).all()


def test_only_moved_entries_are_compared(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(-99, 99, (500, 4))
    book = x[:50].copy()
    code, dist = vector_codes.assign(x, book)
    seen, plain = [], vector_codes.distances
    monkeypatch.setattr(vector_codes, "distances", lambda a, b: (seen.append((len(a), len(b))), plain(a, b))[1])
    moved = np.zeros(50, bool)
    moved[3] = True
    vector_codes.assign(x, book, moved, code, dist)
    own = int((code == 3).sum())
    assert sorted(seen) == sorted([(500 - own, 1), (own, 50)])


def test_codes_keep_to_their_columns(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25], 3, "x", 7)], "vec_id long, embedding array<float>, label int, code string, n int")
    out = vector_codes.report(df)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert [tuple(r)[:4] for r in out.collect()] == [(1, "00000000", 0, 0)]


# --- operator 12 ---------------------------------------------------------------------------

def dot(v, w):
    """Double precision, from left to right (the built-in sum compensates)."""
    total = 0.0
    for a, b in zip(v, w):
        total += a * b
    return total


def brute(rows, k=20, every=20):
    """{(query id, vector)}: the exact list of every query."""
    kept = {(i, tuple(v)) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    out = {}
    for i, v in kept:
        if i is None or i % every:
            continue
        near = sorted(((-dot(v, w), j is None, j or 0) for j, w in kept if (j, w) != (i, v) and len(w) == len(v)))
        out.setdefault(i, []).append([(None if none else j, -s) for s, none, j in near[:k]])
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {}
    for r in sorted(neighbours.nearest(df, **how).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def vectors(n, dims=16, seed=0):
    x = np.float32(np.random.default_rng(seed).standard_normal((n, dims)))
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_small_tables_are_searched_whole(spark):
    rows = vectors(60) + [(200, None), (220, [0.0] * 16), (240, [float("nan")] * 16), (260, [1.0] * 15 + [None]), (280, []), (300, [1.0, 2.0])]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (320, rows[0][1]), (340, rows[0][1])]  # a repeated row, a NULL id, copies
    got, want = found(spark, rows), brute([r for r in rows if r[1] is None or len(r[1]) != 2])
    assert set(got) == set(want)
    for q, near in got.items():
        assert near == [(n + 1, i, s) for n, (i, s) in enumerate(want[q][0])]
    assert all(len(v) == 20 for v in got.values())


def test_few_or_no_candidates(spark):
    assert found(spark, []) == {} and found(spark, [(0, None)]) == {} and found(spark, vectors(1)) == {}
    rows = vectors(5)
    assert found(spark, rows) == {0: [(n + 1, i, s) for n, (i, s) in enumerate(brute(rows)[0][0])]}


def test_a_third_of_the_rows_is_one_vector(spark):
    rows = vectors(600)
    rows = [(i, rows[1][1] if i % 3 == 0 else v) for i, v in rows]
    got, want = found(spark, rows, sample=300, leaf=16, tile=50), brute(rows)
    assert set(got) == set(want)
    hot = [q for q in got if q % 3 == 0]
    assert all([(i, s) for _, i, s in got[q]] == want[q][0] for q in hot)  # their nearest are their copies, smallest ids first


def test_recall_of_clustered_and_of_shapeless_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 32))
    clustered = centres[rng.integers(0, 30, 3000)] + 0.2 * rng.standard_normal((3000, 32))
    lengths = rng.uniform(0.5, 2, 3000)[:, None]
    for x in (clustered * lengths, rng.standard_normal((3000, 32))):
        rows = [(i, np.float32(v).tolist()) for i, v in enumerate(x)]
        got, want = found(spark, rows, sample=1000, leaf=32, tile=200), brute(rows)
        hits = [len({i for _, i, _ in got[q]} & {i for i, _ in want[q][0]}) / 20 for q in want]
        assert set(got) == set(want) and np.mean(hits) >= 0.9
        scores = {(q, i): s for q, lists in want.items() for i, s in lists[0]}
        assert all(scores.get((q, i), s) == s for q, near in got.items() for _, i, s in near)


def test_no_sample_point_is_lost_under_the_bound():
    """The search opens exactly the leaves that it says, and placing agrees with growing."""
    x = np.random.default_rng(6).standard_normal((900, 12))
    forest = neighbours.Forest(x, 3, 20, 1)
    assert forest.sizes.sum() == 3 * 900 and forest.sizes.max() <= 20
    m = forest.margins(x[:1])[0]
    order = forest.search(m, math.inf)
    assert sorted(order) == list(range(forest.leaves))
    assert set(forest.search(m, 60)) <= set(order[:20])


def test_recall_of_the_registered_query(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    want, got = brute(rows), found(spark, rows)
    assert np.mean([len({i for _, i, _ in got[q]} & {i for i, _ in want[q][0]}) / 20 for q in want]) >= 0.9

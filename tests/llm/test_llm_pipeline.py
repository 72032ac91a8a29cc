"""The registered queries and the pipeline on the given small tables."""
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from armada.llm import pieces
from armada.llm.queries import PIECE_BPE, QUERIES, SQL, vocabulary

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in QUERIES}
    assert set(QUERIES) <= set(names) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(SQL[name]).to_arrow_table().to_pylist()
    assert set(got.columns) == set(want[0])
    key = lambda r: repr(sorted(r.items()))
    assert sorted((r.asDict() for r in got.collect()), key=key) == sorted(want, key=key)


def sentence(r):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(60)) + "."


def test_pipeline_takes_effect(spark, scratch):
    r = random.Random(1)
    clean = [sentence(r) + "\n" + sentence(r) for _ in range(40)]
    item = " ".join(f"b{r.randrange(10**6)}" for _ in range(20))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(100, "too short.", "en", "s", 10), (101, clean[0], "en", "s", 9), (102, sentence(r) + f"\n{item} {sentence(r)}", "en", "s", 9),
             (103, sentence(r) + " mail a.b@c.example now.", None, None, None), (104, None, "en", "s", 0),
             (105, "Home | News | Sport | Contact | About | Help\n" * 30, "en", "s", 1), (1, clean[1], "en", "s", len(clean[1]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(
        f"{scratch}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    docs = spark.read.parquet(f"{scratch}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, scratch)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{scratch}/{k}")
        docs = spark.read.parquet(f"{scratch}/{k}")
    assert sorted(x.doc_id for x in docs.collect()) == [*range(40), 103]
    text = {x.doc_id: x.text for x in pieces.decode_pieces(docs, vocabulary(PIECE_BPE)).collect()}
    assert text[5] == clean[5] and "<EMAIL>" in text[103] and "a.b@c" not in text[103]
    again = corpus_pipeline.run(spark, scratch)
    assert sorted((x.doc_id, x.ids) for x in again.collect()) == sorted((x.doc_id, x.ids) for x in docs.collect())

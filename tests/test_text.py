"""Golden strings and edge rows for prompt building and answer parsing."""

from pyspark.sql import functions as F

from armada import config as C
from armada.functions.text import (
    answer_letter, instruct_prompt, mc_prompt, mc_prompt_from_pairs, parse_answer, parse_list_literal,
    python_list_literal, short_model_name, strip_echo, strip_unicode, task_words,
)


def one(spark, expr, schema, *vals):
    return spark.createDataFrame([vals], schema).select(expr.alias("r")).collect()[0]["r"]


def test_parse_answer_edge_rows(spark):
    cases = {
        "A possible answer is B": "A",
        "éA": None, "A_B": None, "D3": None, "b": None, "": None,
        "ÀB C": "C", "(B)": "B", "B.": "B", "**D**": "D", "The answer is C.": "C",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["p"] for r in df.select("t", parse_answer("t").alias("p")).collect()}
    assert got == cases


def test_strip_unicode(spark):
    assert one(spark, strip_unicode("s"), "s string", "\t a  　") == "a"
    assert one(spark, strip_unicode("s"), "s string", "a\nb \n") == "a\nb"


def test_mc_prompt_list_choices(spark):
    got = one(spark, mc_prompt("q", "c"), "q string, c array<string>", "Why?", [" x ", "y\t"])
    want = ("Answer the following multiple-choice question with only the answer letter (A, B, C, or D):\n"
            "Question: Why?\nOptions:\nA. x\nB. y\nAnswer:")
    assert got == want


def test_mc_prompt_unlimited_letters(spark):
    got = one(spark, mc_prompt("q", "c"), "q string, c array<string>", "Q", [str(i) for i in range(6)])
    assert "F. 5\n" in got


def test_mc_prompt_placeholder(spark):
    got = one(spark, mc_prompt("q", "c"), "q string, c array<string>", "Q", None)
    assert got.endswith("Options:\nA. Choice 1\nB. Choice 2\nC. Choice 3\nD. Choice 4\nAnswer:")


def test_mc_prompt_pairs(spark):
    got = one(spark, mc_prompt_from_pairs("q", "c"), "q string, c array<struct<key:string,value:string>>",
              "Q", [("X", " one "), ("Y", "two")])
    assert got.endswith("Options:\nX. one\nY. two\nAnswer:")


def test_instruct_prompt_and_rejection(spark):
    got = one(spark, instruct_prompt("t", "q", "c"), "t string, q string, c array<string>",
              "high_school_physics", "Q?", [" a", "b "])
    assert got == ("Instruct: Given a multiple-choice question on high school physics, select the most correct "
                   "answer from the choices.\nQuery: Q?\nChoices:\nA).  a\nB). b \n")
    assert one(spark, instruct_prompt("t", "q", "c"), "t string, q string, c array<string>",
               "x", "Q", list("abcde")) is None


def test_list_literal_round_trip(spark):
    vals = ["a", "b's", 'say "hi"', "back\\slash", "two\nlines"]
    got = one(spark, parse_list_literal(python_list_literal("c")), "c array<string>", vals)
    assert got == vals
    assert one(spark, parse_list_literal("s"), "s string", "['a', \"b's\"]") == ["a", "b's"]
    assert one(spark, parse_list_literal("s"), "s string", "[1, 2]") == ["1", "2"]
    assert one(spark, parse_list_literal("s"), "s string", "('a','b')") is None


def test_small_helpers(spark):
    assert one(spark, answer_letter("a"), "a int", 3) == "D"
    assert one(spark, answer_letter("a"), "a int", 26) is None
    assert one(spark, short_model_name("m"), "m string", "google/gemma-2-2b-it") == "gemma-2-2b-it"
    assert one(spark, task_words("t"), "t string", "a_b_c") == "a b c"
    assert one(spark, strip_echo("g", "p"), "g string, p string", "PROMPT then B", "PROMPT") == " then B"


def test_literal_fallback_and_strict(spark):
    import pytest
    from armada.functions.text import literal_list_exact
    df = spark.createDataFrame([("('a', 'b')",), ("['a', None]",), ("['\\x41']",), ("not a list",), (None,)], "s string")
    got = [r["r"] for r in df.select(literal_list_exact("s").alias("r")).collect()]
    assert got == [["a", "b"], ["a", None], ["A"], None, None]
    with pytest.raises(Exception, match="more than four"):
        spark.createDataFrame([("t", "q", list("abcde"))], "t string, q string, c array<string>").select(
            instruct_prompt("t", "q", "c", strict=True)).collect()


def test_last_token_of_a_padded_batch(spark):
    import numpy as np
    import pytest
    from armada.operators import inference
    mask = np.array([[0, 1, 1], [1, 1, 0], [0, 0, 0], [1, 1, 1]])
    assert inference.last_real(mask).tolist() == [2, 1, -1, 2]
    with pytest.raises(ValueError, match="contiguous"):
        inference.last_real(np.array([[1, 0, 1]]))
    rows = [(0, "a b c"), (1, None), (2, ""), (3, "a " * 500), (4, "z")]
    df = spark.createDataFrame(rows, "i int, prompt string")
    for left in (True, False):
        factory = inference.offline_token_embedder_factory(left, max_tokens=100)
        got = {r["i"]: r["embedding"] for r in inference.embed_last_token(df, factory, keep=["i"], batch_rows=2).collect()}
        assert got[1] is None and got[2] is None and [got[i][1] for i in (0, 3, 4)] == [3, 100, 1]
    wrong = lambda: lambda texts: (np.zeros((1, 1, 1)), np.zeros((2, 1)))
    with pytest.raises(Exception, match="hidden states"):
        inference.embed_last_token(df, wrong, keep=["i"]).collect()


def test_embedder_batches_are_bounded_by_bytes_or_rows(spark):
    import numpy as np
    from armada.operators import inference
    rows = [(i, "ab c " * n) for i, n in enumerate([600_000, 600_000, 1, 2, 1_000_000, 0])] + [(6, None), (None, "x")]
    df = spark.createDataFrame(rows, "i int, prompt string").coalesce(1)
    # every row's vector: texts and bytes of the batch it came in
    sizes = lambda: lambda texts: np.array([[len(texts), sum(len(t or "") for t in texts), np.nan]] * len(texts))
    got = {r["i"]: r["embedding"] for r in inference.embed_text(df, sizes, keep=["i"], dtype="double").collect()}
    assert len(got) == 8 and all(v[0] == 1 or v[1] <= 4 << 20 for v in got.values()) and got[4][0] == 1 and got[2] == got[3]
    assert all(v[2] is None for v in got.values())
    got = [r["embedding"][0] for r in inference.embed_text(df, sizes, keep=["i", "prompt"], batch_rows=3).collect()]
    assert got == [3, 3, 3, 3, 3, 3, 2, 2]

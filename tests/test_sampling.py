"""Exact sizes, determinism and hot groups for ordinals, samples and splits."""

import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from armada.operators.ordinal import block_of, group_cutoffs, with_group_ordinal, with_running_sums
from armada.operators.sampling import fraction_sample, four_way_cut, stratified_split


def test_four_way_cut_sizes(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 3), ("b", 10)) for i in range(n)], "g string, i long")
    sizes = {(r["g"], r["part"]): r["n"] for r in four_way_cut(df, "g", "i").groupBy("g", "part").agg(
        F.count("*").alias("n")).collect()}
    assert sizes == {("a", 4): 3, ("b", 1): 2, ("b", 2): 2, ("b", 3): 2, ("b", 4): 4}


def test_four_way_cut_of_any_order_type(spark):
    base = spark.range(37).select((F.col("id") % 2).alias("g"), F.col("id").alias("i"))
    for expr in ("i", "-i * i * i", "cast(i as string)", "timestamp_micros(i * 1000003)", "cast(i as double) / 7",
                 "date_add(date '2000-01-01', cast(i * i as int))", "if(i < 5, null, i * 1000000000000)"):
        df = base.withColumn("k", F.expr(expr))
        got = {r["i"]: r["part"] for r in four_way_cut(df, "g", ["k", "i"]).collect()}
        w = Window.partitionBy("g").orderBy("k", "i")
        for r in df.select("i", F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy("g")).alias("n")).collect():
            assert got[r["i"]] == min((r["rn"] - 1) // (r["n"] // 4) + 1, 4), expr


def test_fraction_sample_half_even(spark):
    df = spark.createDataFrame([("g", i) for i in range(5)], "g string, i long")
    assert fraction_sample(df, 0.5, "g", "i").count() == 2          # round_half_even(2.5) = 2
    df7 = spark.createDataFrame([("g", i) for i in range(7)], "g string, i long")
    assert fraction_sample(df7, 0.5, "g", "i").count() == 4         # 3.5 -> 4
    assert fraction_sample(df, 1.0, "g", "i").count() == 5


def test_stratified_split_disjoint_complete(spark):
    rows = [(f"s{i % 7}", i) for i in range(1003)]
    df = spark.createDataFrame(rows, "s string, k long")
    out = stratified_split(df, "s", "k", 0.75, 1010)
    res = out.collect()
    assert len(res) == 1003 and len({r["k"] for r in res}) == 1003
    assert sum(r["split"] == "train" for r in res) == int(0.75 * 1003)
    again = {r["k"]: r["split"] for r in stratified_split(df, "s", "k", 0.75, 1010).collect()}
    assert again == {r["k"]: r["split"] for r in res}


def test_ordinal_hot_group_matches_row_number(spark):
    # one key holds well over a third of the rows
    rnd = random.Random(3)
    rows = [(0 if rnd.random() < 0.5 else rnd.randint(1, 40), i, rnd.random()) for i in range(4000)]
    df = spark.createDataFrame(rows, "g long, i long, v double")
    got = with_running_sums(df, ["g"], ["v", "i"], {"cum": F.col("v")}, ordinal="o", count_name="n")
    w = Window.partitionBy("g").orderBy("v", "i")
    ref = df.select("i", F.row_number().over(w).alias("ro"),
                    F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rc"),
                    F.count("*").over(Window.partitionBy("g")).alias("rn"))
    j = got.join(ref, "i")
    assert j.count() == 4000
    assert j.where((F.col("o") != F.col("ro")) | (F.col("n") != F.col("rn"))
                   | (F.abs(F.col("cum") - F.col("rc")) > 1e-9)).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 10 ** 6)), min_size=1, max_size=60, unique_by=lambda t: t[1]))
def test_ordinal_property(spark, rows):
    df = spark.createDataFrame(rows, "g int, k long")
    got = sorted((r["g"], r["k"], r["o"]) for r in with_group_ordinal(df, "g", "k", "o").collect())
    want = []
    for g in sorted({g for g, _ in rows}):
        ks = sorted(k for gg, k in rows if gg == g)
        want += [(g, k, i + 1) for i, k in enumerate(ks)]
    assert got == sorted(want)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.sampled_from([0.1, 0.25, 0.5, 0.75]))
def test_fraction_sample_sizes_property(spark, groups, frac):
    rows = [(g, i) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, "g int, i long")
    got = {}
    for r in fraction_sample(df, frac, "g", "i").collect():
        got[r["g"]] = got.get(r["g"], 0) + 1
    for g in set(groups):
        want = round(frac * groups.count(g))          # Python rounds half to even
        assert got.get(g, 0) == want


def test_ordinal_many_partitions(spark):
    import armada.operators.ordinal as O
    rows = [(i % 3, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, k long").repartition(16)
    got = {(r["g"], r["k"]): r["o"] for r in O.with_group_ordinal(df, "g", "k", "o").collect()}
    for g in range(3):
        ks = sorted(k for gg, k in rows if gg == g)
        assert [got[(g, k)] for k in ks] == list(range(1, len(ks) + 1))


def test_ordinal_double_keys_extremes(spark):
    vals = [1e-300, -2.5e-12, 3.0, float("inf"), -float("inf"), 7.25e+200, 0.0, -0.5, 1e-05, 123456.789]
    rows = [(i % 2, v, i) for i, v in enumerate(vals * 20)]
    df = spark.createDataFrame(rows, "g int, v double, i long")
    got = {(r["g"], r["i"]): r["o"] for r in with_group_ordinal(df, "g", ["v", "i"], "o", num_blocks=16).collect()}
    for g in (0, 1):
        mine = sorted((v, i) for gg, v, i in rows if gg == g)
        assert [got[(g, i)] for _, i in mine] == list(range(1, len(mine) + 1))


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "g string, k long")
    assert fraction_sample(empty, 0.5, "g", "k").count() == 0
    assert four_way_cut(empty, "g", "k").count() == 0
    assert stratified_split(empty, "g", "k").count() == 0
    assert with_group_ordinal(empty, "g", "k", "o").count() == 0
    one = spark.createDataFrame([("a", 1)], "g string, k long")
    assert [r["part"] for r in four_way_cut(one, "g", "k").collect()] == [4]
    assert [r["split"] for r in stratified_split(one, "g", "k").collect()] == ["validation"]  # floor(0.75) = 0


def test_null_group_is_a_group(spark):
    rows = [(None if i % 3 == 0 else "a", i) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, k long")
    o = with_group_ordinal(df, "g", "k", "o").collect()
    assert len(o) == 30
    assert sorted(r["o"] for r in o if r["g"] is None) == list(range(1, 11))
    assert fraction_sample(df, 0.5, "g", "k").where("g IS NULL").count() == 5
    assert four_way_cut(df, "g", "k").count() == 30
    assert stratified_split(df, "g", "k").count() == 30


CURVES = {"outlier": "if(i = 0, 1e300D, cast(i as double) / 7)", "steep": "pow(2D, cast(i % 1000 as double))", "prefix": "concat('doc_', lpad(cast(i as string), 9, '0'))",
          "decimal": "cast(i as decimal(30, 10)) / 3", "flag": "i % 3 = 0", "ties": "cast(i % 2 as double)"}


def test_buckets_are_even_for_every_type_and_curve(spark):
    base = spark.range(20_000).select((F.col("id") % 10 < 7).alias("hot"), F.col("id").alias("i"))
    for name, expr in CURVES.items():
        df = base.withColumn("k", F.expr(expr))
        sizes = sorted(r["n"] for r in df.groupBy(block_of(df, ["hot", "k", "i"], 16).alias("b")).agg(F.count("*").alias("n")).collect())
        if name != "decimal":  # its ties cannot be told apart by the id
            assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[len(sizes) // 2], name


def test_cutoffs_are_refined_until_a_bucket_is_small(spark):
    base = spark.range(3000).select((F.col("id") % 10 < 7).alias("hot"), F.col("id").alias("i"))
    for name, expr in CURVES.items():
        df = base.withColumn("k", F.expr(expr))
        targets = spark.createDataFrame([(h, c, r) for h in (True, False) for c, r in ((1, 1), (2, 450), (3, 900))], "hot boolean, cut int, rank long")
        got = {(r["hot"], r["cut"]): r["_c1"] for r in group_cutoffs(df, "hot", ["k", "i"], targets, small=4).collect()}
        w = Window.partitionBy("hot").orderBy("k", "i")
        want = {(r["hot"], r["rn"]): r["i"] for r in df.withColumn("rn", F.row_number().over(w)).where("rn in (1, 450, 900)").collect()}
        assert got == {(h, {1: 1, 450: 2, 900: 3}[n]): i for (h, n), i in want.items()}, name


def test_equal_rows_stop_the_refinement(spark):
    df = spark.range(100).select(F.lit(1).alias("g"), F.lit(2.0).alias("k"))
    targets = spark.createDataFrame([(1, 1, 40)], "g int, cut int, rank long")
    assert [(r["cut"], r["_c0"]) for r in group_cutoffs(df, "g", "k", targets, small=4).collect()] == [(1, 2.0)]

import random

import pytest

cube = pytest.importorskip("loomspark.llm.cube")
sampling = pytest.importorskip("loomspark.llm.sampling")
from pyspark.sql import functions as F


def units(spark, parts=7):
    rng = random.Random(1)
    rows = [(s, s * 10_000 + i, p, float(rng.randint(1, 50))) for s, n, p in ((1, 900, 0.3), (2, 1000, 0.05), (3, 40, 1.0), (4, 30, 0.5)) for i in range(n)]
    return spark.createDataFrame(rows, "s int, u bigint, p double, z double").select(F.col("s").cast("string").alias("s"), "u", "p", "z").repartition(parts)


@pytest.mark.parametrize("size", [None, "z"])
def test_counts_and_sizes_are_balanced(spark, size):
    df = units(spark)
    got = {r["stratum"]: r for r in cube.cube_sample(df, "s", "u", "p", size).groupBy("stratum").agg(F.count("*").alias("n"), F.sum("size").alias("z"), F.count_distinct("unit").alias("d")).collect()}
    want = {r["s"]: r for r in df.groupBy("s").agg(F.sum("p").alias("n"), F.sum(F.col("p") * F.col("z")).alias("z")).collect()}
    for s, w in want.items():
        assert got[s]["n"] == got[s]["d"] and abs(got[s]["n"] - w["n"]) < 1 + 1e-6
        if size:
            assert abs(got[s]["z"] - w["z"]) <= 150  # the landing leaves at most two units open


def test_probabilities_are_kept(spark):
    rows = [(f"r{k}", i) for k in range(400) for i in range(5)]
    df = spark.createDataFrame(rows, "s string, u int").withColumn("u", F.col("u") + 100 * F.substring("s", 2, 9).cast("int")).withColumn("p", F.lit(0.3))
    got = cube.cube_sample(df, "s", "u", "p").groupBy(F.col("unit") % 100).count().collect()
    assert len(got) == 5 and all(80 <= r["count"] <= 160 for r in got)  # 120 expected of 400


def test_same_draw_again(spark):
    df = units(spark, 3).cache()
    one = {tuple(r) for r in cube.cube_sample(df, "s", "u", "p", "z").collect()}
    assert one == {tuple(r) for r in cube.cube_sample(df, "s", "u", "p", "z").collect()}


def test_odd_units(spark):
    df = spark.createDataFrame([(None, 1, 1.0), ("a", None, 1.0), ("a", 2, None), ("a", 3, 7.0), ("a", 4, -1.0), ("a", 5, 0.0)], "s string, u bigint, p double")
    assert [tuple(r)[:2] for r in cube.cube_sample(df, "s", "u", "p").collect()] == [("a", 3)]
    assert cube.cube_sample(df.limit(0), "s", "u", "p").count() == 0


def papers(spark, rows):
    return spark.createDataFrame(rows, "arti_id string, meth string, category string").withColumn("harvested_at", F.lit(None).cast("timestamp"))


def test_plan_short_categories_and_minimum(spark):
    p = papers(spark, [(f"a{i}", "A ", "x") for i in range(50)] + [(f"b{i}", "Ｂ", "x") for i in range(4)] + [("b0", "Ｂ", "x"), ("n", None, "x"), ("e", " ", "x"), (None, "A", "x")])
    t = spark.createDataFrame([(1, "meth", "A", 0.5, 0, 20), (1, "meth", "B", 0.2, 0, 20), (1, "meth", "C", 0.3, 0, 20), (2, "meth", "B", 0.1, 5, 20), (2, "meth", "A", 0.9, 0, 20), (3, "gone", "A", 1.0, 0, 5)], "plan_id int, field string, category string, target_share double, min_rows int, sample_rows int")
    sample, report = sampling.proportional_sample(p, t)
    r = {(x["plan_id"], x["category"]): x for x in report.collect()}
    assert {k for k, x in r.items() if x["short"]} == {(1, "C"), (2, "B"), (3, "A")}
    assert (r[1, "A"]["drawn"], r[1, "B"]["drawn"], r[2, "B"]["drawn"], r[2, "A"]["drawn"]) == (10, 4, 4, 18)
    assert sample.count() == sample.distinct().count() == 36
    assert sampling.proportional_sample(p.limit(0), t)[1].where("short").count() == 6
    assert sampling.proportional_sample(p, t.limit(0))[1].count() == 0


def test_mix_repeats_small_sources_up_to_the_cap(spark):
    docs = spark.createDataFrame([(i, "word " * (5 + i % 7), s) for i, s in enumerate(["big"] * 400 + ["small"] * 10)] + [(900, None, "big"), (901, "", None), (902, "x", "other")], "doc_id bigint, text string, source string")
    size = {r[0]: r[1] for r in docs.groupBy("source").agg(F.sum(sampling.token_counter()("text"))).collect()}
    budget = 1500
    t = spark.createDataFrame([(1, "big", 0.8, 2, budget), (1, "small", 0.1, 3, budget), (1, "none", 0.1, 3, budget), (2, "small", 0.9, 2, budget), (2, "big", 0.1, 0, budget), (3, "none", 0.0, 1, budget)], "mix_id int, source string, target_share double, max_uses int, budget_tokens bigint")
    uses, report = sampling.source_mix(docs, t)
    r = {(x["mix_id"], x["source"]): x for x in report.collect()}
    assert {k for k, x in r.items() if x["short"]} == {(m, s) for m, s, share, cap, b in map(tuple, t.collect()) if share * b > cap * size.get(s, 0)}
    assert abs(r[1, "big"]["residual"]) < 30 and abs(r[1, "small"]["residual"]) < 30
    assert r[2, "small"]["taken_tokens"] == 2 * size["small"]
    most = {(x["mix_id"], x["source"]): x["u"] for x in uses.groupBy("mix_id", "source").agg(F.max("uses").alias("u")).collect()}
    assert most[2, "small"] == 2 and most[1, "small"] <= 3 and most[1, "big"] == 1
    assert sampling.source_mix(docs.limit(0), t)[0].count() == 0


def test_fields_of_a_plan_are_apart(spark):
    p = spark.createDataFrame([(f"a{i}", "X", "X") for i in range(40)] + [(f"b{i}", "Y", "X") for i in range(20)], "arti_id string, meth string, reason string").withColumn("harvested_at", F.lit(None).cast("timestamp"))
    t = spark.createDataFrame([(1, "meth", "X", 0.5, 0, 20), (1, "reason", "X", 0.5, 0, 20), (1, None, "X", 0.1, 0, 20)], "plan_id int, field string, category string, target_share double, min_rows int, sample_rows int")
    sample, report = sampling.proportional_sample(p, t)
    assert {(x["field"], x["drawn"], x["available"]) for x in report.collect()} == {("meth", 10, 40), ("reason", 10, 60), (None, 0, 0)}
    assert {(r["field"], r["count"]) for r in sample.groupBy("field").count().collect()} == {("meth", 10), ("reason", 10)}


def test_large_plans_are_joined_alike(spark, monkeypatch):
    p = papers(spark, [(f"a{i}", "A", "x") for i in range(30)] + [(f"b{i}", "B", "x") for i in range(30)])
    t = spark.createDataFrame([(1, "meth", "A", 0.7, 0, 10), (1, "meth", "B", 0.3, 0, 10)], "plan_id int, field string, category string, target_share double, min_rows int, sample_rows int")
    monkeypatch.setattr(sampling, "MAX_TARGETS", 1)
    assert {(x["category"], x["drawn"]) for x in sampling.proportional_sample(p, t)[1].collect()} == {("A", 7), ("B", 3)}

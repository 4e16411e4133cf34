import math
import random
import time
import statistics

import pytest
from loomspark.functions import expr as X
from loomspark.functions import scope, text
from loomspark.operators import graph, merge, quality, ranking, sampling, stats
from pyspark.sql import functions as F


def one(df):
    return tuple(df.first())


def test_keyword_and_author_rules(spark):
    assert text.keyword_text("AI  Chat-Bot ") == "ai chat bot"
    assert text.keyword_text("a - b") == "a   b"
    assert text.author_key("홍길동(서울대학교 국어교육과)") == "홍길동|서울대학교"
    assert text.author_key("Kim") == "Kim|"
    df = spark.createDataFrame([("AI  Chat-Bot ", "홍길동(서울대학교 국어교육과); Kim;; 홍길동(서울대학교 국어교육과)")], "k string, a string")
    assert one(df.select(X.norm_keyword(F.col("k")), X.author_keys(F.col("a")))) == ("ai chat bot", ["홍길동|서울대학교", "Kim|"])


def test_folding(spark):
    df = spark.createDataFrame([("　ＡＩ\xa0",), (None,), (" ",), ("영어",)], "v string")
    assert [r[0] for r in df.select(text.folded("v")).collect()] == ["AI", None, "", "영어"]


def test_scalar_expressions(spark):
    df = spark.createDataFrame([("대학수학능력시험", "이름（소속）", "20240229", "a|b" * 30, 0.25)], "u string, n string, d string, s string, x double")
    got = one(df.select(F.col("u").rlike("대학(?!수학능력)"), X.strip_affiliation(F.col("n")), X.compact_date(F.col("d")), F.length(X.ellipsis(F.col("s"), 45)), X.half_even(F.col("x"), 1), X.fixed(F.lit(1234.25), 1), X.script(F.lit("漢한")), X.level(F.lit("a > b"), 2, "-"), X.level(F.lit("a"), 2, "-")))
    assert got == (False, "이름", "2024-02-29", 46, 0.2, "1,234.2", "hangul", "b", "-")


def test_word_boundary_dialects(spark):
    df = spark.createDataFrame([("AI를 배우는",)], "t string")
    assert one(df.select(F.col("t").rlike(r"(?<![A-Za-z0-9_])AI(?![A-Za-z0-9_])"), F.col("t").rlike(r"(?U)\bAI\b"))) == (True, False)


def test_hypergeometric_against_exact_integers(spark):
    cases = [(171, 709, 68, 4), (21, 384, 68, 3), (0, 10, 5, 0), (5, 5, 5, 5), (300, 1093, 68, 10)]
    df = spark.createDataFrame(cases, "kk int, nn int, n int, k int")
    for r in stats.hypergeometric_tails(df, "kk", "nn", "n", "k").collect():
        big_k, big_n, n, k = r["kk"], r["nn"], r["n"], r["k"]
        low = sum(math.comb(big_k, i) * math.comb(big_n - big_k, n - i) for i in range(0, k + 1)) / math.comb(big_n, n)
        high = sum(math.comb(big_k, i) * math.comb(big_n - big_k, n - i) for i in range(k, n + 1)) / math.comb(big_n, n)
        assert r["p_le"] == pytest.approx(low, rel=1e-9, abs=1e-12)
        assert r["p_ge"] == pytest.approx(high, rel=1e-9, abs=1e-12)
    assert stats.hypergeometric_tails(df.where("k = 4"), "kk", "nn", "n", "k").first()["p_le"] == pytest.approx(3.7872014008877336e-05, rel=1e-9)


def test_log_factorial_is_continuous(spark):
    df = spark.range(1, 2000, 37).select("id", stats.log_factorial(F.col("id")).alias("l"))
    assert all(r["l"] == pytest.approx(math.lgamma(r["id"] + 1), rel=1e-12) for r in df.collect())


def test_kappa_edges(spark):
    df = spark.createDataFrame([("x", "a", "a"), ("x", "a", "a"), ("y", "a", "b"), ("y", "b", "a"), ("y", None, "a")], "g string, a string, b string")
    got = {r["g"]: (r["n"], r["kappa"]) for r in stats.kappa(df, ["g"], "a", "b").collect()}
    assert got == {"x": (2, 1.0), "y": (2, -1.0)}


def test_graph_path_and_isolate(spark):
    rec = spark.createDataFrame([("g", ["a", "b"]), ("g", ["b", "c", "b"]), ("g", ["d"]), ("h", [])], "grp string, items array<string>")
    nodes, edges = graph.nodes_of(rec, "grp", "items"), graph.pair_edges(rec, "grp", "items")
    label = graph.components(nodes, edges, "grp")
    assert one(graph.component_sizes(label, "grp")) == ("g", 2, 3)
    assert one(graph.summary(graph.degrees(nodes, edges, "grp"), "grp"))[1:3] == (4, 2)
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(nodes, edges, label, "grp").collect()}
    assert got == {"a": 0.0, "b": pytest.approx(1 / 3), "c": 0.0, "d": 0.0}


def _shortest_path_shares(nodes, edges):
    """Brute force: all shortest paths by enumeration."""
    adj = {v: set() for v in nodes}
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    out = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        paths, found, depth = [[s]], {}, {s: 0}
        while paths:
            fresh = []
            for p in paths:
                for w in adj[p[-1]]:
                    if depth.setdefault(w, len(p)) == len(p):
                        fresh.append([*p, w])
                        found.setdefault(w, []).append([*p, w])
            paths = fresh
        for ps in found.values():
            for p in ps:
                for v in p[1:-1]:
                    out[v] += 1 / len(ps)
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in out.items()}


def test_betweenness_against_enumeration(spark):
    rng = random.Random(4)
    names = [f"n{i:02d}" for i in range(14)]
    pairs = {tuple(sorted(rng.sample(names, 2))) for _ in range(22)}
    rec = spark.createDataFrame([("g", list(p)) for p in pairs] + [("g", [v]) for v in names], "grp string, items array<string>")
    nodes, edges = graph.nodes_of(rec, "grp", "items"), graph.pair_edges(rec, "grp", "items")
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(nodes, edges, graph.components(nodes, edges, "grp"), "grp", 3).collect()}
    want = _shortest_path_shares(names, pairs)
    assert all(got[v] == pytest.approx(want[v], abs=1e-8) for v in names)


@pytest.mark.parametrize("large", [0, 1_000])
def test_betweenness_of_cliques_twins_and_pieces(spark, monkeypatch, large):
    monkeypatch.setattr(graph, "LARGE_COMPONENT", large)
    rng = random.Random(8)
    names = [f"n{i:02d}" for i in range(40)]
    papers = [rng.sample(names[:24], rng.choice([2, 2, 3, 4])) for _ in range(16)] + [["n24", "n25", "n26"], ["n26", "n27"], ["n28", "n29"]] + [[v] for v in names]
    papers += [[papers[i][0], papers[i][1], f"n{30 + 2 * i}", f"n{31 + 2 * i}"] for i in range(4)]
    rec = spark.createDataFrame([("g", p) for p in papers], "grp string, items array<string>")
    nodes, edges = graph.nodes_of(rec, "grp", "items"), graph.pair_edges(rec, "grp", "items")
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(nodes, edges, graph.components(nodes, edges, "grp"), "grp", 3).collect()}
    want = _shortest_path_shares(names, {tuple(sorted((x, y))) for p in papers for x in p for y in p if x < y})
    assert all(got[v] == pytest.approx(want[v], abs=1e-8) for v in names)


def test_betweenness_of_many_leaves_is_quick(spark):
    a, b = 30_000, 2_000
    edges = spark.range(a).selectExpr("'g' AS grp", "'h1' AS src", "concat('x', id) AS dst").union(spark.range(b).selectExpr("'g'", "'h2'", "concat('y', id)")).union(spark.sql("SELECT 'g', 'h1', 'h2'"))
    nodes = edges.selectExpr("grp", "explode(array(src, dst)) AS node").distinct()
    began = time.monotonic()
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(nodes, edges, nodes.selectExpr("*", "'h1' AS component"), "grp").where("betweenness > 0").collect()}
    assert time.monotonic() - began < 45
    pairs = (a + b + 1) * (a + b)
    assert got == {"h1": pytest.approx((a * (a - 1) + 2 * a * (b + 1)) / pairs, abs=1e-8), "h2": pytest.approx((b * (b - 1) + 2 * b * (a + 1)) / pairs, abs=1e-8)}


def test_quotas_sum_up(spark):
    df = spark.createDataFrame([(s, i) for s, k in (("a", 7), ("b", 7), ("c", 3)) for i in range(k)], "s string, i int")
    q = {r["s"]: r["quota"] for r in sampling.quotas(df, "s", 10).collect()}
    assert sum(q.values()) == 10 and q["a"] == q["b"] == 4
    assert sampling.stratified(df, "s", "i", 10, 1, ["c"]).groupBy("s").count().where("s = 'c'").first()[1] == 3


def test_seeded_indices_replay_the_generator(spark):
    rng = random.Random(20260930)
    want = [(r, i) for r in (1, 2) for i in rng.sample(range(50), 5)]
    assert [tuple(r) for r in sampling.seeded_indices(spark, 50, 5, 2, 20260930).collect()] == want


def test_rank_with_ties(spark):
    df = spark.createDataFrame([(v,) for v in (149, 93, 90, 80, 75, 70, 66, 61, 60, 60, 60, 5)], "v int")
    got = sorted((r["rank"], r["v"]) for r in ranking.top_with_ties(df, "v", 10).collect())
    assert len(got) == 11 and [r for r, _ in got][-3:] == [9, 9, 9]


def test_quantile_conventions(spark):
    df = spark.range(10_000).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    r = ranking.quantiles(df, ["g"], "v", 10_000).first()
    assert (r["lo"], r["median"], r["hi"], r["p05"], r["p95"]) == (250, 5000, 9750, 500, 9499)


def test_updates_restore_and_unmatched(spark):
    base = spark.createDataFrame([("a", "Y", "f"), ("b", "N", "")], "id string, inc string, func string")
    up = spark.createDataFrame([("a", "out"), ("z", "out")], "id string, verdict string")
    out = merge.update_from(base, up, "id", F.col("u.verdict") == "out", {"inc": F.lit("N"), "func": F.lit("")})
    assert sorted(map(tuple, out.collect())) == [("a", "N", ""), ("b", "N", "")]
    assert [r["id"] for r in merge.unmatched(up, base, "id").collect()] == ["z"]


def test_snapshot_detects_change(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert quality.snapshot(a).first() == quality.snapshot(a.orderBy(F.desc("k"))).first()
    assert quality.snapshot(a).first() != quality.snapshot(a.withColumn("v", F.lit("x"))).first()
    with pytest.raises(AssertionError):
        quality.assert_empty(a, "rows")


def test_hypergeometric_far_out_and_large(spark):
    from fractions import Fraction
    from math import comb

    rows = [(20, 100, 30, k) for k in range(-1, 22)] + [(5, 10, 8, k) for k in range(2, 7)] + [(500, 1000, 400, 120), (3, 1_000_000_000, 1_000_000, 0), (400_000_000, 1_000_000_000, 1_000_000, 400_500)]
    got = stats.hypergeometric_tails(spark.createDataFrame(rows, "bk bigint, bn bigint, n bigint, k bigint"), "bk", "bn", "n", "k").collect()
    for r in got:
        if r["bn"] <= 1000:
            p = lambda ks: float(sum(Fraction(comb(r["bk"], i) * comb(r["bn"] - r["bk"], r["n"] - i), comb(r["bn"], r["n"])) for i in ks if 0 <= i <= r["n"]))  # noqa: E731, B023
            assert r["p_le"] == pytest.approx(p(range(r["k"] + 1)), rel=1e-9, abs=1e-12) and r["p_ge"] == pytest.approx(p(range(max(0, r["k"]), r["n"] + 1)), rel=1e-9, abs=1e-12)
    assert got[-2]["p_le"] == pytest.approx((1 - 1e-3) ** 3, rel=1e-4) and 0.1 < got[-1]["p_ge"] < 0.2


def test_places_and_medians_without_a_window_over_a_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randrange(1000) / 2) for _ in range(501)] + [("c", 7.0), ("c", None), ("d", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    for g in (*"abc", None):
        own = sorted(v for k, v in rows if k == g and v is not None)
        placed = ranking.number_within(df.where("v is not null"), "g", ["v"]).where(F.col("g").eqNullSafe(g)).orderBy("rank").collect()
        assert [r["rank"] for r in placed] == list(range(len(own))) and [r["v"] for r in placed] == own
    got = {r["g"]: r["median"] for r in ranking.exact_median(df.where("g is not null"), "g", "v").collect()}
    assert got == {g: statistics.median(v for k, v in rows if k == g and v is not None) for g in "abc"}
    assert ranking.exact_median(df.limit(0), "g", "v").count() == 0


def test_rank_draws_are_simple_random_samples(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)] + [(None, 1)], "g string, u bigint")
    rows = sampling.rank_draws(df, "g", "u", 4, 600, 7).collect()
    by = {}
    for g, u, rep in rows:
        by.setdefault((g, rep), []).append(u)
    assert all(len(v) == len(set(v)) == (4 if g == "a" else 3) for (g, _), v in by.items()) and len(by) == 1200
    seen = [sum(i in v for (g, _), v in by.items() if g == "a") for i in range(10)]
    assert min(seen) > 180 and max(seen) < 300  # 240 expected, 12 the deviation
    with pytest.raises(ValueError):
        sampling.rank_draws(df, "g", "u", sampling.MAX_DRAW + 1, 1, 7)


def test_metrics_of_a_draw(spark):
    df = spark.createDataFrame([("x", 1, ["a", "b", "a"]), ("x", 1, ["c"]), ("x", 1, ["b", "d"]), ("y", 1, []), ("y", 1, None)], "g string, rep int, keys array<string>")
    got = {r["g"]: r[2:] for r in graph.draw_metrics(df, ["g", "rep"], "keys").collect()}
    assert got["x"] == (3, pytest.approx(5 / 3), pytest.approx(100 / 3), 25.0, 1.0, 3, 2) and got["y"][:2] == (2, 0.0) and got["y"][3:] == (None, None, 0, 0)


def test_components_of_paths_stars_and_isolates(spark):
    edges = [("g", f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("g", "z0", f"z{i}") for i in range(1, 9)] + [("h", "001", "000"), ("h", "001", "001")]
    nodes = sorted({(g, x) for g, *e in edges for x in e} | {("g", "lone")})
    got = {(r[0], r[1]): r[2] for r in graph.components(spark.createDataFrame(nodes, "g string, node string"), spark.createDataFrame(edges, "g string, src string, dst string"), "g").collect()}
    assert got == {(g, x): "lone" if x == "lone" else "z0" if x[0] == "z" else "000" for g, x in nodes}


def test_scope_cases(spark):
    cases = [
        ("한국어교육에서 챗봇", "", "한국어"), ("국어교육과 챗봇", "", None), ("한국어 교육과 국어교육", "", "한국어"), ("AI를 활용한 EFL 쓰기 수업", "", "영어·외국어"), ("기계번역 오류 분석", "통역번역학", None), ("번역 오류와 영어 수업", "", "영어·외국어"),
        ("형태소 분석과 한국어", "언어학", None), ("Chinese learners", "", None), ("Teaching Chinese", "", "중국어"), ("chineseness and teaching", "", None), ("수업 설계", "인문학 > 영어와문학", "영어·외국어"), ("", "국어교육", None), (None, None, None),
    ]
    df = spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(cases)], "i int, t string, f string")
    got = {r["i"]: r["s"] for r in df.select("i", scope.scope(F.col("t"), F.col("f")).alias("s")).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(cases)}


def test_author_key_against_its_grammar():
    import re

    from loomspark.functions.text import author_key

    shape = re.compile(r"\s*([^(]+?)\s*(?:\((.*)\))?\s*$")
    rng = random.Random(4)
    for _ in range(3000):
        entry = "".join(rng.choice("가 홍(()) 대학교\nA소") for _ in range(rng.randrange(9)))
        m = shape.match(entry)
        name, affiliation = (m[1], m[2] or "") if m else (entry, "")
        assert author_key(entry).partition("|")[0] == name.strip(), repr(entry)
        assert affiliation.strip() or author_key(entry).endswith("|")


def test_verdict_over_comparison_groups(spark):
    df = spark.createDataFrame([(True, True), (True, False), (None, True), (False, None)], "a boolean, b boolean")
    assert [r[0] for r in df.select(stats.lag_verdict([F.col("a"), F.col("b")])).collect()] == ["late against all", "late against one", "late against one", "size effect"]


def test_fixed_decimals_round_the_binary_value(spark):
    values = [2.675, 0.125, 0.375, 1234.5, 2.5, 1e6 + 0.005, -0.125]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(X.fixed(F.col("v"), 2)).collect()]
    assert got == [f"{v:,.2f}" for v in values]


def test_collation_goes_by_script_and_case(spark):
    df = spark.createDataFrame([("中",), ("가",), ("b",), ("A",), ("a",), ("é",)], "w string")
    assert [r["w"] for r in ranking.collated_places(df, "w").orderBy("place").collect()] == ["a", "A", "b", "é", "가", "中"]


def test_release_deletes_what_was_cut(spark):
    import os

    from loomspark.session import cut, release

    df = cut(spark.range(10))
    path = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 10
    release(df, spark.range(3))
    release(df)
    assert not os.path.exists(path)


def test_places_in_many_groups_without_a_broadcast(spark, monkeypatch):
    from loomspark import session

    monkeypatch.setattr(session.small_side, "__defaults__", (2,))
    df = spark.range(300).selectExpr("id % 40 AS g", "id AS v").repartition(5)
    rows = ranking.number_within(df, "g", ["v"]).collect()
    assert {(r["g"], r["v"], r["rank"]) for r in rows} == {(i % 40, i, i // 40) for i in range(300)}


def test_betweenness_of_a_large_component(spark):
    import tracemalloc

    import numpy as np

    n = 210_000
    spokes = spark.range(1, n).selectExpr("'g' AS g", "'000000' AS src", "lpad(string(id), 6, '0') AS dst")
    nodes = spark.range(n).selectExpr("'g' AS g", "lpad(string(id), 6, '0') AS node")
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(nodes, spokes, nodes.withColumn("component", F.lit("000000")), "g", 2).where("betweenness > 0").collect()}
    assert got == {"000000": 1.0}
    rng = np.random.default_rng(5)
    edges = np.unique(np.sort(rng.integers(0, 60_000, (90_000, 2)), axis=1), axis=0)
    edges = edges[edges[:, 0] < edges[:, 1]]
    tracemalloc.start()
    simplicial = graph._simplicial(edges[:, 0], edges[:, 1], 60_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = {}
    for x, y in edges.tolist():
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    assert all(simplicial[v] == all(y in near[x] for x in near[v] for y in near[v] if x != y) for v in near) and most < 600 * 60_000

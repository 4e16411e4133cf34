import random
import tracemalloc

import pytest

s = pytest.importorskip("loomspark.llm.consensus")
SCHEMA = "id string, coder string, include string, func string, meth string, lang_group string, t int"


def codings(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "timestamp_seconds(t) AS coded_at")


def test_only_the_latest_answer_counts(spark):
    df = codings(spark, [("p", "a", "n", None, None, None, 1), ("p", "a", " Yes", "쓰기\xa0", "", "ＡＩ", 2), ("p", "a", None, " ", None, "", 3), ("p", "b", "N ", None, None, None, 1), ("p", "b", "N ", None, None, None, 1), (None, "b", "Y", None, None, None, 1), ("p", None, "Y", None, None, None, 1)])
    assert sorted(map(tuple, s.latest_answers(df).collect())) == [("func", "p", "a", "쓰기"), ("include", "p", "a", "Y"), ("include", "p", "b", "N"), ("lang_group", "p", "a", "AI")]


def test_reliable_coders_outvote_careless_ones(spark):
    rng = random.Random(3)
    truth = {f"p{i}": rng.choice(["Y", "N"]) for i in range(300)}
    rows = []
    for p, t in truth.items():
        for coder, right in (("good1", 0.97), ("good2", 0.95), ("bad1", 0.5), ("bad2", 0.5), ("bad3", 0.5)):
            rows.append((p, coder, t if rng.random() < right else "YN"[t == "Y"], None, None, None, 1))
    r = s.fit(s.latest_answers(codings(spark, rows)))
    found = {x["item"]: x["label"] for x in s.contested(r).collect()}
    own = {}
    for p, _, v, *_ in rows:
        own.setdefault(p, []).append(v)
    assert set(found) == {p for p, v in own.items() if len(set(v)) > 1}
    good = sum(found[p] == truth[p] for p in found) / len(found)
    votes = sum(max(set(own[p]), key=own[p].count) == truth[p] for p in found) / len(found)
    assert good > 0.9 and good > votes
    rel = {x["coder"]: x["reliability"] for x in r.reliability.collect()}
    assert min(rel["good1"], rel["good2"]) > 0.85 > 0.7 > max(rel["bad1"], rel["bad2"], rel["bad3"])
    for x in r.posteriors.collect():
        assert sum(x["p"]) == pytest.approx(1)


def test_agreement_edges(spark):
    df = codings(spark, [("p", "a", "Y", None, None, None, 1), ("p", "b", "Y", None, None, None, 1), ("q", "a", "Y", None, None, None, 1)])
    assert s.agreement(s.latest_answers(df)).first()["alpha"] == 1.0
    mixed = codings(spark, [(p, c, v, None, None, None, 1) for p, vs in (("p", "YY"), ("q", "NN"), ("r", "YN")) for c, v in zip("ab", vs)])
    assert s.agreement(s.latest_answers(mixed)).first()["alpha"] == pytest.approx(1 - (1 - 2 / 3) / (1 - 12 / 30))  # 3 Y, 3 N


def test_empty_and_single(spark):
    empty = codings(spark, [])
    r = s.fit(s.latest_answers(empty))
    assert r.decided().count() == 0 and s.contested(r).count() == 0 and s.agreement(s.latest_answers(empty)).count() == 0
    r = s.fit(s.latest_answers(codings(spark, [("p", "a", "Y", None, None, None, 1)])))
    assert [x["label"] for x in r.decided().collect()] == ["Y"] and s.contested(r).count() == 0


def test_both_ways_agree_and_say_whether_they_settled(spark):
    rng = random.Random(11)
    rows = []
    for i in range(120):
        yes, kind = rng.choice("YN"), rng.choice(["쓰기", "말하기", "읽기"])
        for c in rng.sample(["a", "b", "c", "d", "e"], 3):
            sure = {"a": 0.95, "b": 0.9}.get(c, 0.6)
            rows.append((f"p{i:03d}", c, yes if rng.random() < sure else rng.choice("YN"), kind if rng.random() < sure else "듣기", None, None, 1))
    answers = s.latest_answers(codings(spark, rows))
    narrow, joined = s.fit(answers), s.fit(answers, broadcast_numbers=0)
    assert narrow.converged and joined.converged and not s.fit(answers, max_rounds=2).converged and not s.fit(answers, max_rounds=2, broadcast_numbers=0).converged
    label = lambda r: {(x["axis"], x["item"]): (x["label"], x["contested"]) for x in r.decided().collect()}
    one, two = label(narrow), label(joined)
    assert one.keys() == two.keys() and sum(one[k] == two[k] for k in one) >= 0.98 * len(one)
    rel = lambda r: {(x["axis"], x["coder"]): x["reliability"] for x in r.reliability.collect()}
    one, two = rel(narrow), rel(joined)
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=0.02) for k in one)


def test_too_many_labels_are_an_error(spark):
    many = spark.range(12).selectExpr("'x' AS axis", "string(id) AS item", "'c' AS coder", "string(id) AS label")
    with pytest.raises(ValueError):
        s.fit(many, max_labels=10)


def test_driver_holds_one_table_at_a_time(spark):
    coders, width = 3000, 20
    answers = spark.range(60_000).selectExpr("'a' AS axis", "concat('p', id div 4) AS item", f"concat('c', (id * 7919) % {coders}) AS coder", f"concat('l', pmod(hash(id), {width})) AS label")
    tracemalloc.start()
    r = s.fit(answers, max_rounds=3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert r.reliability.count() == coders and r.posteriors.count() == 15_000
    assert most < 3 * coders * width**2 * 8


def test_driver_never_holds_a_whole_table(spark):
    coders, width = 12_000, 20
    answers = spark.range(60_000).selectExpr("'a' AS axis", "concat('p', id div 4) AS item", f"concat('c', (id * 7919) % {coders}) AS coder", f"concat('l', pmod(hash(id), {width})) AS label")
    tracemalloc.start()
    r = s.fit(answers, max_rounds=3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert r.reliability.count() == coders and r.posteriors.count() == 15_000
    assert most < coders * width**2 * 8 / 3


def test_tables_by_files_and_by_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK_NUMBERS", 300)  # blocks of a few coders
    answers = spark.range(600).selectExpr("'a' AS axis", "concat('p', id div 4) AS item", "concat('c', (id * 7919) % 40) AS coder", "concat('l', pmod(hash(id div 4) + int(id % 4 = 0), 5)) AS label")
    rows = lambda r: {x["item"]: x["p"] for x in r.posteriors.collect()}
    files = rows(s.fit(answers, max_rounds=3))
    monkeypatch.setattr(s, "_shared_folder", lambda spark: None)
    sent = rows(s.fit(answers, max_rounds=3))
    assert files.keys() == sent.keys() and all(files[k] == pytest.approx(sent[k], abs=1e-12) for k in files)

import random

import pytest

s = pytest.importorskip("loomspark.llm.subjects")
from pyspark.sql import functions as F


def test_terms_survive_markup_and_symbols():
    plain = s.sentence_terms("서버 지연을 다루었다. We read error logs in class!")
    dirty = s.sentence_terms("서<br/>버 지&nbsp;연을 다루😀었다. We read er※ror <b>logs</b> in class!")
    assert plain == dirty and "서버지연" in plain[0] and "error logs" in plain[1]
    assert s.sentence_terms("不了解错误日志的背景。") == [{t for n in (2, 3, 4) for t in ("不了解错误日志的背景"[i : i + n] for i in range(11 - n))}]
    assert s.sentence_terms(" . ") == []


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, areas = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/subject_areas.parquet")
    labels = spark.read.parquet(f"{folder}/subject_labels.parquet").distinct()
    half = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    found = {tuple(r) for r in s.subject_areas(docs, areas, labels.where(half > 0)).collect()}
    kept = docs.where("text is not null").select("doc_id")
    held = {tuple(r) for r in labels.where(half == 0).join(kept, "doc_id", "left_semi").select("doc_id", "area_code").collect()}
    ids = {d for d, _ in held}
    own = {x for x in found if x[0] in ids}
    assert len(own & held) / len(own) > 0.95 and len(own & held) / len(held) > 0.85


def test_propagation_reaches_documents_without_seed_phrases(spark):
    links = spark.createDataFrame([(1, "x", 0), (2, "x", 0), (2, "y", 1), (3, "y", 1), (4, "z", 0)], "doc_id bigint, phrase string, area int")
    seeds = spark.createDataFrame([(1, [0]), (3, [1])], "doc_id bigint, areas array<int>")
    got = {r["doc_id"]: r["areas"] for r in s.propagate(links, seeds, 2).collect()}
    assert got[1] == [0] and got[3] == [1] and set(got[2]) == {0, 1}


def test_odd_tables(spark):
    areas = spark.createDataFrame([("A",), ("B",), (None,)], "area_code string")
    docs = spark.createDataFrame([(1, "x y."), (2, None), (3, ""), (None, "x y."), (4, "word " * 50_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, "A"), (1, "A"), (None, "A"), (2, "Z"), (3, None)], "doc_id bigint, area_code string")
    assert s.subject_areas(docs, areas, labels).count() == 0
    assert s.subject_areas(docs.limit(0), areas, labels).count() == 0
    assert s.subject_areas(docs, areas, labels.limit(0)).count() == 0
    assert s.subject_areas(docs, areas.limit(0), labels).count() == 0


def test_small_world(spark):
    rng = random.Random(2)
    topics = {"A": ["red apple", "green pear", "ripe plum"], "B": ["steel bridge", "stone tower", "brick wall"]}
    frames = ["learners wrote about the {} today.", "we asked everyone to describe {} twice.", "nobody disliked {} in the end."]
    filler = ["the class met again on monday.", "some pupils kept a diary for weeks.", "teachers gave feedback after lunch."]
    docs, truth = [], {}
    for i in range(400):
        own = rng.sample(["A", "B"], rng.choice([0, 1, 1, 1, 2]))
        lines = [rng.choice(frames).format(rng.choice(topics[a])) for a in own for _ in range(3)] + rng.choices(filler, k=4)
        rng.shuffle(lines)
        docs.append((i, " ".join(lines)))
        truth[i] = set(own)
    # documents of other matters, so that no area is in every tenth document
    docs += [(1000 + i, " ".join(rng.choices(filler, k=6))) for i in range(5000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, a) for i in range(120) for a in truth[i]], "doc_id bigint, area_code string")
    found = {}
    for r in s.subject_areas(df, spark.createDataFrame([("A",), ("B",)], "area_code string"), labels).collect():
        found.setdefault(r["doc_id"], set()).add(r["area_code"])
    rest = [i for i in range(120, 400)]
    right = sum(found.get(i, set()) == truth[i] for i in rest) / len(rest)
    assert right > 0.9 and not any(i >= 1000 for i in found)


def _areas(spark, docs, labels):
    found = {}
    for r in s.subject_areas(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([("A",), ("B",)], "area_code string"), spark.createDataFrame(labels, "doc_id bigint, area_code string")).collect():
        found.setdefault(r["doc_id"], set()).add(r["area_code"])
    return found


TOPICS = {"A": ["red apple", "green pear", "ripe plum"], "B": ["steel bridge", "stone tower", "brick wall"]}
FRAMES = ["learners wrote about the {} today.", "we asked everyone to describe {} twice.", "nobody disliked {} in the end."]
FILLER = ["the class met again on monday.", "some pupils kept a diary for weeks.", "teachers gave feedback after lunch."]


def test_an_area_may_hold_a_third_of_the_documents(spark):
    rng = random.Random(4)
    own = [rng.choice(["A", "B", ""]) for _ in range(600)]
    docs = [(i, " ".join([rng.choice(FRAMES).format(t) for t in TOPICS.get(a, [])] + rng.choices(FILLER, k=3))) for i, a in enumerate(own)]
    found = _areas(spark, docs, [(i, a) for i, a in enumerate(own[:120]) if a])
    assert sum(found.get(i, set()) == ({own[i]} if own[i] else set()) for i in range(120, 600)) / 480 > 0.95


def test_contexts_common_among_labelled_documents_are_learnt_from_the_corpus(spark):
    rng = random.Random(5)
    hedge = "unlike earlier work 의 {}."  # in a quarter of the labelled documents, there mostly of the main area

    def text(area, aside=False):
        lines = [rng.choice(FRAMES).format(t) for t in TOPICS.get(area, [])] + rng.choices(FILLER, k=3)
        return " ".join(lines + [hedge.format(rng.choice(TOPICS["A"]))] * aside)

    kinds = [("A", True)] * 40 + [("A", False)] * 40 + [("B", False)] * 70 + [("", True)] * 22 + [("", False)] * 68
    docs = [(i, text(*k)) for i, k in enumerate(kinds)]
    labels = [(i, a) for i, (a, _) in enumerate(kinds) if a]
    labels += [(i, "B") for i, (a, _) in enumerate(kinds) if not a]  # labelled documents without A
    docs += [(1000 + i, text("A")) for i in range(150)] + [(2000 + i, text("B")) for i in range(1500)] + [(4000 + i, text("", True)) for i in range(150)]
    found = _areas(spark, docs, labels)
    assert sum(found.get(1000 + i) == {"A"} for i in range(150)) > 140
    assert sum("A" in found.get(4000 + i, set()) for i in range(150)) < 15


def test_labels_move_from_seeds_only(spark):
    links = spark.createDataFrame([(i, f"p{i}") for i in range(6)] + [(i + 1, f"p{i}") for i in range(6)], "doc_id bigint, phrase string")  # a chain 0-1-…-6
    seeds = spark.createDataFrame([(0, [1])], "doc_id bigint, areas array<int>")
    assert [tuple(r) for r in s.propagate(links, seeds, 2, max_rounds=0).collect()] == [(0, [1])]
    assert {r["doc_id"]: r["areas"] for r in s.propagate(links, seeds, 2).collect()} == {i: [1] for i in range(7)}
    with pytest.raises(RuntimeError):
        s.propagate(links, seeds, 2, max_rounds=3)
    assert s.propagate(links, seeds.limit(0), 2).count() == 0


def test_without_rounds_nothing_beyond_the_seeds(spark):
    rng = random.Random(7)
    own = [rng.choice("AB") for _ in range(200)]
    docs = spark.createDataFrame([(i, " ".join([rng.choice(FRAMES).format(t) for t in TOPICS[a]] + rng.choices(FILLER, k=3))) for i, a in enumerate(own)], "doc_id bigint, text string")
    areas, labels = spark.createDataFrame([("A",), ("B",)], "area_code string"), spark.createDataFrame(list(enumerate(own[:60])), "doc_id bigint, area_code string")
    assert s.subject_areas(docs, areas, labels, max_rounds=0).count() == 0
    assert {r["doc_id"]: r["area_code"] for r in s.subject_areas(docs, areas, labels).collect()} == {i: own[i] for i in range(60, 200)}


def test_too_many_areas_are_an_error(spark):
    areas = spark.range(s.MAX_AREAS + 1).select(F.col("id").cast("string").alias("area_code"))
    docs, labels = spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), spark.createDataFrame([(1, "1")], "doc_id bigint, area_code string")
    with pytest.raises(ValueError):
        s.subject_areas(docs, areas, labels)

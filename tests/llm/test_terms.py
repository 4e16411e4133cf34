import collections
import itertools
import random
import unicodedata

import pytest

terms = pytest.importorskip("loomspark.llm.terms")
cooccur = pytest.importorskip("loomspark.llm.cooccur")
dictionary = pytest.importorskip("loomspark.llm.dictionary")
from loomspark.functions.packed import parse_packed
from loomspark.functions.text import keyword_text
from pyspark.sql import functions as F


def papers(spark, rows, columns="arti_id string, kw_ko string, kw_en string, authors string"):
    return spark.createDataFrame(rows, columns).withColumn("harvested_at", F.lit(None).cast("timestamp")).withColumn("term", F.lit("clash"))


def test_dictionary_is_dense(spark):
    ids = sorted(r["id"] for r in dictionary.number_rows(spark.range(0, 1000, 7).select(F.col("id").alias("v")).repartition(5)).collect())
    assert ids == list(range(len(range(0, 1000, 7))))
    assert dictionary.number_rows(spark.range(0).select(F.col("id").alias("v"))).count() == 0


@pytest.mark.parametrize("block", [400_000, 7])
def test_terms_against_counting(spark, monkeypatch, block):
    monkeypatch.setattr(terms, "BLOCK_TERMS", block)
    monkeypatch.setattr(terms, "RANGE", 16)
    rng = random.Random(5)
    rows = [(f"p{i}", "; ".join(rng.choice(["AI", "ａｉ", "쓰기", f"t{rng.randrange(90)}", "-", "x-y"]) for _ in range(rng.randrange(6))), None if i % 3 else "hot", None) for i in range(200)]
    rows += [rows[0], (None, "lost", "lost", None), ("pp", " ", "", None)]
    occ, rec = collections.Counter(), collections.Counter()
    for _, ko, en, _ in {r[0]: r for r in rows if r[0]}.values():
        for f, v in (("kw_ko", ko), ("kw_en", en)):
            own = [t for e, _ in parse_packed(v) if (t := keyword_text(unicodedata.normalize("NFKC", e)))]
            occ.update((f, t) for t in own)
            rec.update({(f, t) for t in own})
    want = {(*k, occ[k], n, "rare" if n <= 2 else "common" if n * 100 > 201 * 5 else "") for k, n in rec.items()}
    assert {tuple(r) for r in terms.term_frequencies(papers(spark, rows)).collect()} == want


def test_no_terms(spark):
    assert terms.term_frequencies(papers(spark, [("p", None, " ", None)])).count() == 0
    assert terms.term_frequencies(papers(spark, [])).count() == 0


@pytest.mark.parametrize("tile", [512, 3])
def test_pairs_against_counting(spark, monkeypatch, tile):
    monkeypatch.setattr(cooccur, "TILE", tile)
    monkeypatch.setattr(cooccur, "BLOCK_PAIRS", 50)
    rng = random.Random(9)
    baskets = [sorted({f"i{min(rng.randrange(40), rng.randrange(40)):02d}" for _ in range(rng.randrange(14))}) for _ in range(150)] + [[f"i{k:02d}" for k in range(30)]] * 2
    df = spark.createDataFrame([(f"b{k}", i, len(b)) for k, b in enumerate(baskets) for i in b] + [(None, "i00", 1), ("z", None, 1)], "basket string, item string, size int")
    n = spark.createDataFrame([(len(baskets),)], "n_all bigint")
    one, two = collections.Counter(), collections.Counter()
    for b in baskets:
        one.update(b)
        two.update(itertools.combinations(b, 2))
    want = {(a, b, one[a], one[b], v) for (a, b), v in two.items() if v >= 5 and v * len(baskets) >= 2 * one[a] * one[b]}
    got = {tuple(r)[:5] for r in cooccur.cooccurrence(df, n, 5, 2).collect()}
    assert got == want and got


def test_author_baskets(spark):
    rows = [("p", None, None, "홍(서울대학교 국어과); 홍（서울대학교）; Kim; 이(가나 다라), 박(라)"), ("q", None, None, None), ("p", None, None, "홍(서울대학교 국어과); 홍（서울대학교）; Kim; 이(가나 다라), 박(라)")]
    got = sorted(tuple(r) for r in cooccur.author_baskets(papers(spark, rows)).collect())
    assert ("p", "홍|서울대학교", len(got)) in got and not any(r[1].startswith("Kim") for r in got)
    empty = papers(spark, [])
    assert cooccur.cooccurrence(cooccur.author_baskets(empty), empty.agg(F.count("*").alias("n_all"))).count() == 0


@pytest.mark.parametrize("block", [400_000, 7])
def test_dictionaries_of_any_size_count_alike(spark, monkeypatch, block):
    monkeypatch.setattr(terms, "BLOCK_TERMS", block)
    monkeypatch.setattr(terms, "RANGE", 8)
    rng = random.Random(6)
    df = papers(spark, [(f"p{i}", "; ".join(f"t{rng.randrange(60)}" for _ in range(5)), "hot, hot, cold", None) for i in range(120)])
    rows = lambda **k: {tuple(r) for r in terms.term_frequencies(df, **k).collect()}
    assert rows() == rows(max_dictionary=0) and ("kw_en", "hot", 240, 120, "common") in rows()


def test_one_basket_of_many_tiles_is_spread(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "TILE", 16)
    items = [f"i{k:04d}" for k in range(1000)]
    df = spark.createDataFrame([(f"b{b}", i, 1000) for b in range(5) for i in items], "basket string, item string, size int")
    got = cooccur.cooccurrence(df, spark.createDataFrame([(20,)], "n_all bigint"), 5, 3)
    assert got.agg(F.count("*"), F.min("n_ab"), F.max("n_ab")).first()[:] == (1000 * 999 // 2, 5, 5)

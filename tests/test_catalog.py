import pytest
from loomspark.plans import catalog, packed

from oracle import same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, data, name):
    assert same(spark, catalog.QUERIES[name], catalog.SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).collect()


def test_entry_lists_every_query(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) | set(packed.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_pair_queries_cover_every_two_coders_of_a_paper(spark, data):
    c = spark.read.parquet(f"{data}/codings.parquet").where("id is not null and coder is not null and include is not null and coded_at is not null").select("id", "coder").distinct()
    want = {tuple(sorted((x["a"], x["b"]))) for x in c.withColumnRenamed("coder", "a").join(c.withColumnRenamed("coder", "b"), "id").where("a < b").select("a", "b").distinct().collect()}
    got = {(r["coder_a"], r["coder_b"]) for r in catalog.QUERIES["kappa_pairs"](spark, data).where("axis = 'include'").collect()}
    assert got == want and len(want) > 1


def test_upsert_reaches_every_key_of_both_tables(spark, data):
    ids = {r[0] for t, k in (("papers", "arti_id"), ("verdicts", "id")) for r in spark.read.parquet(f"{data}/{t}.parquet").select(k).distinct().collect() if r[0] is not None}
    assert {r["arti_id"] for r in catalog.QUERIES["upsert_verdicts"](spark, data).collect()} == ids

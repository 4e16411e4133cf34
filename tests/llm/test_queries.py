import pytest

q = pytest.importorskip("loomspark.llm.queries")
sql = pytest.importorskip("loomspark.llm.sql")
from oracle import same

COLUMNS = {"p1_found": ["arti_id", "axis", "label"], "p2_found": ["group_id", "mention_id"], "p3_found": ["plan_id", "category"], "p4_found": ["field", "term", "mark"], "p5_found": ["verdict_id", "axis", "canon_value"], "p6_found": ["author_a", "author_b"], "p8_ids": ["doc_id", "ids"], "p9_found": ["mix_id", "source"], "p10_found": ["doc_id", "area_code"]}


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, data, name):
    if name in sql.SQL:
        assert same(spark, q.QUERIES[name], sql.SQL[name], data)
    else:
        df = q.QUERIES[name](spark, data)
        df.collect()
        assert df.columns == COLUMNS.get(name, df.columns)


def test_core_does_not_know_this_package():
    import pathlib

    root = pathlib.Path(q.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "loomspark.llm" not in p.read_text(), p

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loomspark.functions.packed import distinct_papers, parse_packed, split_packed
from loomspark.plans import packed as queries

from oracle import same


def entries(text):
    return [e for e, _ in parse_packed(text)]


def test_kinds_of_separators():
    assert entries("a; b|c\td\ne\r\nf") == list("abcdef")
    assert entries("a，b、c, d") == list("abcd")
    assert entries("a / b · c") == list("abc")
    assert entries("a/b·c") == ["a/b·c"]
    assert entries("a, b; c, d") == ["a, b", "c, d"]
    assert entries("읽기, 쓰기 / 말하기") == ["읽기", "쓰기 / 말하기"]


def test_quotes_brackets_references():
    assert entries('"a; b"; c') == ["a; b", "c"]
    assert entries('"AI ""튜터"" 활용", x') == ['AI "튜터" 활용', "x"]
    assert entries("“a, b”, c") == ["a, b", "c"]
    assert entries("김(가, 나), 이（다, 라）") == ["김(가, 나)", "이（다, 라）"]
    assert entries("온(너울 교양학부(본교)); 다") == ["온(너울 교양학부(본교))", "다"]
    assert entries("R&amp;D 협력, x") == ["R&amp;D 협력", "x"]
    assert entries("Q&A; x") == ["Q&A", "x"]
    assert entries("students' voices, b") == ["students' voices", "b"]


def test_malformed_marks_backtrack_and_are_flagged():
    assert parse_packed('x; "abc; d') == [("x", ""), ('"abc', "open_quote"), ("d", "")]
    assert parse_packed("(a; b") == [("(a", "open_bracket"), ("b", "")]
    assert parse_packed("a); b") == [("a)", "stray_bracket"), ("b", "")]
    assert parse_packed("“a, b") == [("“a", "open_quote"), ("b", "")]


def test_empty_and_blank():
    assert parse_packed(None) == parse_packed("") == parse_packed(" 　\n") == []
    assert entries(" ; ;; ") == []
    assert entries('""; a') == ["a"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab ;,/·|\n、；", max_size=30))
def test_plain_text_equals_a_split_by_the_strongest_kind(text):
    for kind in ("[;；|\n]", "[,、]", r"(?<=\s)[/·](?=\s)"):
        if re.search(kind, text):
            assert entries(text) == [p.strip() for p in re.split(kind, text) if p.strip()]
            return
    assert entries(text) == ([text.strip()] if text.strip() else [])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab ,;"(/', min_size=1, max_size=8).filter(lambda x: x.strip()), min_size=1, max_size=5))
def test_quoted_entries_come_back(parts):
    packed = "; ".join('"' + p.replace('"', '""') + '"' for p in parts)
    assert entries(packed) == [p.strip() for p in parts]


def test_long_malformed_text_is_linear():
    for text in ("“" * 200_000, "(" * 200_000, '"' * 200_001, "&" * 200_000, "a;" * 200_000, "( “ " * 50_000):
        start = time.time()
        parse_packed(text)
        assert time.time() - start < 5


def test_operator_over_tables(spark):
    df = spark.createDataFrame([("p1", "a; b", None, "x"), ("p1", "a; b", None, "x"), (None, "c", "", "x"), ("p2", " ", "d,e", "x")], "arti_id string, field string, entry string, other string")
    rows = sorted(map(tuple, split_packed(df, "arti_id", ["field", "entry"], "f").select("arti_id", "f", "entry_pos", "entry").collect()), key=repr)
    assert rows == sorted([("p1", "field", 1, "a"), ("p1", "field", 2, "b")] * 2 + [(None, "field", 1, "c"), ("p2", "entry", 1, "d"), ("p2", "entry", 2, "e")], key=repr)
    assert split_packed(df.limit(0), "arti_id", ["field"]).count() == 0


def test_distinct_papers_takes_the_latest_harvest(spark):
    df = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("p", 2, "b"), (None, 3, "c")], "arti_id string, h int, kw string")
    df = df.selectExpr("arti_id", "timestamp_seconds(h) AS harvested_at", "kw")
    assert [tuple(r) for r in distinct_papers(df, "kw").collect()] == [("p", "b")]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, data, name):
    assert same(spark, queries.QUERIES[name], queries.SQL[name], data)


def test_the_grammar_as_sql():
    import duckdb

    cases = ["a; b, c", "a, b / c", 'x "q; r"; y', "홍(가; 나; (다, 라)); 이", "(open; b", "a&amp;b; c", "“p, q”, r", "a / b · c", '"he said ""hi"""; z', "  ", "", "a；b｜c", "‘s’; t)", "x/y, z"]
    c = duckdb.connect()
    c.execute("CREATE TABLE papers AS SELECT unnest(?) AS v, unnest(range(?)) AS i", [cases, len(cases)])
    c.execute("CREATE VIEW p AS SELECT i::VARCHAR AS arti_id, v AS authors, NULL AS harvested_at FROM papers")
    rows = c.execute("WITH " + queries.entries_sql(("authors",)).replace("FROM papers", "FROM p") + " SELECT arti_id::INT, entry_pos, entry FROM entries").fetchall()
    assert sorted(rows) == sorted((i, k, e) for i, t in enumerate(cases) for k, (e, _) in enumerate(parse_packed(t), 1))

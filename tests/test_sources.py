import json

import pytest
from loomspark.functions import markup
from loomspark.sources import files, paged, xlsx
from loomspark.streaming import windows
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SEARCH = """<r><total> 2 </total><record><articleInfo article-id="ART001234567"><title-group><article-title lang="original"><![CDATA[제목 &lt;A&gt;]]></article-title>
<article-title lang="english">Title</article-title></title-group><author-group><author english="x">홍길동(서울대)</author><author>김(가)</author></author-group>
<article-categories>인문학 &gt; 언어학</article-categories><url>http://u</url></articleInfo><journalInfo><journal-name>J</journal-name><pub-year>2024</pub-year></journalInfo></record>
<record><pub-year>24</pub-year>see ART009999999</record><record>none</record></r>"""
DETAIL = """<a><articleInfo><doi>https://doi.org/10.1/x</doi></articleInfo><keyword-group><keyword>챗봇</keyword><keyword>AI</keyword><keyword>AI</keyword></keyword-group>
<author-group><author><name>홍</name><name-eng>Hong</name-eng><institution>S</institution></author><author></author></author-group>
<referenceInfo><reference type-name="학술지" arti-id="ART1"><title>T</title><author>B</author><conference-name>C</conference-name><registration-day>20200101</registration-day></reference></referenceInfo></a>"""


def test_search_and_detail_records(spark):
    df = spark.createDataFrame([(SEARCH, DETAIL)], "s string, d string")
    r = df.select(markup.search_records(F.col("s")).alias("p"), markup.total_count(F.col("s")).alias("n"), markup.detail_record(F.col("d")).alias("x"), markup.doi_of(F.col("d")).alias("doi")).first()
    assert r["n"] == 2 and r["doi"] == "10.1/x"
    first, second = r["p"]
    assert (first["arti_id"], first["title_ko"], first["authors"], first["year"], first["journal"], first["field"]) == ("ART001234567", "제목 <A>", ["홍길동", "김"], 2024, "J", "인문학 > 언어학")
    assert second["arti_id"] == "ART009999999" and second["year"] is None
    x = r["x"]
    assert (x["kw_ko"], x["kw_en"], x["ref_available"], len(x["authors"])) == (["챗봇"], ["AI"], True, 1)
    assert tuple(x["references"][0]) == ("T", "B", "C", 2020, "학술지", "", "ART1")
    c = df.select(markup.detail_record(F.col("d")).alias("x")).agg(*markup.coverage(F.col("x"))).first()
    assert (c["records"], c["with_affil"], c["references"]) == (1, 1, 1)


def test_entity_variants(spark):
    df = spark.createDataFrame([("<![CDATA[a &amp;quot;b&quot;]]>  c", "&#65;&#39;&amp;lt;")], "a string, b string")
    r = df.select(markup.clean_text(F.col("a")), markup.element_text(F.col("a")), markup.cell_text(F.col("b"))).first()
    assert tuple(r) == ('a "b" c', 'a &quot;b&quot;  c', "&#65;'&lt;")


def test_citations_by_attribute_text_or_column(spark):
    df = spark.createDataFrame([('<citation-count own="7">3</citation-count>', 1), ("<citation-count> 3 </citation-count>", 1), ("<x/>", 1)], "x string, n int")
    assert [r[0] for r in df.select(markup.citations(F.col("x"), F.col("n"), "own")).collect()] == [7, 3, 1]


def test_xlsx_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("가", 1, None), ("b<&>", 2, "x")], "`논문명` string, n int, note string")
    path = str(tmp_path / "b.xlsx")
    xlsx.write_xlsx(path, {"영어 목록": df, "기타": df.limit(0)}, {"note": ["Y", "N"]}, {"note": 30})
    rows = xlsx.read_xlsx(spark, path)
    got = xlsx.by_header(xlsx.route_sheets(rows, [("en", "영어"), ("ko", "한국어")]), "논문명", ["n", "논문명", "absent"])
    assert sorted(map(tuple, got.select("n", "논문명", "absent").collect())) == [("1", "가", ""), ("2", "b<&>", "")]
    assert xlsx.read_xlsx(spark, path, "기타").count() == 1
    assert [xlsx.column_number(c) for c in ("A", "Z", "AA")] == [0, 25, 26] and xlsx.column_letters(26) == "AA"


def test_json_csv_and_reports(spark, tmp_path):
    schema = StructType([StructField("id", StringType()), StructField("v", StringType())])
    (tmp_path / "b1.json").write_text(json.dumps([{"id": "1", "v": "가"}], ensure_ascii=False))
    (tmp_path / "b2.json").write_text("[{broken")
    df = files.read_json(spark, str(tmp_path / "b*.json"), schema, lineage=True).cache()
    assert df.where("id = '1'").first()["source_file"] == "b1.json" and df.where(F.col(files.CORRUPT).isNotNull()).count() == 1
    assert files.read_json(spark, str(tmp_path / "no*.json"), schema, optional=True).count() == 0
    files.write_csv(df.select("id", "v").where("id is not null"), str(tmp_path / "c"), ["id"])
    assert files.read_csv(spark, str(tmp_path / "c")).columns == ["id", "v"]
    assert files.markdown(df.select("id", "v").where("id is not null")) == "| id | v |\n|---|---|\n| 1 | 가 |"
    with pytest.raises(ValueError):
        files.redacted(df, ["abstract"])
    long = "x" * 400
    red = files.redacted(spark.createDataFrame([(long + "!", "10.1/<i>", long)], "kw string, doi string, ab string"), ["ab"], keyword="kw", abstract="ab")
    assert tuple(red.first()) == ("", "")


def test_cache_states(spark):
    cache = spark.createDataFrame([("a", "2024-02-01"), ("b", "2023-01-01")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = {r["k"]: r["state"] for r in files.cache_state(req, cache, "k", "t", F.to_timestamp(F.lit("2024-02-15"))).collect()}
    assert got == {"a": "hit", "b": "expired", "c": "miss"}
    fresh = spark.createDataFrame([("c", True), ("d", False)], "k string, ok boolean").withColumn("t", F.to_timestamp(F.lit("2024-02-15"))).select("k", "t", "ok")
    assert {r["k"] for r in files.put_cache(cache, fresh, "k", "ok").collect()} == {"a", "b", "c"}


def test_paged_source_stops(spark, tmp_path):
    page = "<record>1</record><record>2</record>"
    pages = {"t|a": [page, page, "<record>3</record>", page], "t|b": [page, ""], "t|c": ["!error"]}
    (tmp_path / "p.json").write_text(json.dumps(pages))
    df = paged.harvest(spark, [("t", q) for q in "abcd"], transport="loomspark.sources.paged.FolderTransport", file=str(tmp_path / "p.json"), size="2", pauseMs="0")
    got = {r["q"]: (r["pages"], r["got"], r["bad"]) for r in df.groupBy("q").agg(F.count("*").alias("pages"), F.sum("records").alias("got"), F.count("error").alias("bad")).collect()}
    assert got == {"a": (3, 5, 0), "b": (2, 2, 0), "c": (1, 0, 1), "d": (1, 0, 0)}
    rec = spark.createDataFrame([("x", "t", "a", 1), ("x", "t", "b", 2), ("y", "t", "b", 3)], "arti_id string, field string, q string, pos int")
    log = {r["q"]: r["fresh"] for r in paged.harvest_log(df, rec, rec.where("arti_id = 'none'")).collect()}
    assert log == {"a": 1, "b": 1, "c": 0, "d": 0}
    seen = {r["arti_id"]: (r["first"], r["tags"]) for r in paged.first_seen(rec, "arti_id", "pos", "q").collect()}
    assert seen == {"x": (1, ["a", "b"]), "y": (3, ["b"])}


def test_stream_equals_batch(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet")
    want = windows.tumbling(batch, "ts", "1 day", "event_type", "value").count()
    folder = tmp_path / "in"
    batch.withColumn("ts", F.col("ts").cast("timestamp")).repartition(2).write.parquet(str(folder))
    stream = windows.stream_parquet(spark, str(folder), spark.read.parquet(str(folder)).schema)
    q = windows.tumbling(stream, "ts", "1 day", "event_type", "value", "3650 days").writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert spark.table("tumbled").count() == want
    finally:
        q.stop()
    q = windows.first_seen(stream, "user_id", "ts", "3650 days").writeStream.format("memory").queryName("firsts").start()
    try:
        q.processAllAvailable()
        assert spark.table("firsts").count() == batch.select("user_id").distinct().count() == windows.first_seen(batch, "user_id", "ts").count()
    finally:
        q.stop()


def test_references_by_script_and_field(spark):
    refs = [("제목", "a", "언어 교육"), ("语言", "", "language"), ("title", "x", ""), ("소설", "", "기타지")]
    df = spark.createDataFrame([(1, refs), (2, []), (3, None)], "i int, r array<struct<title:string,author:string,journal:string>>")
    got = {r["i"]: r["p"] for r in df.select("i", markup.reference_profile(F.col("r"), [("edu", "교육"), ("ling", "언어|language")], "rest").alias("p")).collect()}
    assert tuple(got[1])[:5] == (4, 2, 1, 1, 3) and got[1]["fields"] == {"edu": 1, "ling": 1, "rest": 1}
    assert tuple(got[2])[:5] == tuple(got[3])[:5] == (0, 0, 0, 0, 0)
    full = spark.createDataFrame([(DETAIL.replace("<title>T</title>", "<title>T</title><pubilisher>P</pubilisher><url>u</url>"),)], "d string").select(markup.detail_record(F.col("d"), full=True).alias("x")).first()["x"]["references"][0]
    assert (full["publisher"], full["url"], full["type_code"], full["arti_id"]) == ("P", "u", "", "ART1")


def test_only_what_the_cache_lacks_is_asked_for(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"detail|b": ["body b"], "detail|c": ["!error"], "detail|a": ["live a"]}))
    cache = spark.createDataFrame([("a", "old a", "2024-02-01"), ("a", "cached a", "2024-02-10"), ("b", "stale", "2023-01-01")], "k string, body string, t string").withColumn("t", F.to_timestamp("t"))
    ids = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "k string")
    got = {r["k"]: (r["body"], r["error"], r["source"]) for r in paged.cached_first(ids, cache, "k", "body", "t", F.to_timestamp(F.lit("2024-02-15")), transport="loomspark.sources.paged.FolderTransport", file=str(tmp_path / "p.json"), pauseMs="0").collect()}
    assert got == {"a": ("cached a", None, "cache"), "b": ("body b", None, "live"), "c": (None, "page failed", "live")}


def test_one_csv_file_with_one_mark(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 'x "y", z'), ("a", 1, None), ("c", 3, "줄\n바꿈")], "k string, n int, t string").repartition(3)
    assert files.write_csv_file(df, str(tmp_path / "r.csv"), ["k"]) == 3
    raw = (tmp_path / "r.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfk,n,t\n") and raw.count(b"\xef\xbb\xbf") == 1
    assert raw[3:].decode() == 'k,n,t\na,1,\nb,2,"x ""y"", z"\nc,3,"줄\n바꿈"\n'
    assert files.write_csv_file(df.limit(0), str(tmp_path / "e.csv"), bom=False) == 0 and (tmp_path / "e.csv").read_text() == "k,n,t\n"


def test_concepts_from_a_dictionary_file(spark, tmp_path):
    from loomspark.functions import expr as X

    book = {"concepts": [{"id": "2", "name": "writing", "priority": 2, "patterns": ["writing", "쓰기"]}, {"id": "1", "name": "chat", "priority": 1, "patterns": [r"chat\s*-?bot", r"\bgpt\b"]}], "modules": [{"name": "tools", "concepts": ["1"]}]}
    (tmp_path / "c.json").write_text(json.dumps(book), encoding="utf-8")
    rules, modules = files.concept_rules(str(tmp_path / "c.json"))
    df = spark.createDataFrame([(t,) for t in ("Chat bot writing", "my GPT쓰기", "egpts 쓰기", "none")], "t string")
    assert modules == {"tools": ["chat"]} and [r[0] for r in df.select(X.first_match(F.col("t"), rules, "-")).collect()] == ["chat", "chat", "writing", "-"]

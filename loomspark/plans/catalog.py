"""Queries of the reference operators over the test tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import expr as X
from loomspark.functions.scope import portable
from loomspark.functions.text import folded
from loomspark.operators import crosstab, graph, merge, quality, ranking, sampling, stats
from loomspark.session import table
from loomspark.sources import files, paged
from loomspark.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Category orders and rule tables of the coding scheme.
FUNCS = ["쓰기", "말하기", "듣기", "읽기", "문법", "어휘", "발음", "번역", "평가·채점", "리터러시·역량", "문학·문화"]
METHS = ["실험연구", "조사연구", "질적·사례", "개발연구", "성능평가", "문헌·리뷰", "코퍼스분석", "기타·혼합"]
LANGS = ["영어", "한국어", "중국어"]
SCHOOL = r"초등|중학|고등학교|고교|중등|다문화 ?(?:학생|아동)|小学|中学|高中"
UNIVERSITY = r"(?i)대학(?!수학능력)|학부|유학생|교양|전공|학문 목적|大学|本科|university|undergraduate|college"
REASONS = [
    ("제2외국어", "세 언어군 밖 외국어"), ("교육맥락없음", "교육맥락 없는 순수 연구"), ("번역품질", "교육맥락 없는 순수 연구"), ("메타버스VR", "AI 비중심 연구"), ("비AI에듀테크", "AI 비중심 연구"), ("AI신호부재", "AI 비중심 연구"),
    ("언어비특정", "언어 비특정 일반 연구"), ("교양교육", "대학 교양 교육 연구"), ("국어교과담론", "국어 교과 담론형 연구"), ("AI디지털교과서", "AI 디지털교과서 연구"), ("복수언어", "복수언어 연구"), ("기타", "기타"),
]
TAGS = {
    "쓰기": ["쓰기", "작문", "글쓰기", "writing", "composition"], "말하기": ["말하기", "회화", "구어", "speaking", "oral", "conversation"], "발음": ["발음", "성조", "pronunciation", "tone"], "듣기": ["듣기", "청해", "listening"],
    "읽기": ["읽기", "독해", "reading"], "어휘": ["어휘", "단어", "한자", "vocabulary", "lexical"], "문법": ["문법", "grammar"], "번역": ["번역", "통역", "translation", "interpret"],
    "평가·채점": ["평가", "채점", "문항", "assessment", "scoring", "grading", "test item"], "리터러시·역량": ["리터러시", "역량", "literacy", "competenc"], "문학·문화": ["문학", "문화", "소설", "고전", "literature", "culture"],
}
FIELDS = [
    ("교육", r"(?i)교육|교수|학습|교과|교사|수업|리터러시|작문연구|독서연구|educat|learn|teach|pedagog|instruct|curricul|tesol|\bcall\b|recall|computer assisted|language learning|language teaching|second language writing|assessing writing|system$|elt journal|tesl|efl|esl|literacy|school"),
    ("문학", r"(?i)문학|소설|시학|시가|고전|비평|문예|literat|literary|poetry|poetic|文學|文学|詩|诗"),
    ("언어학", r"(?i)언어|어학|국어학|문법|음성|의미|형태|통사|화용|담화|어문|말뭉치|코퍼스|번역|통역|우리말|배달말|한글|국어|영어학|중국어|linguist|language|grammar|phonet|phonolog|semantic|syntax|pragmat|discourse|corpus|translat|interpret|語言|语言|語法|语法|漢語|汉语|中國語|中国语"),
]
# End of fixed values.

#: Concepts of the keywords of the test tables and their modules, this library's own; a dictionary of other data is passed
#: to expr.first_match in the same form.
CONCEPTS = [
    ("chat models", "chatgpt|챗지피티"), ("language models", "generative ai|생성형 ai|language model|언어모델"), ("artificial intelligence", "artificial intelligence|인공지능|ai assisted"), ("scoring", "automated scoring|자동채점|item generation"),
    ("translation", "machine translation|기계번역|번역기"), ("voice", "tts/stt|speech synthesis|음성합성|pronunciation|발음"), ("dialogue", "virtual interlocutor|가상 대화자|dialogue agent|smart speaker|챗봇"), ("texts", "text difficulty|digital textbook|디지털 교재|learning log|학습 로그"),
]
MODULES = {"models": ["chat models", "language models", "artificial intelligence"], "speech": ["voice", "dialogue"], "text": ["scoring", "translation", "texts"]}

#: One row per paper, latest harvest, categories folded.
FACT = r"""fact AS (
  SELECT arti_id, pub_year, journal, kci_field, title_ko, title_en, authors, kw_ko, kw_en, TRY_CAST(cited AS INTEGER) AS cited, doi, permalink, prev_include, include, learner, func, focus, tool, boundary, confidence,
    regexp_replace(nfc_normalize(lang_group), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS lang, regexp_replace(nfc_normalize(meth), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS meth,
    translate(regexp_replace(nfc_normalize(reason), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), 'ＡＩＶＲ', 'AIVR') AS reason
  FROM (SELECT DISTINCT ON (arti_id) * FROM papers WHERE arti_id IS NOT NULL ORDER BY arti_id, harvested_at DESC)
)"""
_COLUMNS = ("pub_year", "journal", "kci_field", "title_ko", "title_en", "authors", "kw_ko", "kw_en", "cited", "doi", "permalink", "prev_include", "include", "learner", "func", "focus", "tool", "boundary", "confidence", "lang_group", "meth", "reason")


def fact(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per paper with the named columns (lang for lang_group), categories folded."""
    need = [{"lang": "lang_group"}.get(c, c) for c in columns]
    src = table(spark, d, "papers").where("arti_id is not null")
    one = merge.latest(src, ["arti_id"], "harvested_at", need)
    pick = {"lang": lambda: folded("lang_group"), "meth": lambda: folded("meth"), "reason": lambda: folded("reason"), "cited": lambda: F.expr("try_cast(cited AS int)")}
    return one.select("arti_id", *(pick[c]().alias(c) if c in pick else F.col(c) for c in columns))


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _list(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def _values(xs, name: str) -> str:
    return f"(SELECT unnest([{_list(xs)}]) AS {name})"


# --- counts and shares -------------------------------------------------------------------------------------------


@query(f"""WITH {FACT}, last AS (SELECT id, arg_max(include, judged_at) AS verdict FROM verdicts GROUP BY id),
j AS (SELECT coalesce(nullif(f.lang, ''), '(none)') AS lang, coalesce(l.verdict, '') AS verdict FROM fact f LEFT JOIN last l ON l.id = f.arti_id),
c AS (SELECT lang, verdict, count(*) AS n FROM j GROUP BY 1, 2)
SELECT lang, verdict, n, round(100.0 * n / sum(n) OVER (PARTITION BY lang), 4) AS pct FROM c""")
def include_by_group(spark, d):
    """Papers joined to their latest verdict, counted by language and verdict, with the share in the language."""
    verdicts = table(spark, d, "verdicts").groupBy("id").agg(F.max_by("include", "judged_at").alias("verdict"))
    joined = fact(spark, d, "lang").join(verdicts.withColumnRenamed("id", "arti_id"), "arti_id", "left")
    rows = joined.select(F.coalesce(X.blank_to_null(F.col("lang")), F.lit("(none)")).alias("lang"), F.coalesce("verdict", F.lit("")).alias("verdict"))
    return crosstab.group_shares(rows, ["lang", "verdict"], ["lang"])


@query(f"""WITH {FACT}, c AS (SELECT func, meth, count(*) AS n FROM fact WHERE include = 'Y' GROUP BY 1, 2)
SELECT r.func, k.meth, coalesce(c.n, 0) AS n FROM {_values(FUNCS, 'func')} r CROSS JOIN {_values(METHS, 'meth')} k LEFT JOIN c ON c.func = r.func AND c.meth = k.meth""")
def crosstab_dense(spark, d):
    return crosstab.dense_crosstab(fact(spark, d, "include", "func", "meth").where("include = 'Y'"), "func", "meth", FUNCS, METHS)


@query("""SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN '(all)' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN grouping(o_orderpriority) = 1 THEN '(all)' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def cube_totals(spark, d):
    return crosstab.with_totals(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query(f"""WITH {FACT}, m(reason, label) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in REASONS)})
SELECT coalesce(m.label, '(other)') AS label, count(*) AS n FROM fact f LEFT JOIN m USING (reason) WHERE f.include <> 'Y' GROUP BY 1""")
def category_rollup(spark, d):
    return crosstab.roll_up(fact(spark, d, "include", "reason").where("include <> 'Y'"), "reason", REASONS, "(other)")


@query(f"""WITH {FACT}, c AS (SELECT CASE WHEN pub_year <= 2022 THEN 'to 2022' ELSE 'from 2023' END AS period, meth, count(*) AS n FROM fact WHERE include = 'Y' AND pub_year IS NOT NULL AND meth <> '' GROUP BY 1, 2)
SELECT period, meth, n, round(100.0 * n / sum(n) OVER (PARTITION BY period), 4) AS pct FROM c""")
def period_shares(spark, d):
    rows = fact(spark, d, "include", "pub_year", "meth").where("include = 'Y' and pub_year is not null and meth <> ''")
    return crosstab.group_shares(rows.withColumn("period", F.when(F.col("pub_year") <= 2022, "to 2022").otherwise("from 2023")), ["period", "meth"], ["period"])


@query(f"""WITH {FACT} SELECT lang, count(*) FILTER (WHERE meth IN ('개발연구', '성능평가')) AS bundled, count(*) AS n, round(100.0 * count(*) FILTER (WHERE meth IN ('개발연구', '성능평가')) / count(*), 4) AS pct
FROM fact WHERE include = 'Y' AND lang <> '' GROUP BY lang""")
def bundle_share(spark, d):
    return crosstab.bundle_share(fact(spark, d, "include", "lang", "meth").where("include = 'Y' and lang <> ''"), "lang", "meth", ["개발연구", "성능평가"])


@query(f"""WITH {FACT}, c AS (SELECT lang, func, meth, count(*) AS n FROM fact WHERE include = 'Y' AND func <> '기능비특정' AND meth IS NOT NULL AND lang <> '' GROUP BY 1, 2, 3) SELECT lang, count(*) AS occupied, sum(n)::BIGINT AS n FROM c GROUP BY lang""")
def occupied_cells(spark, d):
    return crosstab.occupied_cells(fact(spark, d, "include", "lang", "func", "meth").where("include = 'Y' and func <> '기능비특정' and meth is not null and lang <> ''"), "lang", ["func", "meth"])


@query(f"""WITH {FACT}, c AS (SELECT func, meth, count(*) FILTER (WHERE lang = '중국어') AS own, count(*) FILTER (WHERE coalesce(lang, '') <> '중국어') AS lead FROM fact WHERE include = 'Y' GROUP BY 1, 2),
g AS (SELECT r.func, k.meth, coalesce(c.own, 0) AS own, coalesce(c.lead, 0) AS lead FROM {_values(FUNCS, 'func')} r CROSS JOIN {_values(METHS, 'meth')} k LEFT JOIN c ON c.func = r.func AND c.meth = k.meth)
SELECT t.threshold, CASE WHEN own > 0 THEN 'occupied' WHEN lead >= t.threshold THEN 'gap' WHEN lead > 0 THEN 'thin' ELSE 'empty' END AS kind, count(*) AS cells FROM g CROSS JOIN (SELECT unnest([5, 10, 15, 20]) AS threshold) t GROUP BY 1, 2""")
def gap_kind_thresholds(spark, d):
    rows = fact(spark, d, "include", "lang", "func", "meth").where("include = 'Y'")
    return crosstab.gap_types(rows, "lang", "중국어", "func", "meth", FUNCS, METHS, [5, 10, 15, 20])


@query(f"""WITH {FACT} SELECT pub_year, count(*) AS n, sum(count(*)) OVER (ORDER BY pub_year)::BIGINT AS so_far FROM fact WHERE pub_year IS NOT NULL GROUP BY pub_year""")
def year_histogram(spark, d):
    from pyspark.sql import Window

    n = fact(spark, d, "pub_year").where("pub_year is not null").groupBy("pub_year").agg(F.count("*").alias("n"))
    return n.withColumn("so_far", F.sum("n").over(Window.orderBy("pub_year")))  # one row per year


@query("""SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(100.0 * avg(CASE WHEN value = 0 THEN 1 ELSE 0 END), 4) AS zero_pct, round(stddev_pop(value), 6) AS sd FROM events GROUP BY event_type""")
def value_summary(spark, d):
    v, e = F.col("value"), table(spark, d, "events").select("event_type", "value")
    median = ranking.exact_median(e, "event_type", "value").select("event_type", F.round("median", 6).alias("median"))
    out = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(v), 2).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.round(100.0 * F.avg((v == 0).cast("int")), 4).alias("zero_pct"), F.round(F.stddev_pop(v), 6).alias("sd"))
    return out.join(median, "event_type", "left")


@query(f"""WITH {FACT}, a AS (SELECT lang, avg(coalesce(cited, 0)) AS mean FROM fact WHERE include = 'Y' AND lang IN ({_list(LANGS)}) GROUP BY lang)
SELECT round(max(mean) FILTER (WHERE lang = '영어'), 6) AS lead_mean, round(max(mean) FILTER (WHERE lang = '중국어'), 6) AS small_mean, round(max(mean) FILTER (WHERE lang = '영어') / max(mean) FILTER (WHERE lang = '중국어'), 6) AS ratio FROM a""")
def cohort_ratio(spark, d):
    a = fact(spark, d, "include", "lang", "cited").where(F.col("lang").isin(*LANGS) & (F.col("include") == "Y")).groupBy("lang").agg(F.avg(F.coalesce("cited", F.lit(0))).alias("mean"))
    of = lambda g: F.max(F.when(F.col("lang") == g, F.col("mean")))
    return a.agg(F.round(of("영어"), 6).alias("lead_mean"), F.round(of("중국어"), 6).alias("small_mean"), F.round(F.try_divide(of("영어"), of("중국어")), 6).alias("ratio"))


# --- joins and merges --------------------------------------------------------------------------------------------

_LAST_VERDICT = "last AS (SELECT id, arg_max(include, judged_at) AS include, arg_max(boundary, judged_at) AS boundary, arg_max(confidence, judged_at) AS confidence, arg_max(note, judged_at) AS note FROM verdicts GROUP BY id)"


def _last_verdict(spark, d):
    return table(spark, d, "verdicts").groupBy("id").agg(*(F.max_by(c, "judged_at").alias(c) for c in ("include", "boundary", "confidence")))


@query(f"""WITH {FACT}, {_LAST_VERDICT}, one AS (SELECT f.arti_id, CASE WHEN l.include = 'N' AND l.confidence = 'high' THEN 'N' ELSE f.include END AS include, CASE WHEN l.include = 'N' AND l.confidence = 'high' THEN '' ELSE f.func END AS func, f.func AS before, l.boundary FROM fact f LEFT JOIN last l ON l.id = f.arti_id)
SELECT arti_id, CASE WHEN include = 'N' AND boundary = 'Y' AND before <> '' THEN 'Y' ELSE include END AS include, CASE WHEN include = 'N' AND boundary = 'Y' AND before <> '' THEN before ELSE func END AS func FROM one""")
def merge_patch(spark, d):
    """Two ordered updates: confident exclusions blank the function; boundary cases are restored from the snapshot."""
    base = fact(spark, d, "include", "func")
    snapshot = base.select("arti_id", F.col("func").alias("before"))
    verdicts = _last_verdict(spark, d).withColumnRenamed("id", "arti_id")
    sure = (F.col("u.include") == "N") & (F.col("u.confidence") == "high")
    out = merge.update_from(base, verdicts, "arti_id", sure, {"include": F.lit("N"), "func": F.lit("")})
    restore = verdicts.select("arti_id", "boundary").join(snapshot, "arti_id")
    again = (F.col("b.include") == "N") & (F.col("u.boundary") == "Y") & (F.col("u.before") != "")
    return merge.update_from(out, restore, "arti_id", again, {"include": F.lit("Y"), "func": F.col("u.before")})


@query("""WITH a AS (SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_acctbal > 0), b AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal < 5000)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(nullif(a.c_name, ''), b.c_name) AS c_name, coalesce(nullif(a.c_mktsegment, ''), b.c_mktsegment) AS c_mktsegment, CASE WHEN b.c_custkey IS NULL THEN 'base' WHEN a.c_custkey IS NULL THEN 'new' ELSE 'both' END AS src FROM a FULL JOIN b ON a.c_custkey = b.c_custkey""")
def upsert_provenance(spark, d):
    """Customers in credit, a segment of them blank, and customers below a balance: two overlapping ranges that hold all
    customers between them."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    base = c.where("c_acctbal > 0").select("c_custkey", "c_name", F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return merge.upsert(base, c.where("c_acctbal < 5000").drop("c_acctbal"), "c_custkey")


@query(f"""WITH {FACT}, {_LAST_VERDICT}, l AS (SELECT * FROM last WHERE id IS NOT NULL)
SELECT coalesce(f.arti_id, l.id) AS arti_id, coalesce(nullif(f.include, ''), l.include) AS include, coalesce(nullif(f.confidence, ''), l.confidence) AS confidence, coalesce(nullif(f.boundary, ''), l.boundary) AS boundary, CASE WHEN l.id IS NULL THEN 'base' WHEN f.arti_id IS NULL THEN 'new' ELSE 'both' END AS src FROM fact f FULL JOIN l ON l.id = f.arti_id""")
def upsert_verdicts(spark, d):
    """All papers and all judged ids: what a paper leaves blank comes from its latest verdict."""
    verdicts = _last_verdict(spark, d).where("id is not null").withColumnRenamed("id", "arti_id")
    return merge.upsert(fact(spark, d, "include", "confidence", "boundary"), verdicts, "arti_id")


@query("""SELECT 'with' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1995) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1995 AND o_custkey IS NOT NULL)""")
def anti_semi(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    o = table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & (F.year("o_orderdate") == 1995)).select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").agg(F.lit("with").alias("kind"), F.count("*").alias("n")).unionByName(c.join(o, "c_custkey", "left_anti").agg(F.lit("without").alias("kind"), F.count("*").alias("n")))


@query(f"""WITH {FACT}, {_LAST_VERDICT} SELECT f.arti_id, coalesce(l.confidence, 'none') AS confidence, coalesce(l.boundary, 'N') AS boundary FROM fact f LEFT JOIN last l ON l.id = f.arti_id""")
def cache_defaults(spark, d):
    return merge.left_with_default(fact(spark, d), _last_verdict(spark, d).withColumnRenamed("id", "arti_id"), "arti_id", {"confidence": "none", "boundary": "N"})


@query("""WITH k AS (SELECT arti_id, harvested_at, cited, kw_en FROM papers WHERE arti_id IS NOT NULL), a AS (SELECT DISTINCT ON (arti_id) * FROM k ORDER BY arti_id, harvested_at), b AS (SELECT DISTINCT ON (arti_id) * FROM k ORDER BY arti_id, harvested_at DESC)
SELECT a.arti_id, 'cited' AS field, a.cited AS before, b.cited AS after FROM a JOIN b USING (arti_id) WHERE a.cited IS DISTINCT FROM b.cited UNION ALL SELECT a.arti_id, 'kw_en', a.kw_en, b.kw_en FROM a JOIN b USING (arti_id) WHERE a.kw_en IS DISTINCT FROM b.kw_en""")
def snapshot_diff(spark, d):
    src = table(spark, d, "papers").where("arti_id is not null")
    return merge.compare(merge.keep_first(src, ["arti_id"], "harvested_at", ["cited", "kw_en"]), merge.latest(src, ["arti_id"], "harvested_at", ["cited", "kw_en"]), "arti_id", ["cited", "kw_en"])


@query(f"""WITH {FACT} SELECT coalesce(prev_include, '') AS before, coalesce(include, '') AS after, count(*) AS n FROM fact GROUP BY 1, 2""")
def change_matrix(spark, d):
    return merge.change_matrix(fact(spark, d, "prev_include", "include"), "prev_include", "include")


@query("""SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY text""")
def dedup_keep_first(spark, d):
    src = table(spark, d, "documents").where("text is not null and text <> ''").select("text", "doc_id")
    first = src.groupBy(F.md5("text").alias("h")).agg(F.min(F.struct("doc_id", "text")).alias("first"))  # a key of 128 bits, not the text
    return first.select("first.doc_id", "first.text")


# --- ranking, sets, formats --------------------------------------------------------------------------------------


@query(f"""WITH {FACT}, r AS (SELECT arti_id, cited, rank() OVER (ORDER BY cited DESC)::INTEGER AS rank FROM fact WHERE cited IS NOT NULL) SELECT arti_id, cited, rank FROM r WHERE rank <= 10""")
def topk_with_ties(spark, d):
    return ranking.top_with_ties(fact(spark, d, "cited"), "cited", 10).select("arti_id", "cited", "rank")


@query(f"""WITH {FACT}, c AS (SELECT lang, coalesce(nullif(split_part(kci_field, ' > ', 2), ''), '(none)') AS field, count(*) AS n FROM fact WHERE include = 'Y' AND lang <> '' GROUP BY 1, 2), s AS (SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY lang), 4) AS pct, row_number() OVER (PARTITION BY lang ORDER BY n DESC, field) AS pos FROM c)
SELECT lang, field, n, pct, pos::INTEGER AS pos FROM s WHERE pos <= 6""")
def field_top6(spark, d):
    rows = fact(spark, d, "include", "lang", "kci_field").where("include = 'Y' and lang <> ''").select("lang", X.level(F.col("kci_field"), 2, "(none)").alias("field"))
    return ranking.top_per_group(crosstab.group_shares(rows, ["lang", "field"], ["lang"]), "lang", "field", "n", 6)


@query(f"""WITH {FACT}, c AS (SELECT meth, count(*) AS n FROM fact WHERE meth IN ({_list(METHS)}) GROUP BY meth) SELECT list_position([{_list(METHS)}], meth)::INTEGER AS place, meth, n FROM c ORDER BY place""")
def enum_order(spark, d):
    n = fact(spark, d, "meth").where(F.col("meth").isin(*METHS)).groupBy("meth").agg(F.count("*").alias("n"))
    return n.select(ranking.in_enum_order("meth", METHS).cast("int").alias("place"), "meth", "n").orderBy("place")


_KW = r"""kws AS (SELECT arti_id, lang, pub_year, trim(regexp_replace(lower(trim(regexp_replace(raw, '[\s\p{Z}\x{85}\x{1c}-\x{1f}]+', ' ', 'g'))), '[·\-–—]+', ' ', 'g')) AS kw FROM (SELECT arti_id, lang, pub_year, unnest(regexp_split_to_array(concat_ws(';', kw_ko, kw_en), '[;,]')) AS raw FROM fact WHERE include = 'Y' AND lang IN ('영어', '한국어', '중국어'))), kw AS (SELECT * FROM kws WHERE length(kw) > 1)"""


def _keywords(spark, d):
    rows = fact(spark, d, "include", "lang", "pub_year", "kw_ko", "kw_en").where((F.col("include") == "Y") & F.col("lang").isin(*LANGS))
    return rows.select("arti_id", "lang", "pub_year", F.explode(X.split_keywords(F.col("kw_ko"), F.col("kw_en"))).alias("kw"))


@query(f"""WITH {FACT}, {_KW} SELECT concat_ws('+', CASE WHEN e THEN '영어' END, CASE WHEN k THEN '한국어' END, CASE WHEN z THEN '중국어' END) AS present_in, count(*) AS items FROM (SELECT kw, bool_or(lang = '영어') AS e, bool_or(lang = '한국어') AS k, bool_or(lang = '중국어') AS z FROM kw GROUP BY kw) GROUP BY 1""")
def shared_keys(spark, d):
    return ranking.overlap(_keywords(spark, d), "kw", "lang", LANGS)


@query(f"""WITH {FACT}, {_KW} SELECT count(*) AS entries, count(DISTINCT kw) AS forms, count(DISTINCT arti_id) AS papers FROM kw""")
def keyword_forms(spark, d):
    return _keywords(spark, d).agg(F.count("*").alias("entries"), F.count_distinct("kw").alias("forms"), F.count_distinct("arti_id").alias("papers"))


@query(f"""WITH {FACT}, {_KW}, c AS (SELECT lang, kw, count(*) AS n FROM kw GROUP BY 1, 2), s AS (SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY lang), 4) AS pct, row_number() OVER (PARTITION BY lang ORDER BY n DESC, kw) AS pos FROM c) SELECT lang, kw, n, pct, pos::INTEGER AS pos FROM s WHERE pos <= 6""")
def keyword_top6(spark, d):
    return ranking.top_per_group(crosstab.group_shares(_keywords(spark, d), ["lang", "kw"], ["lang"]), "lang", "kw", "n", 6)


_CASE = "CASE " + " ".join(f"WHEN regexp_matches(kw, '{p}') THEN '{c}'" for c, p in CONCEPTS) + " ELSE kw END"


@query(f"""WITH {FACT}, {_KW} SELECT {_CASE} AS concept, lang, min(pub_year) AS first_year, count(DISTINCT arti_id) AS papers FROM kw WHERE pub_year IS NOT NULL GROUP BY 1, 2""")
def concept_first_year(spark, d):
    k = _keywords(spark, d).where("pub_year is not null").withColumn("concept", X.first_match(F.col("kw"), CONCEPTS, F.col("kw")))
    return stats.first_year(k, ["concept", "lang"], "pub_year", "arti_id")


@query(f"""WITH {FACT}, {_KW}, f AS (SELECT {_CASE} AS concept, lang, min(pub_year) AS y FROM kw WHERE pub_year IS NOT NULL GROUP BY 1, 2), m(module, concept) AS (VALUES {', '.join(f"('{m}', '{c}')" for m, cs in MODULES.items() for c in cs)}) SELECT m.module, f.lang, min(f.y) AS first_year, count(*) AS concepts FROM f JOIN m USING (concept) GROUP BY 1, 2""")
def module_first_year(spark, d):
    modules = spark.createDataFrame(list(MODULES.items()), "module string, concepts array<string>").select("module", F.explode("concepts").alias("concept"))
    firsts = concept_first_year(spark, d)
    return firsts.join(F.broadcast(modules), "concept").groupBy("module", "lang").agg(F.min("first_year").alias("first_year"), F.count("*").alias("concepts"))


@query(f"""WITH {FACT}, {_KW}, f AS (SELECT kw, lang, min(pub_year) AS y FROM kw WHERE pub_year IS NOT NULL GROUP BY 1, 2), l AS (SELECT b.y - a.y AS lag FROM f a JOIN f b ON a.kw = b.kw AND a.lang = '영어' AND b.lang = '한국어') SELECT count(*) AS shared, count(*) FILTER (WHERE lag > 0) AS later, count(*) FILTER (WHERE lag < 0) AS earlier, count(*) FILTER (WHERE lag = 0) AS same, median(lag)::DOUBLE AS median_lag FROM l""")
def key_first_lag(spark, d):
    firsts = _keywords(spark, d).where("pub_year is not null").groupBy("kw", "lang").agg(F.min("pub_year").alias("first_year"))
    return stats.lag_between(firsts, "kw", "lang", "영어", "한국어")


@query("""WITH v AS (SELECT DISTINCT id FROM verdicts WHERE id IS NOT NULL), p AS (SELECT DISTINCT arti_id AS id FROM papers WHERE arti_id IS NOT NULL) SELECT count(*) FILTER (WHERE p.id IS NULL) AS only_a, count(*) FILTER (WHERE v.id IS NULL) AS only_b, count(*) FILTER (WHERE p.id IS NULL OR v.id IS NULL) = 0 AS equal FROM v FULL JOIN p ON v.id = p.id""")
def same_ids(spark, d):
    return ranking.same_set(table(spark, d, "verdicts").select("id").where("id is not null"), table(spark, d, "papers").select(F.col("arti_id").alias("id")).where("id is not null"), "id")


# --- tests, agreement ----------------------------------------------------------------------------------------------

_LGC = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


def _lgc(n: str, k: str) -> str:
    return _LGC.format(n=n, k=k)


@query(f"""WITH {FACT}, b AS (SELECT meth, lang FROM fact WHERE include = 'Y' AND meth <> '' AND lang IN ('영어', '중국어')),
t AS (SELECT meth, count(*) FILTER (WHERE lang = '중국어') AS k, count(*) AS big_k FROM b GROUP BY meth), s AS (SELECT t.*, (SELECT count(*) FROM b) AS big_n, (SELECT count(*) FROM b WHERE lang = '중국어') AS n, count(*) OVER () AS tests FROM t),
e AS (SELECT *, unnest(range(greatest(0, n + big_k - big_n), least(big_k, n) + 1)) AS i FROM s),
p AS (SELECT meth, k, big_k, big_n, n, tests, sum(CASE WHEN i <= k THEN exp({_lgc('big_k', 'i')} + {_lgc('(big_n - big_k)', '(n - i)')} - {_lgc('big_n', 'n')}) ELSE 0 END) AS p_le, sum(CASE WHEN i >= k THEN exp({_lgc('big_k', 'i')} + {_lgc('(big_n - big_k)', '(n - i)')} - {_lgc('big_n', 'n')}) ELSE 0 END) AS p_ge FROM e GROUP BY ALL),
q AS (SELECT *, n * big_k / big_n AS expected, CASE WHEN k < n * big_k / big_n THEN least(1, p_le) ELSE least(1, p_ge) END AS p FROM p)
SELECT meth, k, big_k, n, big_n, round(expected, 6) AS expected, round(p_le, 6) AS p_le, round(p_ge, 6) AS p_ge, round(p, 6) AS p_side, CASE WHEN p < 0.05 / tests THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS mark FROM q""")
def hypergeom_tail(spark, d):
    b = fact(spark, d, "include", "lang", "meth").where("include = 'Y' and meth <> '' and lang in ('영어', '중국어')")
    t = b.groupBy("meth").agg(F.count_if(F.col("lang") == "중국어").alias("k"), F.count("*").alias("big_k"))
    total = t.agg(F.sum("big_k").alias("big_n"), F.sum("k").alias("n"), F.count("*").alias("tests"))
    out = stats.hypergeometric_tails(t.crossJoin(F.broadcast(total)), "big_k", "big_n", "n", "k")  # one row of totals
    return out.select("meth", "k", "big_k", "n", "big_n", *(F.round(c, 6).alias(c) for c in ("expected", "p_le", "p_ge", "p_side")), stats.significance(F.col("p_side"), F.col("tests")).alias("mark"))


@query(f"""WITH {FACT}, c AS (SELECT lang, func, meth, count(*) AS c FROM fact WHERE include = 'Y' AND lang IN ({_list(LANGS)}) AND func <> '기능비특정' AND meth IS NOT NULL GROUP BY 1, 2, 3), t AS (SELECT lang, sum(c) AS total FROM c GROUP BY lang)
SELECT c.lang, round(sum(1 - CASE WHEN total - c < 12 THEN 0 ELSE exp({_lgc('(total - c)', '12')} - {_lgc('total', '12')}) END), 6) AS expected FROM c JOIN t USING (lang) WHERE total >= 12 GROUP BY c.lang""")
def expected_occupancy(spark, d):
    rows = fact(spark, d, "include", "lang", "func", "meth").where(F.col("lang").isin(*LANGS) & F.expr("include = 'Y' and func <> '기능비특정' and meth is not null"))
    cells = rows.groupBy("lang", "func", "meth").agg(F.count("*").alias("c"))
    return stats.expected_occupancy(cells, "lang", 12).select("lang", F.round("expected", 6).alias("expected"))


_DRAWS = f"""d AS (SELECT lang, arti_id, func, meth, rep, row_number() OVER (PARTITION BY lang, rep ORDER BY md5(concat_ws('|', '20260930', rep, arti_id))) AS r FROM fact CROSS JOIN (SELECT unnest(range(1, 51)) AS rep) WHERE include = 'Y' AND lang IN ({_list(LANGS)}) AND func <> '기능비특정' AND meth IS NOT NULL), s AS (SELECT lang, rep, count(DISTINCT (func, meth)) AS cells FROM d WHERE r <= 12 GROUP BY 1, 2)"""


def _draws(spark, d):
    rows = fact(spark, d, "include", "lang", "func", "meth").where(F.col("lang").isin(*LANGS) & F.expr("include = 'Y' and func <> '기능비특정' and meth is not null"))
    return sampling.occupancy(sampling.simple_draws(rows, "lang", "arti_id", 12, 50, 20260930), "lang", ["func", "meth"])


@query(f"""WITH {FACT}, {_DRAWS}, a AS (SELECT lang, list_sort(list(cells)) AS v, count(*) AS n, avg(cells) AS m, stddev_pop(cells) AS sd FROM s GROUP BY lang)
SELECT lang, n, round(m, 6) AS mean, round(sd, 6) AS sd, v[(n // 2) + 1] AS median, v[floor(n * 0.025)::INT + 1] AS lo, v[least(n - 1, floor(n * 0.975))::INT + 1] AS hi, v[floor(n * 0.05)::INT + 1] AS p05, v[greatest(0, floor(n * 0.95) - 1)::INT + 1] AS p95 FROM a""")
def rarefaction_md5(spark, d):
    """Distinct cells among 12 papers, 50 draws per language: mean, deviation and empirical bounds."""
    return ranking.quantiles(_draws(spark, d), ["lang"], "cells", 50)


@query(f"""WITH {FACT}, {_DRAWS} SELECT lang, round(100.0 * avg(CASE WHEN cells <= 10 THEN 1 ELSE 0 END), 6) AS percentile FROM s GROUP BY lang""")
def occupancy_percentile(spark, d):
    return ranking.percentile_rank(_draws(spark, d), ["lang"], "cells", F.lit(10))


@query(f"""WITH {FACT}, f AS (SELECT * FROM fact WHERE lang IN ({_list(LANGS)})), sizes AS (SELECT lang, count(*) AS size FROM f WHERE lang <> '중국어' GROUP BY lang), b AS (SELECT *, size * 200 // sum(size) OVER () AS base, size * 200 % sum(size) OVER () AS rest FROM sizes), q AS (SELECT lang, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang) <= 200 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b),
r AS (SELECT lang, arti_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', '20261001', 0, arti_id))) AS pos FROM f) SELECT r.arti_id, r.lang FROM r LEFT JOIN q USING (lang) WHERE r.lang = '중국어' OR r.pos <= q.quota""")
def stratified_sample(spark, d):
    """200 papers by largest-remainder quota over the large languages, the small language whole."""
    return sampling.stratified(fact(spark, d, "lang").where(F.col("lang").isin(*LANGS)), "lang", "arti_id", 200, 20261001, ["중국어"])


def _last_codings(spark, d):
    c = table(spark, d, "codings").where(F.col("include").isNotNull() & F.col("id").isNotNull() & F.col("coder").isNotNull())
    c = c.select("id", "coder", "coded_at", F.upper(F.substring(X.trimmed(F.col("include")), 1, 1)).alias("include"), folded("func").alias("func"), folded("meth").alias("meth"))
    return c.groupBy("id", "coder").agg(F.max_by(F.struct("include", "func", "meth"), "coded_at").alias("r"))


def _per_axis(pair: DataFrame, *keys: str) -> DataFrame:
    """(keys, axis, a, b) of pairs of answers a and b; the axes other than include where both say Y."""
    both = (F.col("a.include") == "Y") & (F.col("b.include") == "Y")
    axis = lambda n, when: F.when(when, F.struct(F.lit(n).alias("axis"), F.col(f"a.{n}").alias("a"), F.col(f"b.{n}").alias("b")))
    return pair.select(*keys, F.explode(F.array_compact(F.array(axis("include", F.lit(True)), axis("func", both), axis("meth", both)))).alias("x")).select(*keys, "x.*")


def _all_coder_pairs(spark, d):
    """Of every two coders of a paper, the lesser name first; a paper has few coders, so their answers are one array."""
    papers = _last_codings(spark, d).groupBy("id").agg(F.collect_list(F.struct("coder", "r")).alias("all"))
    one = papers.select("id", "all", F.explode("all").alias("x"))
    two = one.select("id", "x", F.explode(F.filter("all", lambda y: y["coder"] > F.col("x.coder"))).alias("y"))
    pair = two.select("id", F.col("x.coder").alias("coder_a"), F.col("y.coder").alias("coder_b"), F.col("x.r").alias("a"), F.col("y.r").alias("b"))
    return _per_axis(pair, "id", "coder_a", "coder_b")


_CODED_ALL = r"""last AS (SELECT id, coder, arg_max(row(upper(left(regexp_replace(include, '^[\s\p{Z}]+', ''), 1)), regexp_replace(nfc_normalize(func), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), regexp_replace(nfc_normalize(meth), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), coded_at) AS r FROM codings WHERE include IS NOT NULL AND id IS NOT NULL AND coder IS NOT NULL GROUP BY 1, 2),
pair AS (SELECT a.id, a.coder AS coder_a, b.coder AS coder_b, a.r[1] AS ai, b.r[1] AS bi, a.r[2] AS af, b.r[2] AS bf, a.r[3] AS am, b.r[3] AS bm FROM last a JOIN last b ON a.id = b.id AND a.coder < b.coder),
long AS (SELECT id, coder_a, coder_b, 'include' AS axis, ai AS a, bi AS b FROM pair UNION ALL SELECT id, coder_a, coder_b, 'func', af, bf FROM pair WHERE ai = 'Y' AND bi = 'Y' UNION ALL SELECT id, coder_a, coder_b, 'meth', am, bm FROM pair WHERE ai = 'Y' AND bi = 'Y')"""


@query(f"""WITH {_CODED_ALL}, l AS (SELECT * FROM long WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT axis, coder_a, coder_b, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS po FROM l GROUP BY ALL), x AS (SELECT axis, coder_a, coder_b, a AS v, count(*) AS x FROM l GROUP BY ALL), y AS (SELECT axis, coder_a, coder_b, b AS v, count(*) AS y FROM l GROUP BY ALL), e AS (SELECT axis, coder_a, coder_b, sum(x * y) AS xy FROM x JOIN y USING (axis, coder_a, coder_b, v) GROUP BY ALL), k AS (SELECT n.*, coalesce(xy, 0) / (n * n) AS pe FROM n LEFT JOIN e USING (axis, coder_a, coder_b))
SELECT axis, coder_a, coder_b, n, round(po, 6) AS po, round(pe, 6) AS pe, round(CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM k""")
def kappa_pairs(spark, d):
    """Kappa of every two coders that share a paper."""
    k = stats.kappa(_all_coder_pairs(spark, d), ["axis", "coder_a", "coder_b"], "a", "b")
    return k.select("axis", "coder_a", "coder_b", "n", *(F.round(c, 6).alias(c) for c in ("po", "pe", "kappa")))


@query(f"""WITH {_CODED_ALL} SELECT axis, id, coder_a, coder_b, a, b FROM long WHERE a <> b""")
def pair_disagreements(spark, d):
    return _all_coder_pairs(spark, d).where("a <> b").select("axis", "id", "coder_a", "coder_b", "a", "b")


@query(f"""WITH {FACT}, {_CODED_ALL} SELECT coalesce(nullif(f.lang, ''), '(none)') AS lang, count(*) AS n, count(*) FILTER (WHERE a = b) AS same FROM long JOIN fact f ON f.arti_id = long.id WHERE axis = 'include' GROUP BY 1""")
def pair_agreement_by_group(spark, d):
    """Agreement on inclusion by language, over the pairs of all coders."""
    p = _all_coder_pairs(spark, d).where("axis = 'include'").withColumnRenamed("id", "arti_id").join(fact(spark, d, "lang"), "arti_id")
    return p.groupBy(F.coalesce(X.blank_to_null(F.col("lang")), F.lit("(none)")).alias("lang")).agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))


@query(f"""WITH {FACT}, {_CODED_ALL}, s AS (SELECT coder_a, coder_b, 'first' AS scenario, a AS meth FROM long WHERE axis = 'meth' UNION ALL SELECT coder_a, coder_b, 'second', b FROM long WHERE axis = 'meth'), z AS (SELECT coder_a, coder_b, scenario, meth, count(*) AS k FROM s WHERE meth <> '' GROUP BY ALL), t AS (SELECT coder_a, coder_b, scenario, sum(k) AS n FROM z GROUP BY ALL), p AS (SELECT meth, count(*) AS big_k FROM fact WHERE include = 'Y' AND meth <> '' GROUP BY meth), q AS (SELECT sum(big_k) AS big_n FROM p)
SELECT z.coder_a, z.coder_b, z.scenario, p.meth, z.k, p.big_k, round(t.n * p.big_k / q.big_n, 6) AS expected, CASE WHEN z.k < t.n * p.big_k / q.big_n THEN 'under' ELSE 'over' END AS side FROM z JOIN t USING (coder_a, coder_b, scenario) JOIN p ON p.meth = z.meth CROSS JOIN q""")
def pair_substitution(spark, d):
    """Counts of either coder of a pair against the pool: which categories are on another side by the other's labels."""
    by = ["coder_a", "coder_b", "scenario"]
    pairs = _all_coder_pairs(spark, d).where("axis = 'meth'")
    both = pairs.select("coder_a", "coder_b", F.explode(F.array(F.struct(F.lit("first").alias("scenario"), F.col("a").alias("meth")), F.struct(F.lit("second").alias("scenario"), F.col("b").alias("meth")))).alias("s")).select("coder_a", "coder_b", "s.*").where("meth <> ''")
    z = both.groupBy(*by, "meth").agg(F.count("*").alias("k"))
    p = fact(spark, d, "include", "meth").where("include = 'Y' and meth <> ''").groupBy("meth").agg(F.count("*").alias("big_k"))
    out = z.join(z.groupBy(*by).agg(F.sum("k").alias("n")), by).join(p, "meth").crossJoin(F.broadcast(p.agg(F.sum("big_k").alias("big_n"))))  # one row
    e = F.col("n") * F.col("big_k") / F.col("big_n")
    return out.select(*by, "meth", "k", "big_k", F.round(e, 6).alias("expected"), F.when(F.col("k") < e, "under").otherwise("over").alias("side"))


@query(f"""WITH {FACT}, b AS (SELECT lang, pub_year, arti_id, kw_en FROM fact WHERE include = 'Y' AND lang IN ({_list(LANGS)}) AND pub_year IS NOT NULL), d AS (SELECT b.*, rep, row_number() OVER (PARTITION BY lang, rep ORDER BY md5(concat_ws('|', '20260930', rep, arti_id))) AS r FROM b CROSS JOIN (SELECT unnest(range(1, 51)) AS rep)), y AS (SELECT lang, rep, min(pub_year) FILTER (WHERE contains(lower(kw_en), 'chatgpt')) AS first_year FROM d WHERE r <= 30 GROUP BY 1, 2), a AS (SELECT lang, list_sort(list(first_year)) AS v, count(*) AS n, avg(first_year) AS m, stddev_pop(first_year) AS sd FROM y WHERE first_year IS NOT NULL GROUP BY lang)
SELECT lang, n, round(m, 6) AS mean, round(sd, 6) AS sd, v[(n // 2) + 1] AS median, v[floor(n * 0.025)::INT + 1] AS lo, v[least(n - 1, floor(n * 0.975))::INT + 1] AS hi, v[floor(n * 0.05)::INT + 1] AS p05, v[greatest(0, floor(n * 0.95) - 1)::INT + 1] AS p95 FROM a""")
def size_matched_first(spark, d):
    """First year of a keyword in samples of 30 papers per language; draws without it are dropped."""
    b = fact(spark, d, "include", "lang", "pub_year", "kw_en").where(F.col("lang").isin(*LANGS) & F.expr("include = 'Y' and pub_year is not null"))
    y = sampling.simple_draws(b, "lang", "arti_id", 30, 50, 20260930).groupBy("lang", "rep").agg(F.min(F.when(F.contains(F.lower("kw_en"), F.lit("chatgpt")), F.col("pub_year"))).alias("first_year"))
    return ranking.quantiles(y.where("first_year is not null"), ["lang"], "first_year", 50)


# --- scalar functions ------------------------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT DISTINCT arti_id, doi, permalink, harvested_at FROM papers WHERE arti_id IS NOT NULL) SELECT DISTINCT arti_id, regexp_extract(permalink, 'ART\d{6,}') AS id_in_link, CASE WHEN contains(doi, '<') THEN '' ELSE doi END AS doi, TRY_CAST(nullif(regexp_extract(doi, '(\d{4})', 1), '') AS INTEGER) AS first_number, regexp_extract(permalink, '^[a-z]+://([^/]+)', 1) AS host FROM p""")
def link_parts(spark, d):
    p = table(spark, d, "papers").where("arti_id is not null").select("arti_id", X.year_of(F.col("doi")).alias("first_number"), F.col("doi"), F.regexp_extract("permalink", r"(ART\d{6,})", 1).alias("id_in_link"), F.regexp_extract("permalink", "^[a-z]+://([^/]+)", 1).alias("host"))
    return files.redacted(p, []).distinct()


@query("""SELECT coalesce(lang, '') AS lang, count(*) FILTER (WHERE regexp_matches(text, '[가-힣]')) AS hangul, count(*) FILTER (WHERE NOT regexp_matches(text, '[가-힣]') AND regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]')) AS han, count(*) FILTER (WHERE NOT regexp_matches(text, '[가-힣]') AND NOT regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]')) AS other FROM documents WHERE text IS NOT NULL GROUP BY 1""".replace("\\\\", "\\"))
def script_class(spark, d):
    s = table(spark, d, "documents").where("text is not null").select(F.coalesce("lang", F.lit("")).alias("lang"), X.script(F.col("text")).alias("script"))
    return s.groupBy("lang").agg(*(F.count_if(F.col("script") == k).alias(k) for k in ("hangul", "han", "other")))


@query(f"""SELECT journal, CASE {' '.join(f"WHEN regexp_matches(journal, '{p}') THEN '{n}'" for n, p in FIELDS)} ELSE '기타' END AS field, count(*) AS n FROM papers WHERE journal IS NOT NULL AND trim(journal) <> '' GROUP BY 1, 2""")
def field_classifier(spark, d):
    j = table(spark, d, "papers").where("journal is not null and trim(journal) <> ''").groupBy("journal").agg(F.count("*").alias("n"))
    return j.select("journal", X.first_match(F.col("journal"), [(n, portable(p)) for n, p in FIELDS], "기타").alias("field"), "n")


@query(rf"""WITH {FACT} SELECT arti_id, regexp_matches(coalesce(title_ko, ''), '{SCHOOL}') AS school, regexp_matches(replace(coalesce(title_ko, ''), '대학수학능력', ''), '{UNIVERSITY.replace("(?!수학능력)", "")}') AS university FROM fact""")
def school_level(spark, d):
    t = F.coalesce("title_ko", F.lit(""))
    return fact(spark, d, "title_ko").select("arti_id", t.rlike(SCHOOL).alias("school"), t.rlike(UNIVERSITY).alias("university"))


@query(f"""WITH {FACT} SELECT arti_id, concat_ws('; ', {', '.join("CASE WHEN " + " OR ".join(f"contains(lower(t), '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in TAGS.items())}) AS tags FROM (SELECT arti_id, concat_ws(' ', nullif(title_ko, ''), nullif(title_en, ''), nullif(kw_ko, ''), nullif(kw_en, '')) AS t FROM fact)""")
def multi_label_tags(spark, d):
    text = F.concat_ws(" ", *(X.blank_to_null(F.col(c)) for c in ("title_ko", "title_en", "kw_ko", "kw_en")))
    return fact(spark, d, "title_ko", "title_en", "kw_ko", "kw_en").select("arti_id", X.all_labels(text, TAGS).alias("tags"))


@query("""SELECT verdict_id, CASE WHEN tool IN ('ChatGPT', '챗봇', '기계번역', '기타') THEN tool WHEN tool = '챗지피티' THEN 'ChatGPT' WHEN tool = '번역기' THEN '기계번역' WHEN tool <> '' AND (contains('ChatGPT', tool) OR contains(tool, 'ChatGPT')) THEN 'ChatGPT' WHEN tool <> '' AND (contains('챗봇', tool) OR contains(tool, '챗봇')) THEN '챗봇' WHEN tool <> '' AND (contains('기계번역', tool) OR contains(tool, '기계번역')) THEN '기계번역' WHEN tool <> '' AND (contains('기타', tool) OR contains(tool, '기타')) THEN '기타' ELSE tool END AS tool FROM verdicts""")
def synonym_normalise(spark, d):
    return table(spark, d, "verdicts").select("verdict_id", X.synonym(F.col("tool"), {"챗지피티": "ChatGPT", "번역기": "기계번역"}, ["ChatGPT", "챗봇", "기계번역", "기타"]).alias("tool"))


@query(f"""WITH {FACT} SELECT arti_id, CASE WHEN include = 'Y' THEN lang WHEN lang IN ({_list(LANGS)}) THEN lang WHEN reason IN ('제2외국어', '언어비특정', '복수언어') THEN '해당 없음' WHEN contains(coalesce(title_ko, ''), '중국') THEN '중국어' ELSE '해당 없음' END AS bucket, CASE WHEN lang = '한국어' THEN concat('한국어(', coalesce(nullif(learner, ''), '미명시'), ')') ELSE coalesce(lang, '') END AS context FROM fact""")
def lang_bucket(spark, d):
    lang, title = F.col("lang"), F.coalesce("title_ko", F.lit(""))
    bucket = F.when(F.col("include") == "Y", lang).when(lang.isin(*LANGS), lang).when(F.col("reason").isin("제2외국어", "언어비특정", "복수언어"), "해당 없음").when(title.contains("중국"), "중국어").otherwise("해당 없음")
    context = F.when(lang == "한국어", F.concat(F.lit("한국어("), X.blank_to_null(X.first_filled(F.col("learner"), F.lit("미명시"))), F.lit(")"))).otherwise(F.coalesce(lang, F.lit("")))
    return fact(spark, d, "include", "lang", "reason", "title_ko", "learner").select("arti_id", bucket.alias("bucket"), context.alias("context"))


@query("""SELECT o_orderkey, CASE WHEN length(concat(o_orderpriority, '|', o_orderstatus)) > 8 THEN replace(concat(left(concat(o_orderpriority, '|', o_orderstatus), 8), '…'), '|', '/') ELSE replace(concat(o_orderpriority, '|', o_orderstatus), '|', '/') END AS label, round_even(o_totalprice, 1) AS price, strftime(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d'), '%Y-%m-%d') AS day FROM orders""")
def text_format(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", X.ellipsis(F.concat_ws("|", "o_orderpriority", "o_orderstatus"), 8).alias("label"), X.half_even(F.col("o_totalprice"), 1).alias("price"), X.compact_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, concat('{"k":', json_extract_string(props, '$.k'), ',"type":"', event_type, '"}') AS again FROM events""")
def json_props(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    both = F.create_map(F.lit("k"), F.col("p.k").cast("string"), F.lit("type"), F.col("event_type"))
    text = F.regexp_replace(X.sorted_json(both), r'"k":"(\d+)"', '"k":$1')
    return e.select("event_id", F.col("p.k").alias("k"), text.alias("again"))


@query(f"""WITH {FACT} SELECT arti_id, sha256(concat('detail&id=', arti_id, '&year=', coalesce(pub_year::VARCHAR, ''))) AS key, concat('id=', arti_id, '&j=', url_encode(coalesce(journal, ''))) AS params FROM fact""")
def cache_keys(spark, d):
    f = fact(spark, d, "pub_year", "journal")
    return f.select("arti_id", files.cache_key("detail", {"year": F.col("pub_year"), "id": F.col("arti_id")}).alias("key"), F.replace(X.query_string({"id": F.col("arti_id"), "j": F.coalesce("journal", F.lit(""))}), F.lit("+"), F.lit("%20")).alias("params"))


# --- data quality ------------------------------------------------------------------------------------------------------


@query(f"""WITH r AS (SELECT verdict_id, include, meth, func, reason, confidence FROM verdicts) SELECT verdict_id, 'include' AS rule FROM r WHERE include IS NULL OR include NOT IN ('Y', 'N') UNION ALL SELECT verdict_id, 'meth' FROM r WHERE include = 'Y' AND meth IS NOT NULL AND meth <> '' AND meth NOT IN ({_list(METHS)}) UNION ALL SELECT verdict_id, 'blank func' FROM r WHERE include = 'Y' AND coalesce(func, '') = '' UNION ALL SELECT verdict_id, 'reason' FROM r WHERE include = 'N' AND coalesce(reason, '') = '' UNION ALL SELECT verdict_id, 'confidence' FROM r WHERE confidence IS NOT NULL AND confidence <> '' AND confidence NOT IN ('high', 'mid', 'low')""")
def validation_problems(spark, d):
    yes, no = F.col("include") == "Y", F.col("include") == "N"
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    rules = {"include": F.coalesce(~F.col("include").isin("Y", "N"), F.lit(True)), "meth": yes & quality.not_in("meth", METHS), "blank func": yes & empty("func"), "reason": no & empty("reason"), "confidence": quality.not_in("confidence", ["high", "mid", "low"])}
    return quality.problems(table(spark, d, "verdicts"), "verdict_id", rules)


@query("""SELECT id, count(*) AS times FROM verdicts WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1""")
def duplicate_verdicts(spark, d):
    return quality.duplicates(table(spark, d, "verdicts"), "id")


@query("""SELECT batch, count(*) AS missing FROM (SELECT DISTINCT arti_id, batch FROM papers WHERE arti_id NOT IN (SELECT id FROM codings WHERE id IS NOT NULL)) GROUP BY batch""")
def missing_codings(spark, d):
    return quality.missing_by(table(spark, d, "papers").select(F.col("arti_id").alias("id"), "batch").where("id is not null").distinct(), table(spark, d, "codings").where("id is not null"), "id", "batch")


@query(f"""WITH {FACT}, {_LAST_VERDICT} SELECT arti_id, concat_ws(' / ', CASE WHEN f.boundary = 'Y' THEN 'boundary' END, CASE WHEN f.prev_include <> f.include THEN 'changed' END, CASE WHEN l.confidence = 'low' THEN 'low confidence' END) AS why FROM fact f LEFT JOIN last l ON l.id = f.arti_id WHERE f.boundary = 'Y' OR f.prev_include <> f.include OR l.confidence = 'low'""")
def review_queue(spark, d):
    f = fact(spark, d, "boundary", "prev_include", "include").join(_last_verdict(spark, d).select(F.col("id").alias("arti_id"), F.col("confidence").alias("sure")), "arti_id", "left")
    return quality.review_queue(f, "arti_id", {"boundary": F.col("boundary") == "Y", "changed": F.col("prev_include") != F.col("include"), "low confidence": F.col("sure") == "low"})


@query("""WITH r AS (SELECT DISTINCT user_id FROM events), c AS (SELECT user_id, max(ts) AS fetched FROM events WHERE event_type = 'view' GROUP BY user_id) SELECT r.user_id, CASE WHEN fetched IS NULL THEN 'miss' WHEN fetched > TIMESTAMP '2024-02-15' - INTERVAL 30 DAYS THEN 'hit' ELSE 'expired' END AS state FROM r LEFT JOIN c USING (user_id)""")
def ttl_cache_hits(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_type")
    now = F.lit("2024-02-15").cast("timestamp")
    return files.cache_state(e.select("user_id").distinct(), e.where("event_type = 'view'"), "user_id", "ts", now, 30).select("user_id", "state")


@query("""WITH t AS (SELECT user_id, event_type, min(ts) AS t0 FROM events GROUP BY 1, 2) SELECT user_id, min(t0)::TIMESTAMP AS first, string_agg(event_type, ' > ' ORDER BY t0, event_type) AS tags FROM t GROUP BY user_id""")
def first_seen_provenance(spark, d):
    out = paged.first_seen(table(spark, d, "events"), "user_id", "ts", "event_type")
    return out.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.array_join("tags", " > ").alias("tags"))


@query("""WITH s AS (SELECT unnest(['기계번역', '챗봇', '음성인식']) AS s), t AS (SELECT unnest(['영어교육', '한국어교육']) AS t), q AS (SELECT concat(s, ' ', t) AS q FROM s, t UNION ALL SELECT unnest(['AI 튜터', '말뭉치'])) SELECT f.field, q.q, (SELECT count(*) FROM papers p WHERE contains(coalesce(CASE WHEN f.field = 'title' THEN p.title_ko ELSE p.kw_ko END, ''), split_part(q.q, ' ', 1))) AS hits FROM q CROSS JOIN (SELECT unnest(['title', 'keyword']) AS field) f""")
def query_grid(spark, d):
    """The harvest plan (sets x terms and extras, for each field) with the papers its first word finds."""
    plan = paged.query_plan(spark, ["기계번역", "챗봇", "음성인식"], ["영어교육", "한국어교육"], ["AI 튜터", "말뭉치"], ["title", "keyword"])
    words = ["기계번역", "챗봇", "음성인식", "AI", "말뭉치"]
    cols = {"title": "title_ko", "keyword": "kw_ko"}
    hit = lambda c, w: F.count_if(F.contains(F.coalesce(c, F.lit("")), F.lit(w)))
    counts = table(spark, d, "papers").agg(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(w).alias("w"), hit(c, w).alias("hits")) for f, c in cols.items() for w in words)).alias("h")).select(F.explode("h").alias("h")).select("h.*")
    return plan.withColumn("w", F.split("q", " ")[0]).join(F.broadcast(counts), ["field", "w"]).select("field", "q", "hits")


# --- graphs --------------------------------------------------------------------------------------------------------------

_AUTHORS = r"""au AS (SELECT arti_id, lang, list_distinct(list_transform(list_filter(list_transform(string_split(regexp_replace(authors, '[\s\p{Z}\x{85}]+', ' ', 'g'), ';'), lambda x: trim(x)), lambda x: x <> ''), lambda a: concat(trim(coalesce(nullif(regexp_extract(a, '^([^(]+?) *(?:\((.*)\))?$', 1), ''), a)), '|', CASE WHEN trim(regexp_extract(regexp_extract(a, '^([^(]+?) *(?:\((.*)\))?$', 2), '__INST__', 1)) <> '' THEN trim(regexp_extract(regexp_extract(a, '^([^(]+?) *(?:\((.*)\))?$', 2), '__INST__', 1)) ELSE regexp_split_to_array(trim(regexp_extract(a, '^([^(]+?) *(?:\((.*)\))?$', 2)), ' +')[1] END))) AS keys FROM fact WHERE include = 'Y' AND lang IN ('영어', '한국어', '중국어') AND authors IS NOT NULL),
nodes AS (SELECT DISTINCT lang, unnest(keys) AS node FROM au), ends AS (SELECT arti_id, lang, unnest(keys) AS node FROM au), edges AS (SELECT DISTINCT a.lang, a.node AS src, b.node AS dst FROM ends a JOIN ends b ON a.arti_id = b.arti_id AND a.lang = b.lang AND a.node < b.node)""".replace("__INST__", X.INSTITUTION)


def _authors(spark, d):
    rows = fact(spark, d, "include", "lang", "authors").where(F.col("lang").isin(*LANGS) & F.expr("include = 'Y' and authors is not null"))
    return rows.select("arti_id", "lang", X.author_keys(F.col("authors")).alias("keys"))


@query(f"""WITH {FACT}, {_AUTHORS} SELECT lang, src, dst FROM edges""")
def author_edges(spark, d):
    return graph.pair_edges(_authors(spark, d), "lang", "keys")


@query(f"""WITH {FACT}, {_AUTHORS}, dg AS (SELECT n.lang, n.node, count(e.o) AS degree FROM nodes n LEFT JOIN (SELECT lang, src AS node, dst AS o FROM edges UNION ALL SELECT lang, dst, src FROM edges) e ON e.lang = n.lang AND e.node = n.node GROUP BY 1, 2), g AS (SELECT lang, count(*) AS nodes, (sum(degree) / 2)::BIGINT AS edges, max(degree) AS max_degree, count(*) FILTER (WHERE degree = 0) AS isolates FROM dg GROUP BY lang) SELECT lang, nodes, edges, round(2.0 * edges / (nodes * (nodes - 1)), 6) AS density, round(2.0 * edges / nodes, 6) AS mean_degree, max_degree, round(100.0 * isolates / nodes, 4) AS isolates_pct FROM g""")
def degree_stats(spark, d):
    a = _authors(spark, d)
    return graph.summary(graph.degrees(graph.nodes_of(a, "lang", "keys"), graph.pair_edges(a, "lang", "keys"), "lang"), "lang")


@query(f"""WITH {FACT}, {_AUTHORS} SELECT lang, count(*) AS papers, round(avg(len(keys)), 6) AS authors_per_paper, round(100.0 * count(*) FILTER (WHERE len(keys) <= 1) / count(*), 4) AS sole_pct FROM au GROUP BY lang""")
def authorship(spark, d):
    n = F.size("keys")
    return _authors(spark, d).groupBy("lang").agg(F.count("*").alias("papers"), F.round(F.avg(n), 6).alias("authors_per_paper"), F.round(100.0 * F.count_if(n <= 1) / F.count("*"), 4).alias("sole_pct"))


@query(f"""WITH RECURSIVE {FACT}, {_AUTHORS}, num AS (SELECT lang, node, row_number() OVER (PARTITION BY lang ORDER BY node) AS i FROM nodes), e AS (SELECT a.lang, a.i AS x, b.i AS y FROM edges JOIN num a ON a.lang = edges.lang AND a.node = src JOIN num b ON b.lang = edges.lang AND b.node = dst), twice AS (SELECT lang, x, y FROM e UNION ALL SELECT lang, y, x FROM e),
walk(lang, i, c) USING KEY (lang, i) AS (SELECT lang, i, i FROM num UNION SELECT b.lang, b.y, min(w.c) FROM walk w JOIN twice b ON b.lang = w.lang AND b.x = w.i JOIN recurring.walk r ON r.lang = b.lang AND r.i = b.y WHERE w.c < r.c GROUP BY b.lang, b.y), s AS (SELECT lang, c, count(*) AS size FROM walk GROUP BY 1, 2) SELECT lang, count(*) AS components, max(size) AS largest FROM s GROUP BY lang""")
def components(spark, d):
    a = _authors(spark, d)
    return graph.component_sizes(graph.components(graph.nodes_of(a, "lang", "keys"), graph.pair_edges(a, "lang", "keys"), "lang"), "lang")


@query()
def betweenness_max(spark, d):
    """Mean and greatest betweenness per language; checked against brute force on small graphs."""
    a = _authors(spark, d)
    nodes, edges = graph.nodes_of(a, "lang", "keys"), graph.pair_edges(a, "lang", "keys")
    b = graph.betweenness(nodes, edges, graph.components(nodes, edges, "lang"), "lang")
    return b.groupBy("lang").agg(F.count("*").alias("nodes"), F.round(F.avg("betweenness"), 9).alias("mean"), F.max("betweenness").alias("greatest"))


# --- streams (batch form) --------------------------------------------------------------------------------------------------


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, d):
    w = windows.tumbling(table(spark, d, "events"), "ts", "1 day", "event_type", "value")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOURS OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts)::TIMESTAMP AS session_start, (max(ts) + INTERVAL 12 HOURS)::TIMESTAMP AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    s = windows.sessions(table(spark, d, "events"), "ts", "12 hours", "user_id")
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


# --- further forms -----------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 8000), b AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT 'union all' AS op, count(*) AS n FROM (SELECT k FROM a UNION ALL SELECT k FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'except all', count(*) FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b)""")
def set_algebra(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 8000").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    ops = {"union all": a.unionByName(b), "union": a.unionByName(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "except all": a.exceptAll(b)}
    parts = [df.agg(F.lit(op).alias("op"), F.count("*").alias("n")) for op, df in ops.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {FACT} SELECT count(*) AS papers, count(*) FILTER (WHERE kw_ko <> '') AS with_kw_ko, count(*) FILTER (WHERE kw_en <> '') AS with_kw_en, count(*) FILTER (WHERE authors <> '') AS with_authors, count(*) FILTER (WHERE contains(authors, '(') OR contains(authors, '（')) AS with_affiliation, count(*) FILTER (WHERE doi <> '' AND NOT contains(doi, '<')) AS with_doi, sum(len(regexp_split_to_array(kw_en, '[;,]')))::BIGINT AS parts FROM fact""")
def coverage_counters(spark, d):
    f = fact(spark, d, "kw_ko", "kw_en", "authors", "doi")
    has = lambda c: F.count_if(F.col(c) != "")
    a, doi = F.col("authors"), F.col("doi")
    return f.agg(F.count("*").alias("papers"), has("kw_ko").alias("with_kw_ko"), has("kw_en").alias("with_kw_en"), has("authors").alias("with_authors"), F.count_if(a.contains("(") | a.contains("（")).alias("with_affiliation"), F.count_if((doi != "") & ~doi.contains("<")).alias("with_doi"), F.sum(F.size(F.split("kw_en", "[;,]"))).cast("bigint").alias("parts"))


@query(f"""WITH {FACT}, {_KW} SELECT arti_id, count(*) AS keywords, count(*) FILTER (WHERE regexp_matches(kw, '[가-힣]')) AS hangul, count(*) FILTER (WHERE NOT regexp_matches(kw, '[가-힣]') AND regexp_matches(kw, '[a-z]')) AS latin FROM kw GROUP BY arti_id""")
def keyword_scripts(spark, d):
    """Keywords per paper by script, counted inside the array of the row: no explode, no shuffle of keywords."""
    rows = fact(spark, d, "include", "lang", "kw_ko", "kw_en").where((F.col("include") == "Y") & F.col("lang").isin(*LANGS)).select("arti_id", X.split_keywords(F.col("kw_ko"), F.col("kw_en")).alias("k"))
    number = lambda p: F.size(F.filter("k", p)).cast("bigint")
    return rows.where(F.size("k") > 0).select("arti_id", F.size("k").cast("bigint").alias("keywords"), number(lambda x: x.rlike(X.HANGUL)).alias("hangul"), number(lambda x: ~x.rlike(X.HANGUL) & x.rlike("[a-z]")).alias("latin"))


@query(f"""WITH {FACT}, d AS (SELECT lang, arti_id, func, meth, rep, row_number() OVER (PARTITION BY lang, rep ORDER BY md5(concat_ws('|', '20260930', rep, arti_id))) AS r FROM fact CROSS JOIN (SELECT unnest(range(1, 31)) AS rep) WHERE include = 'Y' AND lang IN ({_list(LANGS)}) AND func <> '기능비특정' AND meth IS NOT NULL), s AS (SELECT n, lang, rep, count(DISTINCT (func, meth)) AS cells FROM d JOIN (SELECT unnest([10, 15, 20]) AS n) ON r <= n GROUP BY 1, 2, 3) SELECT n, lang, count(*) AS draws, round(avg(cells), 6) AS mean, min(cells) AS least, max(cells) AS most FROM s GROUP BY 1, 2""")
def rarefaction_sizes(spark, d):
    """Sensitivity of the occupied cells to the size of the draw; nested draws share their order."""
    from pyspark.sql import Window

    rows = fact(spark, d, "include", "lang", "func", "meth").where(F.col("lang").isin(*LANGS) & F.expr("include = 'Y' and func <> '기능비특정' and meth is not null"))
    draws = sampling.simple_draws(rows, "lang", "arti_id", 20, 30, 20260930)
    w = Window.partitionBy("lang", "rep").orderBy(sampling.draw_key(20260930, F.col("rep"), F.col("arti_id")))
    nested = draws.withColumn("r", F.row_number().over(w)).withColumn("n", F.explode(F.array(F.lit(10), F.lit(15), F.lit(20)))).where("r <= n")
    cells = nested.groupBy("n", "lang", "rep").agg(F.count_distinct("func", "meth").alias("cells"))
    return cells.groupBy("n", "lang").agg(F.count("*").alias("draws"), F.round(F.avg("cells"), 6).alias("mean"), F.min("cells").alias("least"), F.max("cells").alias("most"))


@query("""SELECT event_type, count(*) FILTER (WHERE date_trunc('week', ts) = TIMESTAMP '2024-01-01') AS w1, count(*) FILTER (WHERE date_trunc('week', ts) = TIMESTAMP '2024-01-08') AS w2, count(*) FILTER (WHERE date_trunc('week', ts) = TIMESTAMP '2024-01-15') AS w3 FROM events GROUP BY event_type""")
def pivot_weeks(spark, d):
    e = table(spark, d, "events").withColumn("w", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))
    weeks = ["2024-01-01", "2024-01-08", "2024-01-15"]
    wide = e.groupBy("event_type").pivot("w", weeks).count().na.fill(0)
    return wide.select("event_type", *(F.col(w).alias(f"w{i}") for i, w in enumerate(weeks, 1)))


@query("""SELECT window_start::TIMESTAMP AS window_start, event_type, count(*) AS n FROM (SELECT date_trunc('day', ts) - to_hours(0) AS window_start, event_type FROM events UNION ALL SELECT date_trunc('day', ts - INTERVAL 12 HOURS) + INTERVAL 12 HOURS, event_type FROM events) GROUP BY 1, 2""")
def stream_sliding(spark, d):
    s = windows.sliding(table(spark, d, "events"), "ts", "1 day", "12 hours", "event_type")
    return s.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(f"""WITH {FACT} SELECT arti_id, title_ko FROM fact WHERE pub_year BETWEEN 2020 AND 2023 AND (contains(title_ko, '챗봇') OR contains(title_ko, '프롬프트') OR regexp_matches(title_en, '(?i)corpus|speech recog'))""")
def title_filter(spark, d):
    t = F.coalesce("title_ko", F.lit(""))
    hit = F.exists(F.array(F.lit("챗봇"), F.lit("프롬프트")), lambda k: F.contains(t, k)) | F.coalesce("title_en", F.lit("")).rlike("(?i)corpus|speech recog")
    return fact(spark, d, "pub_year", "title_ko", "title_en").where(F.col("pub_year").between(2020, 2023) & hit).select("arti_id", "title_ko")


@query("""WITH k AS (SELECT o_custkey, min(year(o_orderdate)) AS first_year FROM orders GROUP BY o_custkey), g AS (SELECT n_name, first_year, count(*) AS customers FROM k JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) SELECT n_name, first_year::INTEGER AS first_year, customers, sum(customers) OVER (PARTITION BY n_name ORDER BY first_year)::BIGINT AS so_far FROM g""")
def cohort_growth(spark, d):
    """First order year per customer, customers per nation and year, and their running total."""
    from pyspark.sql import Window

    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.year("o_orderdate")).alias("first_year"))
    joined = first.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    g = joined.groupBy("n_name", "first_year").agg(F.count("*").alias("customers"))
    return g.withColumn("so_far", F.sum("customers").over(Window.partitionBy("n_name").orderBy("first_year")))  # aggregated first: a row per nation and year


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    v = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(v), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))

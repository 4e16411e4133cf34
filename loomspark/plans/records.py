"""Queries of record markup, scope, references, validation and collation over the test tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions import expr as X
from loomspark.functions import markup, scope
from loomspark.functions.text import folded
from loomspark.operators import quality, ranking
from loomspark.plans.catalog import FACT, FIELDS, FUNCS, LANGS, METHS, _list, fact, query
from loomspark.plans.coders import folded_sql
from loomspark.session import table

# Enumerations of the coding scheme that the validation knows.
TOOLS = ["ChatGPT", "생성형AI일반", "중국어LLM", "챗봇", "기계번역", "음성인식·TTS", "BERT·NLP", "기타"]
FOCUS = ["교사·교육주체", "학습자 인식·수용·정의적", "연구동향·메타분석", "일반 논의·활용 제언", "도구·자원 개발"]
EXCLUSIONS = ["제2외국어", "언어비특정", "AI신호부재", "비AI에듀테크", "메타버스VR", "교육맥락없음", "번역품질", "국어교과담론", "기타"]
CONTEXTS = ["L1", "L2", "미명시"]
# End of fixed values.

_TEXT = "concat_ws(' ', nullif(title_ko, ''), nullif(title_en, ''), nullif(kw_ko, ''), nullif(kw_en, ''))"


@query(f"""WITH {FACT} SELECT arti_id, {scope.sql_scope(f"({_TEXT})", "coalesce(kci_field, '')")} AS scope FROM fact""")
def scope_tag(spark, d):
    """The field of language teaching that each paper belongs to, or null if it is out of scope."""
    text = F.concat_ws(" ", *(X.blank_to_null(F.col(c)) for c in ("title_ko", "title_en", "kw_ko", "kw_en")))
    return fact(spark, d, "title_ko", "title_en", "kw_ko", "kw_en", "kci_field").select("arti_id", scope.scope(text, F.col("kci_field")).alias("scope"))


@query(f"""WITH {FACT}, t AS (SELECT coalesce({scope.sql_scope(f"({_TEXT})", "coalesce(kci_field, '')")}, '') AS scope, coalesce(lang, '') AS lang FROM fact) SELECT scope, lang, count(*) AS n FROM t GROUP BY 1, 2""")
def scope_by_group(spark, d):
    """The scope against the coded language."""
    lang = fact(spark, d, "lang").select("arti_id", F.coalesce("lang", F.lit("")).alias("lang"))
    return scope_tag(spark, d).join(lang, "arti_id").groupBy(F.coalesce("scope", F.lit("")).alias("scope"), "lang").agg(F.count("*").alias("n"))


def _cdata(c: str) -> Column:
    return F.concat(F.lit("<![CDATA["), F.coalesce(c, F.lit("")), F.lit("]]>"))


def _detail_xml(spark, d):
    """A detail response made from each paper: keywords, one author, and two references (the paper's own titles)."""
    f = fact(spark, d, "title_ko", "title_en", "journal", "pub_year", "doi", "permalink")
    el = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    year = F.coalesce(F.col("pub_year").cast("string"), F.lit(""))
    one = F.concat(F.lit('<reference type-name="journal" type-code="J1" arti-id="'), F.col("arti_id"), F.lit('">'), el("title", _cdata("title_ko")), el("author", F.lit("kim")), el("journal-name", esc("journal")), el("pubi-year", F.concat(year, F.lit(" spring"))), el("pubilisher", F.lit("press")), el("url", esc("permalink")), el("doi", F.lit("10.1/x")), F.lit("</reference>"))
    two = F.concat(F.lit('<reference type-name="other">'), el("title", esc("title_en")), el("conference-name", F.lit("Corpus meeting")), el("registration-day", F.lit("20190102")), F.lit("</reference>"))
    return f.select("arti_id", "title_ko", "title_en", "journal", "pub_year", F.concat(F.lit("<record><keyword-group><keyword>AI</keyword><keyword>쓰기</keyword></keyword-group><author-group><author><name>홍</name><institution>가나대학교</institution></author></author-group><referenceInfo>"), one, two, F.lit("</referenceInfo></record>")).alias("xml"))


@query(f"""WITH {FACT} SELECT arti_id, 1 AS place, trim(coalesce(title_ko, ''), ' ') AS title, 'kim' AS author, trim(coalesce(journal, ''), ' ') AS journal, 'press' AS publisher, pub_year AS year, 'journal' AS type, 'J1' AS type_code, '10.1/x' AS doi, trim(coalesce(permalink, ''), ' ') AS url, arti_id AS cited_id FROM fact
UNION ALL SELECT arti_id, 2, trim(coalesce(title_en, ''), ' '), '', 'Corpus meeting', '', 2019, 'other', '', '', '', NULL FROM fact""")
def xml_references(spark, d):
    """References of detail responses, all fields: written as markup from each paper and read back."""
    refs = _detail_xml(spark, d).select("arti_id", F.posexplode(markup.detail_record(F.col("xml"), full=True).getField("references")).alias("p", "r"))
    return refs.select("arti_id", (F.col("p") + 1).alias("place"), *(F.col(f"r.{c}").alias(c) for c in ("title", "author", "journal", "publisher", "year", "type", "type_code", "doi", "url")), F.col("r.arti_id").alias("cited_id"))


_FIELD = "CASE WHEN trim({j}) = '' THEN '' " + " ".join(f"WHEN regexp_matches({{j}}, '{p}') THEN '{n}'" for n, p in FIELDS) + " ELSE '기타' END"


@query(f"""WITH {FACT}, r AS (SELECT arti_id, trim(coalesce(title_ko, ''), ' ') AS title, 'kim' AS author, trim(coalesce(journal, ''), ' ') AS journal FROM fact UNION ALL SELECT arti_id, trim(coalesce(title_en, ''), ' '), '', 'Corpus meeting' FROM fact), t AS (SELECT arti_id, concat_ws(' ', title, journal, author) AS s, {_FIELD.format(j='journal')} AS field FROM r)
SELECT arti_id, count(*) AS refs, count(*) FILTER (WHERE regexp_matches(s, '[가-힣]')) AS hangul, count(*) FILTER (WHERE NOT regexp_matches(s, '[가-힣]') AND regexp_matches(s, '[\\x{{4E00}}-\\x{{9FFF}}]')) AS han, count(*) FILTER (WHERE NOT regexp_matches(s, '[가-힣]') AND NOT regexp_matches(s, '[\\x{{4E00}}-\\x{{9FFF}}]')) AS other, count(*) FILTER (WHERE field <> '') AS with_journal, {', '.join(f"count(*) FILTER (WHERE field = '{n}') AS {c}" for n, c in (('교육', 'education'), ('언어학', 'linguistics'), ('문학', 'literature'), ('기타', 'rest')))} FROM t GROUP BY arti_id""".replace("\\\\", "\\"))
def reference_profile(spark, d):
    """References of each paper by script and by field of the journal, counted inside the record."""
    refs = _detail_xml(spark, d).select("arti_id", markup.detail_record(F.col("xml")).getField("references").alias("refs"))
    r = refs.select("arti_id", markup.reference_profile(F.col("refs"), [(n, scope.portable(p)) for n, p in FIELDS], "기타").alias("p"))
    names = {"교육": "education", "언어학": "linguistics", "문학": "literature", "기타": "rest"}
    return r.select("arti_id", *(F.col(f"p.{c}").alias(c) for c in ("refs", "hangul", "han", "other", "with_journal")), *(F.coalesce(F.col("p.fields")[n], F.lit(0)).cast("bigint").alias(c) for n, c in names.items()))


@query(f"""WITH {FACT} SELECT arti_id, trim(coalesce(title_ko, ''), ' ') AS title_ko, nullif(trim(coalesce(title_en, ''), ' '), '') AS title_en, ['홍길동', 'Kim'] AS authors, nullif(trim(coalesce(journal, ''), ' '), '') AS journal, pub_year AS year, nullif(trim(coalesce(kci_field, ''), ' '), '') AS field, trim(coalesce(permalink, ''), ' ') AS permalink, '10.9/' || arti_id AS doi, 7 AS cited FROM fact""")
def xml_search(spark, d):
    """Records of search responses: written as markup from each paper, with entities, CDATA and affiliations, and read."""
    f = fact(spark, d, "title_ko", "title_en", "journal", "pub_year", "kci_field", "permalink")
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(
        F.lit("<outputData><total> 1 </total><record><journalInfo><journal-name>"), esc("journal"), F.lit("</journal-name><pub-year>"), F.coalesce(F.col("pub_year").cast("string"), F.lit("")), F.lit('</pub-year></journalInfo><articleInfo article-id="'), F.col("arti_id"),
        F.lit('"><article-categories>'), esc("kci_field"), F.lit('</article-categories><title-group><article-title lang="original">'), _cdata("title_ko"), F.lit('</article-title><article-title lang="english">'), esc("title_en"),
        F.lit("</article-title></title-group><author-group><author>홍길동(가나대학교)</author><author>Kim (Institute)</author></author-group><doi>https://doi.org/10.9/"), F.col("arti_id"), F.lit('</doi><citation-count kci="7" wos="2">9</citation-count><url>'), esc("permalink"), F.lit("</url></articleInfo></record></outputData>"),
    )
    r = f.select(xml.alias("xml")).select(F.explode(markup.search_records(F.col("xml"))).alias("r"), markup.doi_of(F.col("xml")).alias("doi"), markup.citations(F.col("xml"), F.lit(None), "kci").alias("cited"))
    return r.select(*(F.col(f"r.{c}").alias(c) for c in ("arti_id", "title_ko", "title_en", "authors", "journal", "year", "field", "permalink")), "doi", "cited")


_V = {c: folded_sql(c) for c in ("lang_group", "func", "meth", "tool", "focus", "learner", "reason")}


@query(f"""WITH v AS (SELECT verdict_id, upper(left(trim(coalesce(include, '')), 1)) AS inc, {', '.join(f'{s} AS {c}' for c, s in _V.items())} FROM verdicts)
SELECT verdict_id, 'group' AS rule FROM v WHERE inc = 'Y' AND lang_group NOT IN ({_list(LANGS)}) UNION ALL SELECT verdict_id, 'func' FROM v WHERE inc = 'Y' AND func NOT IN ({_list([*FUNCS, '기능비특정'])}) UNION ALL SELECT verdict_id, 'meth' FROM v WHERE inc = 'Y' AND meth NOT IN ({_list(METHS)}) UNION ALL SELECT verdict_id, 'tool' FROM v WHERE inc = 'Y' AND tool NOT IN ({_list(TOOLS)})
UNION ALL SELECT verdict_id, 'focus' FROM v WHERE inc = 'Y' AND func = '기능비특정' AND focus NOT IN ({_list(FOCUS)}) UNION ALL SELECT verdict_id, 'context' FROM v WHERE inc = 'Y' AND lang_group = '한국어' AND learner NOT IN ({_list(CONTEXTS)}) UNION ALL SELECT verdict_id, 'reason' FROM v WHERE inc <> 'Y' AND reason NOT IN ({_list(EXCLUSIONS)})""")
def validation_rules(spark, d):
    """All seven rules of the verdict scheme, by whether the paper is included, over every verdict."""
    v = table(spark, d, "verdicts").select("verdict_id", F.upper(F.substring(F.trim(F.coalesce("include", F.lit(""))), 1, 1)).alias("inc"), *(F.coalesce(folded(c), F.lit("")).alias(c) for c in _V))
    yes, outside = F.col("inc") == "Y", lambda c, xs: ~F.col(c).isin(*xs)
    return quality.problems(v, "verdict_id", {
        "group": yes & outside("lang_group", LANGS), "func": yes & outside("func", [*FUNCS, "기능비특정"]), "meth": yes & outside("meth", METHS), "tool": yes & outside("tool", TOOLS),
        "focus": yes & (F.col("func") == "기능비특정") & outside("focus", FOCUS), "context": yes & (F.col("lang_group") == "한국어") & outside("learner", CONTEXTS), "reason": ~yes & outside("reason", EXCLUSIONS),
    })


@query("""WITH w AS (SELECT DISTINCT unnest([journal, tool, lang3]) AS word FROM papers), k AS (SELECT word FROM w WHERE word IS NOT NULL AND word <> '') SELECT word, row_number() OVER (ORDER BY icu_sort_key(word, 'root'), word) AS place FROM k""")
def collated_order(spark, d):
    """Places of mixed-script words by the root collation of Unicode: Latin before Hangul before Han, case last."""
    w = table(spark, d, "papers").select(F.explode(F.array("journal", "tool", "lang3")).alias("word")).where("word is not null and word <> ''").distinct()
    return ranking.collated_places(w, "word", "place")

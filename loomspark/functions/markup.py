"""XML and HTML text to columns and nested records, on the JVM side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.expr import blank_to_null, first_match, script

_BASIC = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _replace(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def without_cdata(c: Column) -> Column:
    return F.regexp_replace(c, r"<!\[CDATA\[|\]\]>", "")


def element_text(c: Column) -> Column:
    """CDATA marks out, the three basic entities decoded, trimmed."""
    return F.trim(_replace(without_cdata(c), _BASIC))


def clean_text(c: Column) -> Column:
    """CDATA marks out, five entities decoded (the ampersand first, so doubly encoded quotes are undone too), white
    space runs to one space."""
    five = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))
    return F.trim(F.regexp_replace(_replace(without_cdata(c), five), r"(?U)\s+", " "))


def cell_text(c: Column) -> Column:
    """Spreadsheet text: numeric references of the Latin-1 range and named entities decoded, the ampersand last."""
    for n in (9, 10, 13, 34, 38, 39, 160):
        c = F.regexp_replace(c, f"&#(?:{n}|[xX]0*{n:x}|[xX]0*{n:X});", "&amp;" if n == 38 else chr(n))
    return _replace(c, (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")))


def block(xml: Column, tag: str) -> Column:
    """Inside of the first element with the tag, '' without."""
    return F.regexp_extract(xml, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)


def first_tag(xml: Column, tag: str, attribute: str = "", value: str = "") -> Column:
    """Cleaned text of the first element with the tag (and, if given, attribute='value')."""
    open_tag = rf'<{tag}\s[^>]*{attribute}="{value}"[^>]*>' if attribute else rf"<{tag}(?:\s[^>]*)?>"
    return element_text(F.regexp_extract(xml, rf"(?s){open_tag}(.*?)</{tag}>", 1))


def attribute(open_tag: Column, name: str) -> Column:
    return F.regexp_extract(open_tag, rf'{name}="([^"]*)"', 1)


def elements(xml: Column, tag: str) -> Column:
    """ARRAY of the whole elements with the tag, outermost tags included."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>"), F.lit(0))


def total_count(xml: Column) -> Column:
    """Hits announced by a search response; null without."""
    return blank_to_null(F.regexp_extract(xml, r"<total>\s*(\d+)\s*</total>", 1)).cast("int")


def doi_of(xml: Column) -> Column:
    """DOI inside the article block only, without the resolver."""
    return F.regexp_replace(element_text(block(block(xml, "articleInfo"), "doi")), r"(?i)^https?://(?:dx\.)?doi\.org/", "")


def citations(xml: Column, fallback: Column, index: str) -> Column:
    """Citation count: the attribute named after the index, else the element's text, else the fallback column."""
    own = F.regexp_extract(xml, rf'(?s)<citation-count[^>]*\s{index}="(\d+)"', 1)
    text = F.regexp_extract(xml, r"(?s)<citation-count[^>]*>\s*(\d+)\s*<", 1)
    return F.coalesce(blank_to_null(own).cast("int"), blank_to_null(text).cast("int"), fallback.cast("int"))


def search_records(xml: Column) -> Column:
    """ARRAY of papers in a search response: id, titles, author names without affiliation, journal, year, field, link.
    Records without an identifier are dropped."""

    def paper(b: Column) -> Column:
        ident = F.coalesce(blank_to_null(F.regexp_extract(b, r'article-id="(ART\d{9,})"', 1)), blank_to_null(F.regexp_extract(b, r"(ART\d{9,})", 1)))
        year = first_tag(b, "pub-year")
        authors = F.filter(F.transform(elements(b, "author"), lambda a: F.trim(F.regexp_replace(element_text(F.regexp_replace(a, r"^<author[^>]*>|</author>$", "")), r"\s*\([^)]*\)\s*$", ""))), lambda a: a != "")
        return F.struct(
            ident.alias("arti_id"), first_tag(b, "article-title", "lang", "original").alias("title_ko"), blank_to_null(first_tag(b, "article-title", "lang", "english")).alias("title_en"),
            authors.alias("authors"), blank_to_null(first_tag(b, "journal-name")).alias("journal"), F.when(year.rlike(r"^\d{4}$"), year.cast("int")).alias("year"),
            blank_to_null(first_tag(b, "article-categories")).alias("field"), first_tag(b, "url").alias("permalink"),
        )

    return F.filter(F.transform(elements(xml, "record"), paper), lambda p: p.arti_id.isNotNull())


def detail_record(xml: Column, full: bool = False) -> Column:
    """STRUCT of an article's detail: keywords by language, authors, references, and whether it has a reference list.
    full: references have their publisher, the code of their type and their link too."""
    group = F.coalesce(blank_to_null(block(xml, "keyword-group")), xml)
    words = F.array_distinct(F.filter(F.transform(elements(group, "keyword"), lambda k: element_text(F.regexp_replace(k, r"^<keyword[^>]*>|</keyword>$", ""))), lambda k: k != ""))
    korean = lambda k: k.rlike("[가-힣]")
    person = lambda a: F.struct(first_tag(a, "name").alias("name"), first_tag(a, "name-eng").alias("name_en"), first_tag(a, "institution").alias("affil"))
    authors = F.filter(F.transform(elements(block(xml, "author-group"), "author"), person), lambda a: (a["name"] != "") | (a["name_en"] != ""))

    def reference(r: Column) -> Column:
        head = F.regexp_extract(r, r"^(<reference[^>]*>)", 1)
        year = F.coalesce(blank_to_null(first_tag(r, "pubi-year")), first_tag(r, "registration-day"))
        return F.struct(
            first_tag(r, "title").alias("title"), first_tag(r, "author").alias("author"), F.coalesce(blank_to_null(first_tag(r, "journal-name")), first_tag(r, "conference-name")).alias("journal"),
            blank_to_null(F.regexp_extract(year, r"(\d{4})", 1)).cast("int").alias("year"), attribute(head, "type-name").alias("type"), first_tag(r, "doi").alias("doi"), blank_to_null(attribute(head, "arti-id")).alias("arti_id"),
            *([first_tag(r, "pubilisher").alias("publisher"), attribute(head, "type-code").alias("type_code"), first_tag(r, "url").alias("url")] if full else []),
        )

    references = F.transform(elements(block(xml, "referenceInfo"), "reference"), reference)
    return F.struct(F.filter(words, korean).alias("kw_ko"), F.filter(words, lambda k: ~korean(k)).alias("kw_en"), authors.alias("authors"), references.alias("references"), xml.contains("<referenceInfo").alias("ref_available"))


def reference_profile(references: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """STRUCT of counts over an array of references: refs, hangul, han and other by their script, with_journal, and
    fields, a MAP from the class of the journal by ordered rules to its count. Counted inside the row; a null array has 0."""
    read = F.transform(references, lambda r: F.struct(*(r[c].alias(c) for c in ("title", "author", "journal"))))
    refs = F.coalesce(read, F.array().cast("array<struct<title:string,author:string,journal:string>>"))
    label = lambda r: F.struct(script(F.concat_ws(" ", r["title"], r["journal"], r["author"])).alias("s"), F.when(F.trim(r["journal"]) == "", "").otherwise(first_match(r["journal"], rules, default)).alias("c"))

    def counts(labels: Column) -> Column:
        number = lambda f: F.size(F.filter(labels, f)).cast("bigint")
        of = lambda k: number(lambda x: x["s"] == k).alias(k)
        names = F.array(*(F.lit(n) for n, _ in rules), F.lit(default))
        fields = F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), number(lambda x: x["c"] == n).alias("value"))))
        return F.struct(F.size(labels).cast("bigint").alias("refs"), of("hangul"), of("han"), of("other"), number(lambda x: x["c"] != "").alias("with_journal"), fields.alias("fields"))

    return F.transform(F.array(F.transform(refs, label)), counts)[0]  # in an array of one, so that labels are made once


def coverage(detail: Column) -> list[Column]:
    """Aggregates over detail records: how many have keywords, authors, affiliations and references, and how many."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    d = lambda n: detail.getField(n)
    return [
        F.count("*").alias("records"), F.count_if(size(d("kw_ko")) > 0).alias("with_kw_ko"), F.count_if(size(d("kw_en")) > 0).alias("with_kw_en"), F.count_if(size(d("authors")) > 0).alias("with_authors"),
        F.count_if(F.exists(d("authors"), lambda a: a.affil != "")).alias("with_affil"), F.count_if(size(d("references")) > 0).alias("with_references"), F.sum(size(d("references"))).alias("references"),
    ]

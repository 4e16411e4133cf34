"""Scalar expressions on the JVM side: splitting, cleaning, classifying, formatting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and lists that decide results.
SPACE_ENDS = r"(?U)^\s+|\s+$"
INSTITUTION = r"(?i)([가-힣A-Za-z&\.\- ]*?(?:대학교|대학|학교|연구원|연구소|교육청|University|College|Institute|School))"
HANGUL, HAN = "[가-힣]", "[\\x{4E00}-\\x{9FFF}]"
# End of fixed values.


def trimmed(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, SPACE_ENDS, "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cs: Column) -> Column:
    """The first value that is neither null nor '', else ''."""
    return F.coalesce(*(blank_to_null(c) for c in cs), F.lit(""))


def norm_keyword(c: Column) -> Column:
    """White space runs to one space, trimmed, lower case; dash and dot runs to a space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), r"[·\-–—]+", " "))


def split_keywords(*fields: Column, pattern: str = "[;,]", least: int = 2) -> Column:
    """Normalised parts of the fields, those shorter than `least` dropped."""
    parts = F.split(F.concat_ws(";", *fields), pattern)
    return F.filter(F.transform(parts, norm_keyword), lambda x: F.length(x) >= least)


def author_keys(authors: Column) -> Column:
    """Distinct name|institution of a ';' list, in order; runs of white space count as one space."""
    entries = F.filter(F.transform(F.split(F.regexp_replace(authors, r"(?U)[\s\p{Z}]+", " "), ";"), lambda a: F.trim(a)), lambda a: a != "")

    def key(a: Column) -> Column:
        shape = r"^([^(]+?) *(?:\((.*)\))?$"
        name = F.coalesce(blank_to_null(F.regexp_extract(a, shape, 1)), a)
        affiliation = F.regexp_extract(a, shape, 2)
        found = F.trim(F.regexp_extract(affiliation, INSTITUTION, 1))
        word = F.coalesce(F.try_element_at(F.split(F.trim(affiliation), " +"), F.lit(1)), F.lit(""))
        return F.concat(F.trim(name), F.lit("|"), F.when(found != "", found).otherwise(word))

    return F.array_distinct(F.transform(entries, key))


def strip_affiliation(c: Column) -> Column:
    """Name without what stands in half- or full-width brackets at the end."""
    return F.trim(F.regexp_replace(c, r"\s*[(（].*[)）]\s*$", ""))


def first_match(c: Column, rules: Sequence[tuple[str, str]], default: Column | str) -> Column:
    """CASE over regular expressions in order: the label of the first that matches. A theta join against a small rule
    table becomes an expression: no cross join, no shuffle."""
    out = F.when(c.rlike(rules[0][1]), rules[0][0])
    for label, pattern in rules[1:]:
        out = out.when(c.rlike(pattern), label)
    return out.otherwise(F.lit(default) if isinstance(default, str) else default)


def all_labels(c: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """Labels any of whose words occur in the lower-cased text, joined by '; '."""
    low = F.lower(c)
    hits = [F.when(F.greatest(*(F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0), F.lit(0)) == 1, F.lit(label)) for label, words in rules.items()]
    return F.concat_ws("; ", *hits)


def synonym(c: Column, table: Mapping[str, str], allowed: Sequence[str]) -> Column:
    """Exact value, else a synonym, else the first allowed value that contains it or is contained, else as typed."""
    exact = F.when(c.isin(*allowed), c)
    mapped = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c) if table else F.lit(None)
    within = F.get(F.filter(F.array(*map(F.lit, allowed)), lambda a: (c != "") & (F.contains(a, c) | F.contains(c, a))), F.lit(0))
    return F.coalesce(exact, mapped, within, c)


def script(c: Column) -> Column:
    """hangul, han or other; Hangul goes first."""
    return F.when(c.rlike(HANGUL), "hangul").when(c.rlike(HAN), "han").otherwise("other")


def level(c: Column, n: int, default: str, sep: str = " > ") -> Column:
    """n-th level of a hierarchical value."""
    return F.coalesce(blank_to_null(F.try_element_at(F.split(c, sep), F.lit(n))), F.lit(default))


def year_of(c: Column) -> Column:
    """First four digits in a row, as an integer; null without."""
    return F.try_to_number(blank_to_null(F.regexp_extract(c, r"(\d{4})", 1)), F.lit("9999")).cast("int")


def compact_date(c: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD; null if it is no date."""
    return F.date_format(F.try_to_date(c, "yyyyMMdd"), "yyyy-MM-dd")


def ellipsis(c: Column, n: int = 45) -> Column:
    """Cut to n characters with …, pipes as slashes."""
    return F.replace(F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c), F.lit("|"), F.lit("/"))


def half_even(c: Column, digits: int) -> Column:
    """Rounded half to even."""
    return F.bround(c, digits)


def fixed(c: Column, digits: int) -> Column:
    """Fixed decimals with thousands separators, half to even."""
    return F.format_number(c, digits)


def sorted_json(m: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def query_string(params: Mapping[str, Column]) -> Column:
    """k=v pairs, URL-encoded, joined by &."""
    return F.concat_ws("&", *(F.concat(F.lit(k + "="), F.url_encode(v)) for k, v in params.items()))

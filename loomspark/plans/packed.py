"""Queries of the packed-field operator, and its grammar as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.functions.packed import COMMAS, SPACED, STRONG, distinct_papers, split_packed
from loomspark.session import table

FIELDS = ("kw_ko", "kw_en", "authors")


def p7_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every entry of the packed fields, with the flags of malformed marks."""
    return split_packed(distinct_papers(table(spark, d, "papers"), *FIELDS), "arti_id", FIELDS)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_entries(spark, d).select("arti_id", "field", "entry_pos", "entry")


QUERIES = {"p7_found": p7_found, "p7_entries": p7_entries}

# The grammar for engines with linear-time patterns: guarded parts (quotes, brackets to a depth of five, references) are
# alternatives before single characters, so a text falls into tokens; separators of the kind in force become cuts.
WHITE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}\x0b]"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def _guard() -> str:
    bracketed = "[(（][^()（）]*[)）]"
    for _ in range(4):
        bracketed = f"[(（](?:[^()（）]|{bracketed})*[)）]"
    return '"(?:[^"]|"")*"|“[^”]*”|‘[^’]*’|' + bracketed + "|&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"


def trimmed_sql(c: str) -> str:
    return f"regexp_replace({c}, {_lit(f'^{WHITE}+|{WHITE}+$')}, '', 'g')"


def entries_sql(fields: tuple[str, ...] = FIELDS) -> str:
    """CTEs one (a row per paper) and entries (arti_id, field, entry, entry_pos)."""
    kinds = [_any(STRONG), _any(COMMAS), WHITE + _any(SPACED) + WHITE]
    mark = " OR ".join(f"k = {i} AND regexp_full_match(x, {_lit(p)})" for i, p in enumerate(kinds, 1))
    which = " ".join(f"WHEN regexp_matches(m, {_lit(p)}) THEN {i}" for i, p in enumerate(kinds, 1))
    quotes = [('"', '"', '(?s)"(?:[^"]|"")*"'), ("“", "”", "(?s)“[^”]*”"), ("‘", "’", "(?s)‘[^’]*’")]
    bare = " ".join(f"WHEN length(p) > 1 AND regexp_full_match(p, {_lit(w)}) THEN " + trimmed_sql(f"replace(p[2:-2], '{a * 2}', '{a}')") for a, _, w in quotes)
    return f"""one AS (SELECT DISTINCT ON (arti_id) * FROM papers WHERE arti_id IS NOT NULL ORDER BY arti_id, harvested_at DESC),
raw AS ({' UNION ALL '.join(f"SELECT arti_id, '{f}' AS field, {f} AS v FROM one" for f in fields)}),
masked AS (SELECT *, regexp_replace(v, {_lit(_guard())}, 'x', 'g') AS m FROM raw WHERE v IS NOT NULL), kind AS (SELECT arti_id, field, v, CASE {which} ELSE 0 END AS k FROM masked),
token AS (SELECT arti_id, field, k, regexp_extract_all(v, '(?s)' || {_lit(_guard())} || CASE WHEN k = 3 THEN {_lit('|' + kinds[2])} ELSE '' END || '|.') AS t FROM kind),
part AS (SELECT arti_id, field, string_split(array_to_string(list_transform(t, lambda x: CASE WHEN {mark} THEN chr(1) ELSE x END), ''), chr(1)) AS ps FROM token),
trimmed AS (SELECT arti_id, field, list_filter(list_transform(ps, lambda p: {trimmed_sql('p')}), lambda p: p <> '') AS ps FROM part),
unquoted AS (SELECT arti_id, field, list_filter(list_transform(ps, lambda p: CASE {bare} ELSE p END), lambda p: p <> '') AS ps FROM trimmed),
entries AS (SELECT arti_id, field, unnest(ps) AS entry, generate_subscripts(ps, 1)::INTEGER AS entry_pos FROM unquoted)"""


SQL = {"p7_found": f"WITH {entries_sql()} SELECT arti_id, field, entry_pos, entry FROM entries"}

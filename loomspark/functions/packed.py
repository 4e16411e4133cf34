"""Several values packed in one string field: a parsing expression grammar, one output row per value.

Grammar (ordered alternatives, the first that matches wins):

    packed    <- entry (separator entry)* end
    entry     <- (quoted / bracketed / reference / bare)*
    quoted    <- '"' ('""' / [^"])* '"'  /  '“' [^”]* '”'  /  '‘' [^’]* '’'
    bracketed <- [(（] (bracketed / [^)）])* [)）]
    reference <- '&' ('#' [0-9]+ / '#x' [0-9a-f]+ / name of a character) ';'
    bare      <- any one character

A quote or bracket that is never closed makes its alternative fail; the parser backtracks to the opening mark, takes
it as a bare character and flags the entry. Separators are of three kinds, strong to weak; of the kinds present
outside quotes, brackets and references only the strongest one separates, all marks of weaker kinds are bare.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRONG = ";；﹔؛\u037e|｜¦│\t\n\r\v\f\x85\u2028\u2029"
COMMAS = ",，、﹐﹑､،՝፣᠂ꓹ"
SPACED = "/／·・･‧•∙⋅ㆍ"
OPEN, CLOSE = "(（", ")）"
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
_STRAIGHT = re.compile(r'"(?:[^"]|"")*+"')
_MARKS = re.compile(f'[{re.escape(STRONG + COMMAS + SPACED + OPEN + CLOSE)}"“‘&]')
_GUARDED = re.compile('["“‘&()（）]')
_KINDS = [re.compile(f"[{re.escape(STRONG)}]"), re.compile(f"[{re.escape(COMMAS)}]"), re.compile(rf"(?<=\s)[{re.escape(SPACED)}](?=\s)")]
_RANK = {c: k for k, marks in enumerate((STRONG, COMMAS, SPACED)) for c in marks}
_CURLY = {"“": "”", "‘": "’"}


def _brackets(text: str) -> dict[int, int]:
    """Opening position -> position of its closing bracket, in one pass; what has no partner is absent."""
    pairs, stack = {}, []
    for m in re.finditer(r"[()（）]", text):
        if m[0] in OPEN:
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    return pairs


def _separators(text: str) -> tuple[list[int], dict[int, str]]:
    """Positions of the separators in force, and the flags by position of the malformed mark."""
    found: tuple[list[int], ...] = ([], [], [])
    flags: dict[int, str] = {}
    pairs = _brackets(text)
    unclosed: set[str] = set()
    at, size = 0, len(text)
    while m := _MARKS.search(text, at):
        i, c = m.start(), m[0]
        at = i + 1
        if (kind := _RANK.get(c)) is not None:
            if kind < 2 or 0 < i < size - 1 and text[i - 1].isspace() and text[i + 1].isspace():
                found[kind].append(i)
        elif c == '"':
            if q := _STRAIGHT.match(text, i):
                at = q.end()
            else:
                flags[i] = "open_quote"
        elif c in _CURLY:
            end = -1 if c in unclosed else text.find(_CURLY[c], i + 1)
            if end >= 0:
                at = end + 1
            else:
                unclosed.add(c)
                flags[i] = "open_quote"
        elif c == "&":
            if (r := _REFERENCE.match(text, i)) and (text[i + 1] == "#" or text[i + 1 : r.end()] in html5):
                at = r.end()
        elif c in OPEN:
            if i in pairs:
                at = pairs[i] + 1
            else:
                flags[i] = "open_bracket"
        else:
            flags[i] = "stray_bracket"
    return next((f for f in found if f), []), flags


def _unquote(entry: str) -> str:
    if len(entry) < 2:
        return entry
    first, last = entry[0], entry[-1]
    if first == '"' and last == '"' and _STRAIGHT.fullmatch(entry):
        return entry[1:-1].replace('""', '"').strip()
    if _CURLY.get(first) == last and entry.find(last, 1) == len(entry) - 1:
        return entry[1:-1].replace(first * 2, first).strip()
    return entry


def parse_packed(text: str | None) -> list[tuple[str, str]]:
    """(entry, flags) of a packed string, in order.

    None, '' and blank strings give []. Flags are '' or open_quote, open_bracket, stray_bracket joined by '|'.
    Time is linear in the length, malformed input included.
    """
    if not text or text.isspace():
        return []
    if not _GUARDED.search(text):
        for kind in _KINDS:
            if kind.search(text):
                return [(e, "") for part in kind.split(text) if (e := part.strip())]
        return [(text.strip(), "")]
    cuts, flags = _separators(text)
    out, start, marks = [], 0, sorted(flags)
    k = 0
    for end in [*cuts, len(text)]:
        own = []
        while k < len(marks) and marks[k] < end:
            own.append(flags[marks[k]])
            k += 1
        if entry := _unquote(text[start:end].strip()):
            out.append((entry, "|".join(dict.fromkeys(own))))
        start = end + 1
    return out


def split_packed(df: DataFrame, key: str, fields: Sequence[str], field_name: str = "field") -> DataFrame:
    """One row (key, field, entry_pos, entry, entry_flags) for every value packed in the given string columns.

    Positions count the non-empty entries from 1. Null, empty and blank fields give no row; repeated input rows give
    repeated output rows; a null key stays null; other columns of df, whatever their names, are not carried. The
    operator is a narrow map over Arrow batches: no shuffle, memory of one batch.
    """
    names = list(fields)
    narrow = df.select(F.col(f"`{key}`").alias("k"), *(F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(names)))
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            which: list[str] = []
            pos: list[int] = []
            entries: list[str] = []
            marks: list[str] = []
            for i, name in enumerate(names):
                for r, text in enumerate(batch.column(i + 1).to_pylist()):
                    if text:
                        for p, (entry, flag) in enumerate(parse_packed(text), 1):
                            rows.append(r)
                            which.append(name)
                            pos.append(p)
                            entries.append(entry)
                            marks.append(flag)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(which, pa.string()), pa.array(pos, pa.int32()), pa.array(entries, pa.string()), pa.array(marks, pa.string())],
                names=["k", "w", "p", "e", "g"],
            )

    out = narrow.mapInArrow(run, f"k {key_type}, w string, p int, e string, g string")
    return out.select(F.col("k").alias(key), F.col("w").alias(field_name), F.col("p").alias("entry_pos"), F.col("e").alias("entry"), F.col("g").alias("entry_flags"))


def distinct_papers(papers: DataFrame, *columns: str) -> DataFrame:
    """One row per arti_id with the given columns, from its latest harvest; ties fall to the greatest values.

    Rows without arti_id are no paper and are left out. Copies are folded before the shuffle, so a paper that was
    harvested over and over is one row per task, not a hot partition.
    """
    when = F.col("harvested_at") if "harvested_at" in papers.columns else F.lit(None).cast("timestamp")
    best = papers.where("arti_id is not null").groupBy("arti_id").agg(F.max(F.struct(when.alias("at"), *(F.col(c) for c in columns))).alias("best"))
    return best.select("arti_id", *(F.col(f"best.{c}").alias(c) for c in columns))

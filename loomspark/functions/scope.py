"""Which language-teaching field a paper belongs to, from its title, keywords and field of study."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The groups in order of precedence, the teaching marks, the exclusions and the guard against them. Patterns
# are written with \s for any white space and \b for a border of ASCII words; (?i) holds for the whole pattern.
CHINESE, KOREAN, ENGLISH = "중국어", "한국어", "영어·외국어"
GROUPS = [
    (
        CHINESE,
        [r"중국어", r"중어중문", r"중어", r"汉语", r"漢語", r"华语", r"(?i)\bCFL\b", r"(?i)\bTCFL\b", r"(?i)\bHSK\b", r"(?i)\bchinese\b", r"(?i)\bmandarin\b"],
        [r"중국어와문학", r"중어중문"],
    ),
    (
        KOREAN,
        [r"한국어\s*교육", r"(?i)\bKFL\b", r"외국어로서(의)?\s*한국어", r"제2언어로서.*한국어", r"한국어\s*학습", r"한국어\s*교재", r"한국어\s*능력", r"재외동포.*한국어", r"(?i)korean\s+as\s+a\s+(foreign|second)\s+language", r"한국어"],
        [r"한국어와문학"],
    ),
    (
        ENGLISH,
        [
            r"영어\s*교육", r"(?i)\bEFL\b", r"(?i)\bESL\b", r"(?i)\bTESOL\b", r"(?i)\bELT\b", r"(?i)\benglish\b", r"영어", r"외국어\s*교육", r"제2외국어", r"제이(2)?외국어", r"일본어", r"\b일어\b", r"프랑스어",
            r"불어", r"독일어", r"\b독어\b", r"스페인어", r"서반아어", r"러시아어", r"노어", r"베트남어", r"아랍어", r"(?i)foreign\s+language",
        ],
        [r"영어와문학"],
    ),
]
TEACHING = [
    r"교육", r"교수", r"학습", r"수업", r"교실", r"학습자", r"교재", r"교과", r"리터러시", r"(?i)literacy", r"(?i)teaching", r"(?i)learning", r"(?i)education", r"(?i)pedagog", r"(?i)instruction", r"(?i)classroom",
    r"(?i)curriculum", r"외국어로서", r"제2언어", r"\bL2\b", r"(?i)\bCALL\b", r"(?i)\bMALL\b",
]
FIRST_LANGUAGE = ([r"(?<![한외중])국어\s*교육", r"국어과", r"국어\s*교과", r"초등\s*국어", r"중등\s*국어", r"모어\s*화자", r"모국어\s*화자", r"국어\s*수업"], [r"^국어교육$"])
TRANSLATION = (
    [r"번역\s*품질", r"오역", r"번역\s*오류", r"번역학", r"번역\s*평가", r"번역\s*전략", r"번역\s*투", r"기계번역\s*(품질|성능|오류|평가|비교)", r"(?i)post[- ]?editing", r"(?i)translation\s+quality"],
    [r"^통역번역학$"],
)
LINGUISTICS = (
    [
        r"언어학", r"음운론", r"통사론", r"형태론", r"의미론", r"화용론", r"코퍼스\s*언어학", r"자연어\s*처리", r"(?i)\bNLP\b", r"형태소\s*분석", r"구문\s*분석", r"개체명", r"감성\s*분석", r"감정\s*분석", r"토픽\s*모델링",
        r"어휘\s*의미망", r"(?i)corpus\s+linguistics",
    ],
    [r"^언어학$"],
)
GUARD = [r"한국어\s*교육", r"(?i)\bKFL\b", r"외국어로서(의)?\s*한국어", r"한국어\s*학습", r"(?i)korean\s+as\s+a\s+(foreign|second)\s+language"]
# End of fixed values.
_WORD = "[A-Za-z0-9_]"


def portable(pattern: str) -> str:
    """A pattern with its white space and word borders spelled out, as engines read \\s and \\b differently."""
    border = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
    spelled = pattern.replace(r"\s", r"[\s\p{Z}]")
    spelled = re.sub(r"\\b(?=[A-Za-z0-9])", lambda _: f"(?<!{_WORD})", spelled)  # beside a letter one look is enough
    spelled = re.sub(r"(?<=[A-Za-z0-9])\\b", lambda _: f"(?!{_WORD})", spelled)
    return spelled.replace(r"\b", border)


def any_of(patterns: Sequence[str]) -> str:
    """One alternation of all patterns, those that ignore case kept apart from the others."""
    return "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns)


def _hit(c: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(c.rlike(portable(any_of(patterns))), F.lit(False))


def scope(text: Column, field: Column) -> Column:
    """The group of a paper, or null if it is out of scope.

    Out are, in this order: teaching of the mother tongue, unless the paper is about Korean as a foreign language; work
    on translation only and on linguistics only, both without a teaching mark; papers of no group; papers without a
    teaching mark. The group is the first whose patterns the text has, or the field its own. Null counts as ''. One
    expression over the row: no join with the rule table.
    """
    text, field = F.coalesce(text, F.lit("")), F.coalesce(field, F.lit(""))
    both = F.concat_ws(" ", text, field)
    teaching, guarded = _hit(both, TEACHING), _hit(both, GUARD)
    about = lambda rule: _hit(text, rule[0]) | _hit(field, rule[1])
    out = (~guarded & about(FIRST_LANGUAGE)) | (~teaching & (about(TRANSLATION) | about(LINGUISTICS)))
    group = F.when(about(GROUPS[0][1:]), GROUPS[0][0])
    for name, *rule in GROUPS[1:]:
        group = group.when(about(rule), name)
    return F.when(~out & teaching, group)


def sql_scope(text: str, field: str) -> str:
    """The same as SQL for engines whose patterns know \\b but cannot look behind: what must not precede is cut out."""

    def hit(c: str, patterns: Sequence[str]) -> str:
        def one(p: str) -> str:
            behind = re.match(r"\(\?<!(\[[^\]]*\])\)(.)", p)
            where = f"regexp_replace({c}, '{behind[1]}{p[behind.end() - 1:][:2]}', '#', 'g')" if behind else c
            body = p[behind.end() - 1 :] if behind else p
            return f"regexp_matches({where}, '{body}')".replace(r"\s", r"[\s\p{Z}]")

        return "(" + " OR ".join(one(p) for p in patterns) + ")"

    both = f"({text} || ' ' || {field})"
    about = lambda rule: f"({hit(text, rule[0])} OR {hit(field, rule[1])})"
    out = f"((NOT {hit(both, GUARD)} AND {about(FIRST_LANGUAGE)}) OR (NOT {hit(both, TEACHING)} AND ({about(TRANSLATION)} OR {about(LINGUISTICS)})))"
    cases = " ".join(f"WHEN {about(rule)} THEN '{name}'" for name, *rule in GROUPS)
    return f"CASE WHEN {out} OR NOT {hit(both, TEACHING)} THEN NULL {cases} END"

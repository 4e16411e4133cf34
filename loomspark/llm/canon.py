"""Mapping free-entered values to a canonical list: exact, then embedded mentions, then token-set similarity."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a canonical list per axis; it is a dimension that every task holds, so its size is checked.
MAX_ENTRIES = 50_000
_WORD = re.compile(r"[^\W_]+")
_LETTER = re.compile(r"[^\W\d_]")


def _clean(text: str) -> str:
    """NFKC, case-folded, '&' as 'and'."""
    return unicodedata.normalize("NFKC", text).casefold().replace("&", " and ")


def _compact(text: str) -> str:
    return "".join(_WORD.findall(text))


@lru_cache(maxsize=200_000)
def _letters(text: str) -> str:
    """Letters as sounds: Hangul syllables as jamo, compound finals split; others as they are."""
    return "".join(_FINAL.get(c, c) for c in "".join(_COMPOUND.get(c, c) for c in unicodedata.normalize("NFD", text)))


def sound_similarity(a: str, b: str) -> float:
    """Edit similarity of two strings of sounds, with or without the silent initial, whichever is greater."""
    return max(edit_similarity(a, b), edit_similarity(a.replace(_SILENT, ""), b.replace(_SILENT, "")))


# Fixed values of Unicode: compound Hangul finals as two finals, and finals as the initial of the same sound.
_COMPOUND = {"ᆪ": "ᆨᆺ", "ᆬ": "ᆫᆽ", "ᆭ": "ᆫᇂ", "ᆰ": "ᆯᆨ", "ᆱ": "ᆯᆷ", "ᆲ": "ᆯᆸ", "ᆳ": "ᆯᆺ", "ᆴ": "ᆯᇀ", "ᆵ": "ᆯᇁ", "ᆶ": "ᆯᇂ", "ᆹ": "ᆸᆺ"}
_FINAL = dict(zip("ᆨᆩᆫᆮᆯᆷᆸᆺᆻᆼᆽᆾᆿᇀᇁᇂ", "ᄀᄁᄂᄃᄅᄆᄇᄉᄊᄋᄌᄎᄏᄐᄑᄒ"))
_SILENT = "ᄋ"
# End of fixed values.


def edit_similarity(a: str, b: str) -> float:
    """1 − edits / longer length, edits with neighbouring letters swapped counting one."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    older: list[int] = []
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            now.append(best)
        older, before = before, now
    return 1 - before[-1] / max(len(a), len(b))


def _parts(text: str) -> list[str]:
    """A string cut where letters, digits and other scripts meet."""
    return re.findall(r"[a-z]+|[0-9]+|[^a-z0-9]+", text)


def _grams(sounds: str) -> set[tuple[str, str]]:
    """Pairs of neighbouring sounds, the two borders included, with and without the silent initial. An edit breaks at
    most three of n + 1 pairs, so strings that agree to 0.7 or more of n sounds share one."""
    bare = sounds.replace(_SILENT, "")
    return set(zip("^" + sounds, sounds + "$")) | set(zip("\x00" + bare, bare + "\x01"))


class CanonMatcher:
    """Matcher of one axis: entries [(canonical value, [other names])] in order of preference."""

    def __init__(self, entries: Sequence[tuple[str, Sequence[str]]], threshold: float = 0.7):
        import ahocorasick

        self.threshold = threshold
        self.exact: dict[str, int] = {}
        self.values = [v for v, _ in entries]
        self.names: list[tuple[str, str, list[str], set[str], int]] = []  # compact, letters, tokens, parts, entry
        self.index: dict[object, list[int]] = {}  # pairs of sounds of names and tokens, tokens, parts -> names
        self.automaton = ahocorasick.Automaton()
        for k, (value, others) in enumerate(entries):
            for name in (value, *others):
                clean = _clean(name)
                compact = _compact(clean)
                if compact and compact not in self.exact:
                    self.exact[compact] = k
                    tokens, parts, sounds = _WORD.findall(clean), set(_parts(compact)), _letters(compact)
                    for key in {*_grams(sounds), *(g for t in tokens for g in _grams(_letters(t))), *tokens, *parts}:
                        self.index.setdefault(key, []).append(len(self.names))
                    self.names.append((compact, sounds, tokens, parts, k))
                    if len(compact) > 1:
                        self.automaton.add_word(compact, (len(compact), k))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.memo: dict[str, int] = {}

    def embedded(self, clean: str) -> int:
        """The entry named inside the text: of non-overlapping mentions, longest first, the longest and then the
        first; -1 if none. Spaces and marks are no part of a mention. A mention that begins with a Latin letter or digit
        begins where a word or another script does, and one of less than four that ends so ends likewise."""
        words = _WORD.findall(clean)
        compact = "".join(words)
        if not len(self.automaton):
            return -1
        found = sorted((-n, end - n + 1, k) for end, (n, k) in self.automaton.iter(compact))
        if not found:
            return -1
        borders, at = {0, len(compact)}, 0
        for w in words:
            for part in _parts(w):
                at += len(part)
                borders.add(at)
        latin = lambda c: c.isascii()
        for n, start, k in found:
            end = start - n
            if (start in borders or not latin(compact[start])) and (end in borders or -n > 3 or not latin(compact[end - 1])):
                return k
        return -1

    def similar(self, clean: str, compact: str) -> int:
        """The entry with the best token-set similarity of at least the threshold, else -1.

        Tokens are the words of the value and runs of neighbouring words; each is held against whole names, by sound, and
        against the set of a name's tokens: a token of the name, a word that begins or ends it and makes up two fifths of
        it, a token that sounds alike, or words that hold every part of the name are partial names. A token that is a
        small part of the value counts a little less. Only names that share a token, a part or a pair of sounds with the
        run are scored; others cannot reach the threshold.
        """
        words = _WORD.findall(clean)
        runs = {"".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(len(words), i + 4) + 1)} | {compact}
        have = {p for w in words for p in _parts(w)}
        keys = {h[:n] for h in have for n in range(1, len(h) + 1)}
        by_part = {k for key in keys for k in self.index.get(key, ())}
        best, score = -1, 0.0
        for run in sorted(runs):
            if len(run) < 2 or not _LETTER.search(run):
                continue
            letters = _letters(run)
            cover = (len(run) / max(1, len(compact))) ** 0.05
            candidates = by_part.union(self.index.get(run, ()), *(self.index.get(g, ()) for g in _grams(letters)))
            for n in sorted(candidates):
                name, sounds, tokens, parts, k = self.names[n]
                s = 0.0
                if abs(len(letters) - len(sounds)) <= 0.4 * max(len(letters), len(sounds)):
                    s = sound_similarity(letters, sounds)
                if run in tokens:
                    s = max(s, 0.86)
                elif len(run) >= 0.4 * len(name) and (name.startswith(run) or name.endswith(run)):
                    s = max(s, 0.8 + 0.05 * name.startswith(run) + 0.1 * len(run) / len(name))
                elif any(len(t) > 3 and len(letters) > 4 and sound_similarity(letters, _letters(t)) >= 0.8 for t in tokens if len(tokens) > 1):
                    s = max(s, 0.75)
                elif len(name) >= 0.4 * len(run) and len(name) > 2 and len(tokens) == 1 and _token_set(have, parts):
                    s = max(s, 0.74)
                if s * cover > score:
                    best, score = k, s * cover
        return best if score >= self.threshold else -1

    def match(self, text: str) -> int:
        """The entry meant, by number, or -1: the whole value, else a mention inside, else similarity."""
        known = self.memo.get(text)
        if known is None:
            clean = _clean(text)
            compact = _compact(clean)
            known = self.exact.get(compact, -1) if compact else -1
            if compact and known < 0:
                known = self.embedded(clean)
            if compact and known < 0:
                known = self.similar(clean, compact)
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[text] = known
        return known


def _token_set(have: set[str], own: set[str]) -> bool:
    """Whether parts of words hold or begin with every part of a name, of which there are two or more."""
    return len(own) > 1 and all(any(h == p or len(p) > 1 and h.startswith(p) for h in have) for p in own)


@lru_cache(maxsize=16)
def matcher(entries: tuple, threshold: float) -> CanonMatcher:
    """The matcher of a list, built once per Python worker."""
    return CanonMatcher(entries, threshold)


def canonical_entries(canon: DataFrame, axis: str = "axis", value: str = "canon_value", aliases: str = "aliases", order: str = "canon_id") -> dict[str, list[tuple[str, list[str]]]]:
    """The canonical list by axis, with the aliases split at semicolons. Its size is checked: it goes to every task."""
    rows = canon.select(axis, value, aliases).where(F.col(axis).isNotNull() & F.col(value).isNotNull()).orderBy(axis, order).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the canonical list has more than {MAX_ENTRIES} entries")
    out: dict[str, list[tuple[str, list[str]]]] = {}
    for a, v, names in rows:
        out.setdefault(a, []).append((v, [n.strip() for n in (names or "").split(";") if n.strip()]))
    return out


def map_values(df: DataFrame, key: str, axes: Sequence[str], canon: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(key, axis, typed, canon_value) for every value of the axis columns that is neither null nor blank.

    canon_value is the entry meant, '' if the value means none (those are the report of unmatched values). An axis
    without canonical entries matches nothing; an empty table gives no row; repeated rows give repeated rows; of the
    other columns none is read. A narrow map: every worker holds the list and a bounded memo of the values it has seen,
    so a value that a third of all rows hold is matched once per worker and nothing is shuffled.
    """
    entries = canonical_entries(canon)
    kind = df.schema[key].dataType.simpleString()
    names = list(axes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [matcher(tuple((v, tuple(n)) for v, n in entries.get(a, [])), threshold) for a in names]
        for batch in batches:
            rows, which, typed, meant = [], [], [], []
            for i, (name, m) in enumerate(zip(names, matchers)):
                for r, text in enumerate(batch.column(i + 1).to_pylist()):
                    if text and not text.isspace():
                        k = m.match(text)
                        rows.append(r)
                        which.append(name)
                        typed.append(text)
                        meant.append(m.values[k] if k >= 0 else "")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(which, pa.string()), pa.array(typed, pa.string()), pa.array(meant, pa.string())], names=["k", "axis", "typed", "canon_value"])

    narrow = df.select(F.col(key).alias("k"), *(F.col(a).cast("string").alias(f"a{i}") for i, a in enumerate(names)))
    return narrow.mapInArrow(run, f"k {kind}, axis string, typed string, canon_value string").withColumnRenamed("k", key)


def typed_otherwise(mapped: DataFrame, canon: DataFrame) -> DataFrame:
    """Only the values that are not letter for letter an entry of their axis."""
    entries = canon.select("axis", F.col("canon_value").alias("typed")).distinct()
    return mapped.join(entries, ["axis", "typed"], "left_anti")

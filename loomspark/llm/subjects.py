"""Subject areas of documents: labels propagated from trusted seeds over a verified document-similarity graph.

Two documents are similar where they share a verified phrase. A phrase that a third of all documents share would make
quadratically many document pairs, so the graph is kept factored: documents are linked to phrases, one row each, and a
label step from document to document is two joins, over the phrase. A phrase is a word, a pair of words or a run of
letters (text without spaces). Verification decides which links exist, not which label they carry. A phrase is verified
if documents that hold it agree on a subject for reasons other than this phrase: seeds by their labels, other documents
by sentences without the phrase. A link is verified if the sentence is not one of passing mention: contexts are learnt
in which the subject of the sentence is, as a rule, no subject of the rest.

Then labels move by DataFrame joins, see propagate: only seeds have labels at first, and they are clamped.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.session import cut, release

#: Labelled documents used to fit the first phrases, at most; beyond it those with the least hash of their id are used.
MAX_SEEDS = 100_000
#: Subject areas, and verified phrases or contexts, that every task holds; more is an error, none is left out.
MAX_AREAS, MAX_PHRASES = 1_000, 400_000
#: Terms that a block may count before it hands its counts on.
BLOCK_TERMS = 250_000
#: Sentences a worker remembers, and their length at most; a memo, the result does not depend on it.
MEMO, MEMO_LETTERS = 20_000, 400
_MARKUP = re.compile(r"<[^<>]{0,80}>|\\[nrt]")
_END = re.compile(r"(?<![0-9])[.!?]+|[.!?]+(?![0-9])|[。！？\n\r]+")
_KEEP = re.compile(r"[^\w\s'-]|[\d_]")
_RUNS = re.compile(r"[^\W\d_ᄀ-ᇿ⺀-힯豈-﫿]+(?:-[^\W\d_ᄀ-ᇿ⺀-힯豈-﫿]+)*|[가-힯]+|[⺀-꓏豈-﫿]+")
_HANGUL, _HAN, _LATIN = re.compile("[가-힯]"), re.compile("[⺀-꓏豈-﫿]"), re.compile("[a-zß-ɏ]")
_HEADS = {"h": 0, "z": 1, "l": 2}


def _script(term: str) -> str:
    c = term[0]
    return "h" if "가" <= c <= "힯" else "z" if "⺀" <= c <= "꓏" or "豈" <= c <= "﫿" else "l"


def _clean(text: str) -> str:
    return unicodedata.normalize("NFKC", html.unescape(_MARKUP.sub("", text))).casefold()


def sentence_terms(text: str) -> list[set[str]]:
    """The terms of every sentence: words and word pairs where words are spaced, runs of 3 and 4 Hangul syllables and of
    2 to 4 Han characters otherwise. Markup, digits and symbols are no part of a term and split none."""
    return [t for s in _END.split(_clean(text)) if (t := _terms_of(_KEEP.sub("", s)))]


def _terms_of(sentence: str) -> set[str]:
    terms: set[str] = set()
    before, syllables = None, []
    for w in _RUNS.findall(sentence):
        kind = _script(w)
        if kind == "l":
            terms.add(w)
            if before:
                terms.add(before + " " + w)
            before = w
            continue
        before = None
        if kind == "h":
            syllables.append(w)
        else:
            for n in (2, 3, 4):
                terms.update([w[i : i + n] for i in range(len(w) - n + 1)])
    run = "".join(syllables)
    for n in (3, 4):
        terms.update([run[i : i + n] for i in range(len(run) - n + 1)])
    return terms


class _Reader:
    """Sentences of a text as (term ids, ids that are no phrase, area, phrases, whether it is a passing mention),
    remembered by their letters: sentences that differ in digits, symbols and markup only, and those that recur, are
    analysed once per memo. Terms are numbered as they come; numbers 0 to 2 stand for the scripts."""

    def __init__(self, phrases: dict[str, tuple[int, float]], passing: set[str]):
        self.phrases, self.passing = phrases, passing
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {"\x00" + s: k for s, k in _HEADS.items()}  # in the order of the numbers
        self.memo: dict[str, tuple] = {}

    def _number(self, terms: Iterable[str]) -> np.ndarray:
        ids = self.ids
        return np.array([ids.setdefault(t, len(ids)) for t in terms], np.int64)

    def read(self, clean: str, numbered: bool = True) -> list[tuple]:
        out = []
        for sentence in _END.split(clean):
            letters = _KEEP.sub("", sentence)
            known = self.memo.get(letters)
            if known is None:
                terms = _terms_of(letters)
                hits = sorted(self.phrases.keys() & terms, key=lambda t: (self.phrases[t][1], t), reverse=True) if self.phrases else []
                known = (
                    (self._number(list(terms)), self._number([t for t in terms if t not in self.phrases]) if hits else None) if numbered and terms else (terms, None)
                ) + (self.phrases[hits[0]][0] if hits else -1, hits, not self.passing.isdisjoint(terms))
                if len(letters) <= MEMO_LETTERS:
                    if len(self.memo) >= MEMO:
                        self.memo.clear()
                    self.memo[letters] = known
            if len(known[0]):
                out.append(known)
        return out


def _main_script(text: str) -> str:
    """The script that makes up most of a text; three Latin letters weigh as one syllable."""
    return max((len(_HANGUL.findall(text)), "h"), (len(_HAN.findall(text)), "z"), (len(_LATIN.findall(text)) // 3, "l"))[1]


class _Counts:
    """Counts of one block of documents by term: documents with a known area, per area the supported ones, and as
    context: sentences with an area, those whose area the rest of the document supports."""

    def __init__(self, n_areas: int):
        self.table = np.zeros((n_areas + 3, 1 << 16), np.int64)

    def add(self, text: str, reader: _Reader, labels: tuple[int, ...] | None) -> None:
        """labels: of a seed, else None. A term is supported if not all sentences of the area hold it."""
        clean = _clean(text)
        if not _RUNS.search(clean):
            return
        sentences = reader.read(clean)
        while len(reader.ids) > self.table.shape[1]:
            self.table = np.concatenate((self.table, np.zeros_like(self.table)), axis=1)
        spoken: dict[int, np.ndarray] = {}  # area -> terms that all its sentences hold
        if labels is None:
            for ids, _, a, _, aside in sentences:
                if a >= 0 and not aside:
                    spoken[a] = np.intersect1d(spoken[a], ids, True) if a in spoken else ids
        else:
            spoken = dict.fromkeys(labels, np.zeros(0, np.int64))
        known, context, right = self.table[:3]
        if labels is not None or spoken:
            plain = [ids for ids, *_, aside in sentences if not aside]
            terms = np.unique(np.concatenate([*plain, [_HEADS[_main_script(clean)]]]).astype(np.int64))
            known[terms] += 1
            for a, all_hold in spoken.items():
                self.table[3 + a, terms] += 1
                self.table[3 + a, all_hold] -= 1
        seen = Counter(a for _, _, a, _, _ in sentences)
        for _, own, a, _, _ in sentences:
            if a >= 0:
                context[own] += 1
                if a in labels if labels is not None else seen[a] > 1:
                    right[own] += 1


def _count_terms(docs: DataFrame, n_areas: int, seeds, phrases: dict, passing: set[str]) -> DataFrame:
    """(term, c0, c1, …) summed over all documents (columns doc_id, text). seeds: broadcast labels by document."""
    width = n_areas + 3
    fitted = docs.sparkSession.sparkContext.broadcast((phrases, passing))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, reader, labels = _Counts(n_areas), _Reader(*fitted.value), seeds.value

        def flush() -> pa.RecordBatch:
            terms, n = list(reader.ids), len(reader.ids)
            at = np.flatnonzero(counts.table[:2, :n].any(axis=0))
            out = pa.RecordBatch.from_arrays([pa.array([terms[i] for i in at], pa.string()), *(pa.array(c[at]) for c in counts.table)], names=["term", *(f"c{k}" for k in range(width))])
            counts.table[:, :n] = 0
            reader.reset()
            return out

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    counts.add(text, reader, labels.get(i))
                    if len(reader.ids) > BLOCK_TERMS:
                        yield flush()
        yield flush()

    rows = docs.mapInArrow(run, "term string, " + ", ".join(f"c{k} bigint" for k in range(width)))
    return rows.groupBy("term").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(width)))


def _wilson(k: Column, n: Column, z: float, upper: bool = False) -> Column:
    """Bound of a share k/n at z standard deviations."""
    p, z2 = k / n, z * z
    spread = z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    return (p + z2 / (2 * n) + (spread if upper else -spread)) / (1 + z2 / n)


def _select(counted: DataFrame, n_areas: int, least: float, purity: float, worst_context: float, odds: float = 8.0, z: float = 1.96) -> tuple[dict[str, tuple[int, float]], set[str]]:
    """Verified phrases {term: (area, weight)} and passing contexts, from the counts of all documents."""
    heads = {r["term"][1]: [r[f"c{k}"] for k in range(n_areas + 3)] for r in counted.where(F.col("term").startswith("\x00")).collect()}  # three rows
    spark = counted.sparkSession
    head = spark.createDataFrame([(s, [v / max(1, h[0]) for v in h[3:]]) for s, h in sorted(heads.items())] or [("l", [0.0] * n_areas)], "script string, prior array<double>")
    script = F.when(F.col("term").rlike("^[가-힯]"), "h").when(F.col("term").rlike("^[⺀-꓏豈-﫿]"), "z").otherwise("l")
    k = F.array(*(F.col(f"c{3 + a}") for a in range(n_areas)))
    terms = counted.where(~F.col("term").startswith("\x00")).select("term", script.alias("script"), F.col("c0").alias("n"), F.array_max(k).alias("top"), F.array_position(k, F.array_max(k)).alias("at"), F.element_at(F.sort_array(k), -2).alias("second") if n_areas > 1 else F.lit(0).alias("second"), F.col("c1").alias("cn"), F.col("c2").alias("ck"))
    terms = terms.join(F.broadcast(head), "script")
    share = F.col("top") / F.col("n")
    prior = F.element_at("prior", F.col("at").cast("int"))
    good = (F.col("top") > 0) & (_wilson(F.col("top"), F.col("n"), z) >= least) & (share >= purity) & (share * (1 - prior) >= odds * prior * (F.col("n") + 0.5 - F.col("top")) / F.col("n")) & (F.col("second") <= 0.6 * F.col("top"))
    chosen = terms.where(good).select("term", (F.col("at") - 1).cast("int").alias("area"), _wilson(F.col("top"), F.col("n"), z).alias("weight")).limit(MAX_PHRASES + 1).collect()
    bad = terms.where((F.col("cn") > 0) & (_wilson(F.col("ck"), F.col("cn"), z, upper=True) <= worst_context)).select("term").limit(MAX_PHRASES + 1).collect()
    if max(len(chosen), len(bad)) > MAX_PHRASES:
        raise ValueError(f"more than {MAX_PHRASES} verified phrases or contexts")
    phrases = {t: (a, round(w, 6)) for t, a, w in chosen}
    return phrases, {t for (t,) in bad if t not in phrases}


def _links(docs: DataFrame, phrases: dict, passing: set[str]) -> DataFrame:
    """(doc_id, phrase): the verified links of documents, those of every sentence that is no passing mention."""
    fitted = docs.sparkSession.sparkContext.broadcast((phrases, passing))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(*fitted.value)
        for batch in batches:
            rows, terms = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    own = {t for *_, hits, aside in reader.read(_clean(text), numbered=False) if not aside for t in hits[:1]}
                    rows += [i] * len(own)
                    terms += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string())], names=["doc_id", "phrase"])

    return docs.mapInArrow(run, "doc_id bigint, phrase string").distinct()


def propagate(links: DataFrame, seeds: DataFrame, n_areas: int, max_rounds: int = 1000, keep: float = 0.5, z: float = 1.28) -> DataFrame:
    """(doc_id, areas ARRAY<INT>) of seeds and of all documents that a label reaches over the links (doc_id, phrase).

    At first only the seeds (doc_id, areas) have labels; they are clamped. In each round every open phrase looks at the
    labelled documents that hold it: it takes the areas that the lower bound (z) of their share finds in at least `keep`
    of them, and is closed; its documents get these areas, beside those they have. So a phrase waits until enough of
    its documents are labelled, an area goes on from document to document, and a document keeps several. Where nothing
    closes so, phrases of few labelled documents close by the one area that most of these share, if there is one. Stops
    when no phrase closes: exact, as phrases are finite and never open again. RuntimeError if max_rounds are not enough;
    with 0 rounds only the seeds come out. A phrase that a third of all documents hold is one row per task after partial
    aggregation.
    """
    edges = cut(links.groupBy("doc_id", "phrase").agg(F.lit(1).alias("one")).drop("one"))
    state = cut(seeds.select("doc_id", "areas", F.lit(True).alias("seed")))
    none = F.array().cast("array<int>")
    for _ in range(max_rounds):
        held = edges.join(state, "doc_id").groupBy("phrase").agg(F.count("*").alias("n"), F.array(*(F.count_if(F.array_contains("areas", a)) for a in range(n_areas))).alias("k"))
        sure = F.filter(F.transform("k", lambda k, a: F.when((k > 0) & (_wilson(k, F.col("n"), z) >= keep), a)), lambda a: a.isNotNull())
        top = F.array_max("k")
        only = F.when((top >= keep * F.col("n")) & (F.size(F.filter("k", lambda k: k == top)) == 1) & (top > 0), F.array((F.array_position("k", top) - 1).cast("int"))).otherwise(none)
        held = cut(held.select("phrase", sure.alias("sure"), only.alias("only")).where((F.size("sure") > 0) | (F.size("only") > 0)))
        closed = held.where(F.size("sure") > 0).select("phrase", F.col("sure").alias("holds"))
        if closed.isEmpty():
            closed = held.select("phrase", F.col("only").alias("holds"))
            if closed.isEmpty():
                return state.select("doc_id", "areas")
        reached = edges.join(closed, "phrase").select("doc_id", F.explode("holds").alias("a")).groupBy("doc_id").agg(F.collect_set("a").alias("fresh"))
        merged = F.when(F.coalesce("seed", F.lit(False)), F.col("areas")).otherwise(F.array_sort(F.array_union(F.coalesce("areas", none), F.coalesce("fresh", none))))
        older = [state, edges, held]
        state = cut(state.join(reached, "doc_id", "full_outer").select("doc_id", merged.alias("areas"), F.coalesce("seed", F.lit(False)).alias("seed")))
        edges = cut(edges.join(closed.select("phrase"), "phrase", "left_anti"))
        release(*older)
    if max_rounds:
        raise RuntimeError(f"subjects: phrases still close after {max_rounds} rounds")
    return state.select("doc_id", "areas")


def subject_areas(documents: DataFrame, areas: DataFrame, labels: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(doc_id, area_code) for every document that is not labelled by hand and every area that is a main matter of it.

    Labels are complete for their documents; repeated ones count once; labels of unknown areas or null ids are left out.
    Null, empty and blank texts have no area; repeated rows of a document are one document; without labels there is
    nothing to propagate and no row. Two passes over the texts, narrow maps with block-wise counts; whole texts.
    ValueError for more than MAX_AREAS areas or MAX_PHRASES verified phrases: none is left out silently.
    """
    codes = [r[0] for r in areas.select("area_code").where("area_code is not null").distinct().orderBy("area_code").limit(MAX_AREAS + 1).collect()]
    if len(codes) > MAX_AREAS:
        raise ValueError(f"more than {MAX_AREAS} subject areas")
    spark, n = documents.sparkSession, len(codes)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    index = F.array_position(F.array(*map(F.lit, codes)), F.col("area_code")) - 1 if codes else F.lit(-1)
    seeds = labels.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), index.cast("int").alias("a")).where("a >= 0").groupBy("doc_id").agg(F.sort_array(F.collect_set("a")).alias("areas"))
    seeds = cut(seeds)
    fit = {r[0]: tuple(r[1]) for r in seeds.orderBy(F.xxhash64("doc_id")).limit(MAX_SEEDS).collect()}
    if not fit:
        return spark.createDataFrame([], "doc_id bigint, area_code string")
    known = spark.sparkContext.broadcast(fit)
    ids = spark.createDataFrame([(i,) for i in fit], "doc_id bigint")  # at most MAX_SEEDS rows
    labelled = cut(docs.join(F.broadcast(ids), "doc_id", "left_semi"))
    phrases, _ = _select(cut(_count_terms(labelled, n, known, {}, set())), n, 0.34, 0.75, 0.5)  # two labelled documents suffice, the corpus verifies
    _, passing = _select(cut(_count_terms(labelled, n, known, phrases, set())), n, 0.5, 0.75, 0.5)
    phrases2, passing2 = _select(cut(_count_terms(docs, n, known, phrases, passing)), n, 0.5, 0.65, 0.45)
    found = propagate(_links(docs, phrases2, passing2), seeds, n, max_rounds)
    named = found.select("doc_id", F.explode("areas").alias("a")).join(seeds.select("doc_id"), "doc_id", "left_anti")
    return named.select("doc_id", F.element_at(F.array(*map(F.lit, codes)), F.col("a") + 1).alias("area_code"))

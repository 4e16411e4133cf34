"""Frequency of every distinct term: occurrences, records that hold it, and a mark for terms of no use."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.packed import distinct_papers, parse_packed
from loomspark.functions.text import keyword_text
from loomspark.llm.dictionary import number_rows
from loomspark.session import cut

#: Identifiers per range of count arrays; distinct terms a block may hold before it hands them on.
RANGE, BLOCK_TERMS = 4096, 400_000
#: Terms of a dictionary that every task may hold; beyond it a block counts by its own dictionary and is joined.
MAX_DICTIONARY = 500_000


def _normalise(entry: str) -> str:
    return keyword_text(unicodedata.normalize("NFKC", entry))


def _terms(text: str | None, memo: dict[str, str]) -> list[str]:
    """The normalised terms of a packed text, in order; those that normalise to '' are none."""
    out = []
    for entry, _ in parse_packed(text):
        term = memo.get(entry)
        if term is None:
            if len(memo) >= BLOCK_TERMS:
                memo.clear()
            term = memo[entry] = _normalise(entry)
        if term:
            out.append(term)
    return out


def _distinct_terms(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, term), distinct: every block hands on its own terms once."""
    names = list(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        seen: list[set[str]] = [set() for _ in names]

        def flush() -> Iterator[pa.RecordBatch]:
            for name, own in zip(names, seen):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(list(own), pa.string())], names=["field", "term"])
                own.clear()

        for batch in batches:
            for i, own in enumerate(seen):
                for text in batch.column(i).to_pylist():
                    if text:
                        own.update(_terms(text, memo))
            if sum(map(len, seen)) > BLOCK_TERMS:
                yield from flush()
        yield from flush()

    return rows.select(*(F.col(f).cast("string") for f in names)).mapInArrow(run, "field string, term string").distinct()


def _encoded_counts(records: DataFrame, fields: Sequence[str], dictionary: DataFrame, size: int) -> DataFrame:
    """(range, offs, occ, rec): records encoded by the dictionary and counted blockwise, an array of occurrences and one
    of records, cut into identifier ranges; a range without counts gives no row."""
    names = list(fields)
    rows = dictionary.select("field", "term", "id").toArrow()  # at most MAX_DICTIONARY rows
    codes: dict[str, dict[str, int]] = {n: {} for n in names}
    for f, t, i in zip(*(c.to_pylist() for c in rows.columns)):
        codes[f][t] = i
    shared = records.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        occ, rec = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for i, name in enumerate(names):
                code = shared.value[name]
                flat: list[int] = []
                lengths = []
                for text in batch.column(i).to_pylist():
                    ids = [code[t] for t in _terms(text, memo)] if text else []
                    flat += ids
                    lengths.append(len(ids))
                ids = np.array(flat, np.int64)
                occ += np.bincount(ids, minlength=size)
                present = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + ids) % size if size else ids
                rec += np.bincount(present, minlength=size)
        for r in range(-(-size // RANGE)):
            at = np.flatnonzero(occ[r * RANGE : (r + 1) * RANGE])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([r]), *(pa.array([v]) for v in (at.astype(np.int32), occ[r * RANGE + at], rec[r * RANGE + at]))], names=["range", "offs", "occ", "rec"])

    return records.select(*(F.col(f).cast("string") for f in names)).mapInArrow(run, "range bigint, offs array<int>, occ array<bigint>, rec array<bigint>")


def _block_counts(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, term, occ, rec): counts of one block of records under its own dictionary; records are distinct rows."""
    names = list(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        occ: list[dict[str, int]] = [{} for _ in names]
        rec: list[dict[str, int]] = [{} for _ in names]

        def flush() -> Iterator[pa.RecordBatch]:
            for i, name in enumerate(names):
                terms = list(occ[i])
                if terms:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array([occ[i][t] for t in terms], pa.int64()), pa.array([rec[i][t] for t in terms], pa.int64())],
                        names=["field", "term", "occ", "rec"],
                    )
                occ[i].clear()
                rec[i].clear()

        for batch in batches:
            for i in range(len(names)):
                o, r = occ[i], rec[i]
                for text in batch.column(i).to_pylist():
                    if not text:
                        continue
                    terms = _terms(text, memo)
                    for term in terms:
                        o[term] = o.get(term, 0) + 1
                    for term in set(terms):
                        r[term] = r.get(term, 0) + 1
            if sum(map(len, occ)) > BLOCK_TERMS:
                yield from flush()
        yield from flush()

    return records.select(*(F.col(f).cast("string") for f in names)).mapInArrow(run, "field string, term string, occ bigint, rec bigint")


def _range_arrays(encoded: DataFrame) -> DataFrame:
    """(range, offs, occ, rec): the encoded counts of a block as sparse arrays per identifier range."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            cuts = np.flatnonzero(np.diff(ids // RANGE)) + 1
            ends = pa.array(np.concatenate(([0], cuts, [len(ids)])).astype(np.int32))
            starts = np.concatenate(([0], cuts)).astype(np.int64)
            values = [(ids % RANGE).astype(np.int32), *(batch.column(k).to_numpy()[order] for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([pa.array(ids[starts] // RANGE), *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in values)], names=["range", "offs", "occ", "rec"])

    return encoded.select("id", "occ", "rec").mapInArrow(run, "range bigint, offs array<int>, occ array<bigint>, rec array<bigint>")


def _sum_ranges(arrays: DataFrame) -> DataFrame:
    """(id, occ, rec): the arrays of a range, however many blocks they come from, are summed one after the other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, occ, rec = None, np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(occ)
            out = pa.RecordBatch.from_arrays([pa.array(at + now * RANGE), pa.array(occ[at]), pa.array(rec[at])], names=["id", "occ", "rec"])
            occ[:] = 0
            rec[:] = 0
            return out

        for batch in batches:
            ranges = batch.column(0).to_numpy()
            offs, first, second = (batch.column(k) for k in (1, 2, 3))
            for i, r in enumerate(ranges):
                if r != now:
                    if now is not None:
                        yield done()
                    now = int(r)
                where = offs[i].values.to_numpy()
                np.add.at(occ, where, first[i].values.to_numpy())
                np.add.at(rec, where, second[i].values.to_numpy())
        if now is not None:
            yield done()

    return arrays.repartition("range").sortWithinPartitions("range").mapInArrow(run, "id bigint, occ bigint, rec bigint")


def term_frequencies(papers: DataFrame, fields: Sequence[str] = ("kw_ko", "kw_en"), rare_records: int = 2, common_percent: int = 5, max_dictionary: int = MAX_DICTIONARY) -> DataFrame:
    """(field, term, occurrences, records, mark) of every distinct term of the packed fields.

    Terms are packed entries, NFKC and keyword-normalised; those that normalise to '' are none. A paper counts once.
    mark is 'rare' for terms in at most rare_records papers, 'common' for terms in more than common_percent % of all
    papers (with or without keywords), else ''; rare goes first. Null, empty and blank fields have no term; no papers,
    no rows. First the global dictionary of all rows, then records are encoded and counted in arrays per block, and the
    arrays are summed by identifier range: a term that a third of all records hold is one number per block. A dictionary
    of more than max_dictionary terms stays distributed: blocks count by their own dictionaries and are joined to it.
    """
    records = distinct_papers(papers, *fields)
    everything = papers.agg(F.count_distinct("arti_id").alias("n_all"))
    dictionary = cut(number_rows(_distinct_terms(papers.where("arti_id is not null"), fields)))
    size = dictionary.count()
    if size <= max_dictionary:
        counts = _sum_ranges(_encoded_counts(records, fields, dictionary, size))
    else:
        counts = _sum_ranges(_range_arrays(_block_counts(records, fields).join(dictionary, ["field", "term"]).select("id", "occ", "rec")))
    out = dictionary.join(counts, "id").crossJoin(F.broadcast(everything))  # one row: the number of papers
    mark = F.when(F.col("rec") <= rare_records, "rare").when(F.col("rec") * 100 > F.col("n_all") * common_percent, "common").otherwise("")
    return out.select("field", "term", F.col("occ").alias("occurrences"), F.col("rec").alias("records"), mark.alias("mark"))

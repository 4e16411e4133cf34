"""Exact byte-level BPE encoding in linear time.

Token bytes are mapped to Latin-1 so that a pyahocorasick automaton, which works on strings, finds all vocabulary
matches of a piece in one pass. From the longest match at each position the encoder backtracks over shorter prefixes;
two tokens may stand side by side only if no merge would have crossed their border, which is decided by undoing merges
and memoised. Every position is refuted at most once, so the time is linear in the length of the piece, and the result
is the one the merge rules give.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabulary files; a parameter of every function here.
TOKENIZER_DIR = os.environ.get("LOOMSPARK_TOKENIZERS", "/opt/tokenizers")
#: The pre-tokenisation pattern published with the 50k byte-level vocabulary.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Memo bounds of one Python worker, in entries; the memos are emptied beyond, which costs time and changes nothing.
PIECE_MEMO, PAIR_MEMO, PIECE_MEMO_BYTES = 200_000, 1_000_000, 64


def _byte_of_symbol() -> dict[str, int]:
    """The published printable stand-in of each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairEncoder:
    """Encoder of one vocabulary file with merges (tokenizers' JSON of kind BPE, byte level)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        byte = _byte_of_symbol()
        special = {t for t in model["vocab"] if any(c not in byte for c in t)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        symbols = [t for t in model["vocab"] if t not in special and (len(t) == 1 or t in made)]
        rank = {a + b: 256 + k for k, (a, b) in enumerate(merges)}
        singles = {t: k for k, t in enumerate(sorted((t for t in symbols if len(t) == 1), key=model["vocab"].get))}
        #: Tokens are numbered by merge order inside; out[] gives the id of the vocabulary.
        number = singles | rank
        self.out = [0] * len(number)
        self.size = [0] * len(number)
        self.parts = [(k, k) for k in range(len(number))]
        self.merged: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        latin: dict[str, int] = {}
        for t, k in number.items():
            text = "".join(chr(byte[c]) for c in t)
            latin[text] = k
            self.out[k], self.size[k] = model["vocab"][t], len(text)
            self.automaton.add_word(text, k)
        self.automaton.make_automaton()
        for a, b in merges:
            self.parts[number[a + b]] = (number[a], number[b])
            self.merged[number[a] << 20 | number[b]] = number[a + b]
        self.shorter = [-1] * len(number)
        for text, k in latin.items():
            self.shorter[k] = next((latin[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in latin), -1)
        self.split = regex.compile(PIECES).findall
        self.pieces: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: undo the later merge on either side; no older merge may join what meets."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        parts, merged, limit, ok = self.parts, self.merged, 1 << 60, True
        while True:
            joined = merged.get(a << 20 | b)
            if joined is not None and joined < limit:
                ok = False
                break
            if a > b:
                order = (True, False)
            else:
                order = (False, True)
            for left in order:
                if left:
                    limit, inner = a, parts[a][1]
                    if inner != a:
                        a = inner
                        break
                else:
                    limit, inner = b + 1, parts[b][0]
                    if inner != b:
                        b = inner
                        break
            else:
                break
        if len(self.pairs) >= PAIR_MEMO:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        n, size, shorter = len(raw), self.size, self.shorter
        longest = [0] * n
        for end, k in self.automaton.iter(raw):
            longest[end - size[k] + 1] = k  # later ends are longer
        open_at = bytearray(b"\x01") * (n + 1)
        tokens: list[int] = []
        at, k = 0, longest[0]
        while at < n:
            last = tokens[-1] if tokens else -1
            while k >= 0:
                end = at + size[k]
                if open_at[end] and (last < 0 or self._compatible(last, k)):
                    tokens.append(k)
                    at = end
                    k = longest[at] if at < n else -1
                    break
                k = shorter[k]
            else:
                open_at[at] = 0
                k = tokens.pop()
                at -= size[k]
                k = shorter[k] if not open_at[at + size[k]] else k
        out = self.out
        return [out[k] for k in tokens]

    def _remember(self, piece: str) -> list[int]:
        known = self.encode_piece(piece)
        if len(piece) <= PIECE_MEMO_BYTES:
            if len(self.pieces) >= PIECE_MEMO:
                self.pieces.clear()
            self.pieces[piece] = known
        return known

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and '' give []. Names of special tokens are ordinary text."""
        ids: list[int] = []
        if text:
            get = self.pieces.get
            for piece in self.split(text):
                known = get(piece)
                ids += self._remember(piece) if known is None else known
        return ids

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        n = 0
        if text:
            get = self.pieces.get
            for piece in self.split(text):
                known = get(piece)
                n += len(self._remember(piece) if known is None else known)
        return n


@lru_cache(maxsize=4)
def encoder(path: str) -> BytePairEncoder:
    """The encoder of a vocabulary file, built once per Python worker."""
    return BytePairEncoder(path)


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row: whole texts, no special tokens, [] for null and empty text.

    A narrow map over Arrow batches, no shuffle; repeated rows give repeated rows, a null key stays null, and no other
    column is read. A worker holds the vocabulary, two bounded memos and one batch.
    """
    import numpy as np

    path, kind = f"{folder}/{vocabulary}.json", df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for whole in batches:
            at = 0
            while at < whole.num_rows:  # a slice at a time: a list of ids takes far more room than its text
                batch = whole.slice(at, 1024)
                at += batch.num_rows
                flat: list[int] = []
                ends = np.zeros(batch.num_rows + 1, np.int32)
                for i, t in enumerate(batch.column(1).to_pylist(), 1):
                    flat += bpe.encode(t)
                    ends[i] = len(flat)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(flat, np.int32, len(flat))))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["k", "ids"])

    out = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, ids array<int>")
    return out.select(F.col("k").alias(key), "ids")


def token_counter(vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
    """A column function: number of tokens of a text (BIGINT, 0 for null and empty)."""
    path = f"{folder}/{vocabulary}.json"

    def count(texts: pd.Series) -> pd.Series:
        bpe = encoder(path)
        return pd.Series([bpe.count(t) for t in texts], dtype="int64")

    return F.pandas_udf(count, "bigint")

"""Items that appear together: pair counts as a blocked Gram matrix of binary baskets, and their lift over chance."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.packed import distinct_papers, parse_packed
from loomspark.functions.text import author_key
from loomspark.llm.dictionary import number_rows
from loomspark.session import cut

#: Items of a basket held in one row; larger baskets are cut into tiles of this size, whose products run apart.
TILE = 512
#: Pairs that a record block expands before it folds them; a worker never holds more than twice as many.
BLOCK_PAIRS = 2_000_000


def author_baskets(papers: DataFrame) -> DataFrame:
    """(basket, item, size): the distinct authors of each paper as name|institution, entries without one left out.

    Entries are NFKC with white space runs as one space. Null, empty and blank author fields are empty baskets.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for batch in batches:
            rows, items, sizes = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                own = {}
                for entry, _ in parse_packed(text):
                    key = memo.get(entry)
                    if key is None:
                        if len(memo) > 300_000:
                            memo.clear()
                        key = memo[entry] = author_key(re.sub(r"\s+", " ", unicodedata.normalize("NFKC", entry)))
                    if key[-1] != "|" and key[0] != "|":
                        own[key] = None
                rows += [i] * len(own)
                items += own
                sizes += [len(own)] * len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, pa.string()), pa.array(sizes, pa.int32())], names=["basket", "item", "size"])

    return distinct_papers(papers, "authors").mapInArrow(run, "basket string, item string, size int")


def _fold(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, where = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(where, np.concatenate(counts), len(code)).astype(np.int64)


def _gram(rows: DataFrame) -> DataFrame:
    """(a, b, n) with a < b: sum of X'Y over the blocks of rows (xs, ys); ys null means X'X above the diagonal.

    xs and ys are the identifiers of a basket's tile, sorted. Baskets of one size are one index product; a block folds
    equal pairs before it hands them on, so the shuffle has one row per block and pair.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead: list[np.ndarray] = []
        behind: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            a, b = np.concatenate(ahead), np.concatenate(behind)
            ids, where = np.unique(np.concatenate((a, b)), return_inverse=True)
            m, n = len(ids), len(a)
            code, count = np.unique(where[:n].astype(np.int64) * m + where[n:], return_counts=True)
            ahead.clear()
            behind.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids[code // m]), pa.array(ids[code % m]), pa.array(count.astype(np.int64))], names=["a", "b", "n"])

        def products(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """The pairs of a batch, no more than BLOCK_PAIRS or those of one row at a time."""
            for_size: dict[int, list[np.ndarray]] = {}
            for x, y in zip(batch.column(0), batch.column(1)):
                xs = x.values.to_numpy()
                if y.is_valid:
                    ys = y.values.to_numpy()
                    yield np.repeat(xs, len(ys)), np.tile(ys, len(xs))
                else:
                    for_size.setdefault(len(xs), []).append(xs)
            for k, own in for_size.items():
                i, j = np.triu_indices(k, 1)
                step = max(1, BLOCK_PAIRS // max(1, len(i)))
                for s in range(0, len(own), step):
                    grid = np.stack(own[s : s + step])
                    yield grid[:, i].ravel(), grid[:, j].ravel()

        for batch in batches:
            for a, b in products(batch):
                ahead.append(np.minimum(a, b))
                behind.append(np.maximum(a, b))
                held += len(a)
                if held >= BLOCK_PAIRS:
                    yield block()
                    held = 0
        if held:
            yield block()

    return rows.select("xs", "ys").mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def cooccurrence(baskets: DataFrame, n_baskets: DataFrame, min_together: int = 5, min_lift: int = 3) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, lift) of the pairs with n_ab >= min_together and lift >= min_lift.

    baskets: distinct (basket, item) rows with the basket's size; n_baskets: one row n_all, the number of all baskets,
    empty ones included. lift = n_ab · n_all / (n_a · n_b). Items in fewer than min_together baskets cannot reach
    min_together with any other, so they are left out before pairs are made; the result is whole. item_a < item_b by
    code point. Rows with a null basket or item count nowhere.
    """
    known = cut(baskets.where("basket is not null and item is not null").select("basket", "item", "size"))
    often = known.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= min_together)
    items = cut(number_rows(often))
    tile_count = F.ceil(F.col("size") / TILE)
    coded = known.join(items.select("item", "id"), "item").select("basket", "size", F.when(F.col("size") > 2 * TILE, F.pmod(F.xxhash64("item"), tile_count)).otherwise(F.lit(-1)).alias("tile"), "id")
    tiles = cut(coded.groupBy("basket", "tile").agg(F.sort_array(F.collect_list("id")).alias("xs"), F.max(tile_count).alias("tiles")))
    own = tiles.select("xs", F.lit(None).cast("array<bigint>").alias("ys")).where(F.size("xs") > 1)
    # every two tiles of a basket meet under a key of their own, so the products of one basket run in many tasks
    big = tiles.where("tile >= 0")
    later = big.where("tile + 1 < tiles").select("basket", F.col("tile").alias("t1"), F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("t2"), "xs")
    earlier = big.where("tile > 0").select("basket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tile") - 1)).alias("t1"), F.col("tile").alias("t2"), F.col("xs").alias("ys"))
    across = later.join(earlier, ["basket", "t1", "t2"]).select("xs", "ys")
    pairs = _gram(own.unionByName(across)).where(F.col("n") >= min_together)
    left = items.select(F.col("id").alias("a"), F.col("item").alias("ia"), F.col("n").alias("na"))
    right = items.select(F.col("id").alias("b"), F.col("item").alias("ib"), F.col("n").alias("nb"))
    named = pairs.join(left, "a").join(right, "b").crossJoin(F.broadcast(n_baskets))  # one row: the number of baskets
    flip = F.col("ia") > F.col("ib")
    pick = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    kept = named.where(F.col("n") * F.col("n_all") >= min_lift * F.col("na") * F.col("nb"))
    return kept.select(pick("ia", "ib").alias("item_a"), pick("ib", "ia").alias("item_b"), pick("na", "nb").alias("n_a"), pick("nb", "na").alias("n_b"), F.col("n").alias("n_ab"), (F.col("n") * F.col("n_all") / (F.col("na") * F.col("nb"))).alias("lift"))

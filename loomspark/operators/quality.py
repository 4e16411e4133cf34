"""Data quality: enum domains, duplicates, completeness, review queues, snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(key, rule) for every rule a row breaks: one pass, all rules as columns of one array."""
    hits = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())))
    return df.select(key, F.explode(hits).alias("rule"))


def not_in(column: str, allowed: Sequence[str]) -> Column:
    """Broken if the value is neither null, '' nor one of the allowed."""
    return F.col(column).isNotNull() & (F.col(column) != "") & ~F.col(column).isin(*allowed)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, times) of keys that occur more than once."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("times")).where("times > 1")


def missing_by(expected: DataFrame, present: DataFrame, key: str, by: str) -> DataFrame:
    """(by, missing): expected keys that are not present."""
    return expected.join(present.select(key), key, "left_anti").groupBy(by).agg(F.count("*").alias("missing"))


def assert_empty(df: DataFrame, what: str) -> None:
    """Raise with up to five offending rows."""
    rows = df.limit(5).collect()
    if rows:
        raise AssertionError(f"{what}: {rows}")


def review_queue(df: DataFrame, key: str, reasons: Mapping[str, Column]) -> DataFrame:
    """(key, why) of rows for which a reason holds, reasons joined by ' / '."""
    why = F.concat_ws(" / ", *(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons.items()))
    return df.select(key, why.alias("why")).where("why <> ''")


def snapshot(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Order-independent fingerprint of a table: rows and the sum of the 128 bits of two row hashes."""
    body = F.struct(*(F.col(f"`{c}`").cast("string") for c in sorted(df.columns)))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(body).cast("decimal(20,0)")).alias("h1"), F.sum(F.xxhash64(F.lit(7), body).cast("decimal(20,0)")).alias("h2"))

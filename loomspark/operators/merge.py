"""Joins that change tables: sequential updates, restoring, upserts, defaults, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update_from(base: DataFrame, updates: DataFrame, key: str, when: Column, sets: Mapping[str, Column]) -> DataFrame:
    """MERGE's matched branch: columns of base set where an update of the same key exists and `when` holds.

    updates must have one row per key; its columns are addressed as 'u.name', those of base as 'b.name'.
    """
    joined = base.alias("b").join(updates.alias("u"), F.col(f"b.{key}") == F.col(f"u.{key}"), "left")
    hit = F.col(f"u.{key}").isNotNull() & F.coalesce(when, F.lit(False))
    return joined.select(*(F.when(hit, sets[c]).otherwise(F.col(f"b.{c}")).alias(c) if c in sets else F.col(f"b.{c}") for c in base.columns))


def unmatched(updates: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Updates that found no row."""
    return updates.join(base.select(key), key, "left_anti")


def upsert(base: DataFrame, new: DataFrame, key: str, source: str = "src") -> DataFrame:
    """Rows of both; where both have the key, values of base win unless null or ''; source is base, new or both."""
    b, n = base.alias("b"), new.alias("n")
    joined = b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"), "full_outer")
    names = [c for c in base.columns if c != key]
    own = lambda c: F.nullif(F.col(f"b.{c}"), F.lit("")) if dict(base.dtypes)[c] == "string" else F.col(f"b.{c}")
    merged = [F.coalesce(own(c), F.col(f"n.{c}")).alias(c) if c in new.columns else F.col(f"b.{c}").alias(c) for c in names]
    label = F.when(F.col(f"n.{key}").isNull(), "base").when(F.col(f"b.{key}").isNull(), "new").otherwise("both")
    return joined.select(F.coalesce(f"b.{key}", f"n.{key}").alias(key), *merged, label.alias(source))


def left_with_default(df: DataFrame, cache: DataFrame, key: str, defaults: Mapping[str, object]) -> DataFrame:
    """Left join to a cache; what it lacks gets the default record."""
    return df.join(cache.select(key, *defaults), key, "left").na.fill(dict(defaults))


def latest(df: DataFrame, key: Sequence[str], at: str, columns: Sequence[str]) -> DataFrame:
    """One row per key: the one with the latest time, ties to the greatest values; folded before the shuffle."""
    best = df.groupBy(*key).agg(F.max(F.struct(F.col(at), *map(F.col, columns))).alias("best"))
    return best.select(*key, *(F.col(f"best.{c}").alias(c) for c in (at, *columns)))


def keep_first(df: DataFrame, key: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """One row per key: the first in order. min over a struct instead of row_number: no window gathers a hot key."""
    best = df.groupBy(*key).agg(F.min(F.struct(F.col(order), *map(F.col, columns))).alias("best"))
    return best.select(*key, *(F.col(f"best.{c}").alias(c) for c in (order, *columns)))


def compare(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, before, after) of the values that differ between two versions, null-safe."""
    joined = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"l.{c}").cast("string").alias("before"), F.col(f"r.{c}").cast("string").alias("after")) for c in columns)))
    return joined.select(F.col(f"l.{key}").alias(key), each.alias("d")).select(key, "d.*").where(~F.col("before").eqNullSafe(F.col("after")))


def change_matrix(df: DataFrame, before: str, after: str) -> DataFrame:
    """(before, after, n), null as ''."""
    return df.groupBy(F.coalesce(before, F.lit("")).alias("before"), F.coalesce(after, F.lit("")).alias("after")).agg(F.count("*").alias("n"))

"""Ranks, top lists, quantile conventions and set algebra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import cut, small_side


def top_with_ties(df: DataFrame, value: str, k: int) -> DataFrame:
    """Rows whose value reaches the k-th greatest, with their competition rank.

    The k-th value comes from a distributed top-k, so that no window runs over the whole table; only the rows that
    reach it are ranked.
    """
    cut = df.where(F.col(value).isNotNull()).orderBy(F.desc(value)).limit(k).agg(F.min(value).alias("cut"))
    best = df.crossJoin(F.broadcast(cut)).where(F.col(value) >= F.col("cut")).drop("cut")  # one row
    counts = best.groupBy(value).agg(F.count("*").alias("c"))
    ranks = counts.select(value, (F.sum("c").over(Window.orderBy(F.desc(value))) - F.col("c") + 1).cast("int").alias("rank"))  # at most k values
    return best.join(F.broadcast(ranks), value)


def top_per_group(counts: DataFrame, group: str, item: str, n: str, k: int) -> DataFrame:
    """The k most frequent items of each group, ties by item: counts are per item already, and a first cut per task
    keeps what can be among the k."""
    w = Window.partitionBy(group).orderBy(F.desc(n), F.asc(item))
    return counts.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def in_enum_order(column: str, order: Sequence[str]) -> Column:
    """Sort key by a list of values; others after them."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.when(at > 0, at).otherwise(len(order) + 1)


def empirical(values: Column, index: Column | int) -> Column:
    """The value at a 0-based index of the sorted values (an ARRAY column)."""
    return F.element_at(F.array_sort(values), (F.lit(index) if isinstance(index, int) else index).cast("int") + 1)


def quantiles(df: DataFrame, by: Sequence[str], value: str, reps: int) -> DataFrame:
    """Per group of at most `reps` resamples: lower median (index n//2), 2.5 % and 97.5 % bounds (index int(p·n)),
    5 % and 95 % as int(.05n) and int(.95n)−1, mean and population deviation. The groups are resamples: their size is
    the number of repetitions, a parameter, not data."""
    if reps > 1_000_000:
        raise ValueError("too many repetitions for exact quantiles")
    got = df.groupBy(*by).agg(F.collect_list(value).alias("v"), F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    at = lambda p: F.floor(F.col("n") * p)
    return got.select(
        *by, "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"),
        empirical(F.col("v"), F.floor(F.col("n") / 2)).alias("median"), empirical(F.col("v"), at(0.025)).alias("lo"), empirical(F.col("v"), F.least(F.col("n") - 1, at(0.975))).alias("hi"),
        empirical(F.col("v"), at(0.05)).alias("p05"), empirical(F.col("v"), F.greatest(F.lit(0), at(0.95) - 1)).alias("p95"),
    )


def percentile_rank(df: DataFrame, by: Sequence[str], value: str, observed: Column) -> DataFrame:
    """Percentage of the values that do not exceed the observed one."""
    return df.groupBy(*by).agg(F.round(100.0 * F.avg((F.col(value) <= observed).cast("int")), 6).alias("percentile"))


def overlap(df: DataFrame, item: str, group: str, groups: Sequence[str]) -> DataFrame:
    """(present_in, items): how many distinct items occur in exactly which of the groups."""
    flags = df.where(F.col(group).isin(*groups)).groupBy(item).agg(*(F.max((F.col(group) == g).cast("int")).alias(f"g{k}") for k, g in enumerate(groups)))
    label = F.concat_ws("+", *(F.when(F.col(f"g{k}") == 1, F.lit(g)) for k, g in enumerate(groups)))
    return flags.groupBy(label.alias("present_in")).agg(F.count("*").alias("items"))


def same_set(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: members of a not in b, members of b not in a, and whether the sets are equal."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    both = x.withColumn("in_a", F.lit(1)).join(y.withColumn("in_b", F.lit(1)), key, "full_outer")
    out = both.agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))
    return out.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def number_within(df: DataFrame, by: str, order: Sequence[str], name: str = "rank") -> DataFrame:
    """df with the 0-based place of every row in its group, by the order columns.

    Rows are range-partitioned, so a group with a third of all rows lies in many tasks; a task numbers its own rows, and
    only the row counts per task and group are summed up. No window over a group.
    """
    split = 33  # monotonically_increasing_id puts the partition above this many bits
    ranged = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    local = cut(ranged.withColumn("__mono", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__mono", split))
    sizes = local.groupBy("__part", F.col(by).alias("__by")).agg(F.count("*").alias("__n"), F.min("__mono").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy("__by").orderBy("__part")) - F.col("__n")
    starts = small_side(cut(sizes.select(F.col("__part").alias("__p"), "__by", (before - F.col("__first")).alias("__shift"))))  # one row per task and group in it
    joined = local.join(starts, (F.col("__part") == F.col("__p")) & F.col(by).eqNullSafe(F.col("__by")))
    return joined.select(*df.columns, (F.col("__mono") + F.col("__shift")).alias(name))


def exact_median(df: DataFrame, by: str, value: str, name: str = "median") -> DataFrame:
    """(by, median): the mean of the two middle values of each group, nulls left out; values are ranked by range, so that
    no task holds all values of a group."""
    ranked = number_within(df.where(F.col(value).isNotNull()).select(by, value), by, [value])
    n = ranked.groupBy(by).agg(F.count("*").alias("__n"))
    middle = ranked.join(n, by).where((F.col("rank") == F.floor((F.col("__n") - 1) / 2)) | (F.col("rank") == F.floor(F.col("__n") / 2)))
    return middle.groupBy(by).agg(F.avg(value).alias(name))


def collated(c: Column | str, collation: str = "UNICODE") -> Column:
    """Sort key by a collation of ICU; UNICODE is the root collation."""
    return F.collate(c, collation)


def collated_places(df: DataFrame, column: str, name: str = "place", collation: str = "UNICODE") -> DataFrame:
    """df of distinct words with the 1-based place of each by the collation, equal ones by code point. Words are
    range-partitioned by the collation and numbered per task; no window over the table."""
    keyed = df.withColumn("__all", F.lit(0)).withColumn("__key", collated(column, collation))
    return number_within(keyed, "__all", ["__key", column], "__place").select(*df.columns, (F.col("__place") + 1).alias(name))

"""Counts over categories: dense cross-tabs, totals, shares, roll-ups, occupied cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def values(df: DataFrame, name: str, items: Sequence) -> DataFrame:
    """A one-column relation of constants, in order, with its ordinal."""
    kind = "int" if items and isinstance(items[0], int) else "string"
    return df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(items)], f"`{name}` {kind}, `{name}_ord` int")


def dense_crosstab(df: DataFrame, row: str, col: str, rows: Sequence, cols: Sequence, count: str = "n") -> DataFrame:
    """(row, col, n) over the full grid of the given values, absent cells 0; values outside the grid are not counted."""
    grid = values(df, row, rows).crossJoin(values(df, col, cols)).select(row, col)  # constants only
    return grid.join(df.groupBy(row, col).agg(F.count("*").alias(count)), [row, col], "left").na.fill(0, [count])


def with_totals(df: DataFrame, row: str, col: str, total: str = "(all)", count: str = "n") -> DataFrame:
    """(row, col, n) with row, column and grand totals, told from null values by grouping()."""
    cube = df.cube(row, col).agg(F.count("*").alias(count), F.grouping(row).alias("gr"), F.grouping(col).alias("gc"))
    label = lambda c, g: F.when(F.col(g) == 1, total).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return cube.select(label(row, "gr").alias(row), label(col, "gc").alias(col), count)


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """Percentage, null where the whole is 0."""
    return F.round(F.try_divide(part * 100.0, whole), digits)


def group_shares(df: DataFrame, by: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Counts per `by` and their percentage of the total per `within`: the total is joined, not windowed, so that a
    group with a third of all rows is aggregated map-side and never gathered in one task."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = n.groupBy(*within).agg(F.sum("n").alias("total"))
    out = n.join(total, list(within)) if within else n.crossJoin(F.broadcast(total))  # one row without groups
    return out.withColumn("pct", share(F.col("n"), F.col("total"))).drop("total")


def roll_up(df: DataFrame, code: str, mapping: Sequence[tuple[str, str]], default: str | None = None) -> DataFrame:
    """(label, n): codes counted under their label; codes without one go to `default`, or raise if there is none."""
    dim = df.sparkSession.createDataFrame(list(mapping), f"`{code}` string, label string")
    joined = df.groupBy(code).agg(F.count("*").alias("n")).join(F.broadcast(dim), code, "left")
    label = F.coalesce("label", F.lit(default) if default is not None else F.raise_error(F.concat(F.lit("no label for "), F.coalesce(code, F.lit("null")))))
    return joined.select(label.cast("string").alias("label"), "n").groupBy("label").agg(F.sum("n").alias("n"))


def bundle_share(df: DataFrame, by: str, column: str, members: Sequence[str]) -> DataFrame:
    """(by, bundled, n, pct): rows whose column is one of the members, of all rows."""
    got = df.groupBy(by).agg(F.count_if(F.col(column).isin(*members)).alias("bundled"), F.count("*").alias("n"))
    return got.withColumn("pct", share(F.col("bundled"), F.col("n")))


def occupied_cells(df: DataFrame, by: str, cell: Sequence[str]) -> DataFrame:
    """(by, occupied, n): distinct value tuples, and rows."""
    cells = df.groupBy(by, *cell).agg(F.count("*").alias("n"))
    return cells.groupBy(by).agg(F.count("*").alias("occupied"), F.sum("n").alias("n"))


def gap_types(df: DataFrame, group: str, small: str, row: str, col: str, rows: Sequence, cols: Sequence, thresholds: Sequence[int]) -> DataFrame:
    """(threshold, kind, cells): every cell of the grid typed by what the small group and the others have in it.

    occupied: the small group has rows; gap: it has none and the others reach the threshold; thin: the others have some
    but fewer; empty: nobody has any.
    """
    here = F.coalesce(F.col(group) == small, F.lit(False))
    counted = df.groupBy(row, col).agg(F.count_if(here).alias("own"), F.count_if(~here).alias("lead"))
    grid = values(df, row, rows).crossJoin(values(df, col, cols)).select(row, col)  # constants only
    full = grid.join(counted, [row, col], "left").na.fill(0, ["own", "lead"])
    kind = F.when(F.col("own") > 0, "occupied").when(F.col("lead") >= F.col("threshold"), "gap").when(F.col("lead") > 0, "thin").otherwise("empty")
    each = full.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return each.groupBy("threshold", kind.alias("kind")).agg(F.count("*").alias("cells"))

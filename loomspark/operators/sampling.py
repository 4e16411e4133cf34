"""Reproducible sampling: md5-ordered draws, rarefaction, stratified quotas, size-matched resamples."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators.ranking import number_within
from loomspark.session import shuffle_tasks

#: Units that one repetition of rank_draws may draw; it holds them in a row.
MAX_DRAW = 2_000


def draw_key(seed: int, rep: Column, unit: Column) -> Column:
    """The order of a unit in a repetition: md5 of 'seed|rep|unit', the same in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), unit.cast("string")))


def simple_draws(df: DataFrame, by: str, unit: str, n: int, reps: int, seed: int) -> DataFrame:
    """df's rows of `reps` samples of n units per group, without replacement, with the column rep.

    The n least keys per (group, rep) are cut per task first (a window of row_number <= n pushes a group limit below the
    shuffle), so a draw moves n rows per task and repetition and not the table.
    """
    each = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("__key", draw_key(seed, F.col("rep"), F.col(unit)))
    w = Window.partitionBy(by, "rep").orderBy("__key")
    return each.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r", "__key")


def rank_draws(df: DataFrame, by: str, unit: str, n: int, reps: int, seed: int) -> DataFrame:
    """df's rows of `reps` simple random samples of n units per group, without replacement, with the column rep.

    The rows of a group are numbered once, in the order of unit; a repetition draws n numbers by itself (for j from N-n+1
    to N a random number up to j, or j if that is drawn already, which makes every subset equally likely) and fetches
    these rows. So the work grows with the rows drawn and not with rows x repetitions. The random number of step j is 48
    bits of the md5 of 'seed|group|rep|j' modulo j. A group of n or fewer is taken whole. Null groups are not drawn.
    """
    if n > MAX_DRAW:
        raise ValueError(f"more than {MAX_DRAW} units a draw; use simple_draws")
    ranked = number_within(df.where(F.col(by).isNotNull()), by, [unit], "__rank")
    each = ranked.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__size")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    each = each.repartition(shuffle_tasks(df.sparkSession), "__by", "rep")  # few small rows but much work each: a number given here is kept

    def step(drawn: Column, j: Column) -> Column:
        text = F.concat_ws("|", F.lit(str(seed)), F.col("__by").cast("string"), F.col("rep").cast("string"), j.cast("string"))
        t = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint") % j
        return F.array_append(drawn, F.when(F.array_contains(drawn, t), j - 1).otherwise(t))

    start = F.greatest(F.lit(1).cast("bigint"), F.col("__size") - n + 1)
    drawn = F.aggregate(F.sequence(start, F.col("__size")), F.array().cast("array<bigint>"), step)
    picks = each.select(F.col("__by").alias("__g"), "rep", F.explode(drawn).alias("__pick"))
    rows = ranked.select(F.col(by).alias("__g"), F.col("__rank").alias("__pick"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"))
    return picks.join(rows, ["__g", "__pick"]).select("__row.*", "rep")


def seeded_indices(spark: SparkSession, population: int, n: int, reps: int, seed: int) -> DataFrame:
    """(rep, idx): indices of Mersenne Twister samples, `reps` calls of one stream; for replay of seeded runs."""
    rng = random.Random(seed)
    rows = [(r, i) for r in range(1, reps + 1) for i in rng.sample(range(population), n)]
    return spark.createDataFrame(rows, "rep int, idx int")


def quotas(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """(stratum, size, quota): largest-remainder allocation of n over the strata; ties by stratum."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    exact = sizes.crossJoin(F.broadcast(total)).withColumn("num", F.col("size") * n)  # one row
    base = exact.withColumn("base", F.floor(F.col("num") / F.col("total"))).withColumn("rest", F.col("num") % F.col("total"))
    left = F.lit(n) - F.sum("base").over(Window.partitionBy())  # one row per stratum
    return base.withColumn("left", left).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("rest"), stratum))).select(stratum, "size", (F.col("base") + (F.col("pos") <= F.col("left")).cast("int")).alias("quota"))


def stratified(df: DataFrame, stratum: str, unit: str, n: int, seed: int, take_all: Sequence[str] = ()) -> DataFrame:
    """df's rows: strata in take_all whole, the others by quota, in md5 order within the stratum."""
    rest = df.where(~F.coalesce(F.col(stratum).isin(*take_all), F.lit(False))) if take_all else df
    q = quotas(rest, stratum, n)
    key = draw_key(seed, F.lit(0), F.col(unit))
    keyed = rest.withColumn("__key", key)
    w = Window.partitionBy(stratum).orderBy("__key")
    ranked = keyed.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    drawn = ranked.join(q.select(stratum, "quota"), stratum).where(F.col("__r") <= F.col("quota")).select(*df.columns)
    return drawn.unionByName(df.where(F.col(stratum).isin(*take_all))) if take_all else drawn


def occupancy(draws: DataFrame, by: str, cell: Sequence[str]) -> DataFrame:
    """(by, rep, cells): distinct cells per draw."""
    return draws.groupBy(by, "rep").agg(F.count_distinct(*cell).alias("cells"))

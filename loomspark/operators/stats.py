"""Exact tests and agreement: hypergeometric tails, kappa, lags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STIRLING_FROM = 256
#: Terms of a hypergeometric sum go this many standard deviations far, and at least FLOOR_TERMS; what lies beyond is
#: less than a double can tell from 0.
DEVIATIONS, FLOOR_TERMS = 40, 200


def log_factorial(n: Column) -> Column:
    """ln n! without a table: the exact sum below STIRLING_FROM, the series (error under 1e-15 relative) from there."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(STIRLING_FROM))).cast("int")), F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))
    y = F.greatest(x, F.lit(1.0))
    series = y * F.log(y) - y + 0.5 * F.log(2 * 3.141592653589793 * y) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return F.when(n < 0, F.lit(None).cast("double")).when(n < STIRLING_FROM, small).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric_tails(df: DataFrame, big_k: str, big_n: str, n: str, k: str) -> DataFrame:
    """df with expected, p_le, p_ge and the tail on the side of the observation (ties go to the upper tail).

    K of N are marked, n are drawn, k marked ones observed. p_le = P(X <= k), p_ge = P(X >= k). A sum starts at the
    observation and walks away from the mode, each term from the one before, so it is made inside the row: no rows are
    added, none are joined, and the walk ends where terms vanish. The other tail is its complement.
    """
    names = [f"`{c}`" for c in (big_k, big_n, n, k)]
    kk, nn, m, o = (F.expr(f"CAST({c} AS BIGINT)") for c in names)
    low, high = F.greatest(F.lit(0).cast("bigint"), m + kk - nn), F.least(kk, m)
    mean = m * kk / nn
    spread = F.sqrt(mean * (1 - kk / nn) * (nn - m) / F.greatest(nn - 1, F.lit(1)))
    reach = F.ceil(DEVIATIONS * spread) + FLOOR_TERMS
    at = F.least(F.greatest(o, low), high)
    base = df.withColumns({"__kk": kk, "__nn": nn, "__n": m, "__k": o, "__lo": low, "__hi": high, "__at": at, "__reach": reach, "expected": mean, "__left": o <= mean})
    big, whole, drawn, left = F.col("__kk"), F.col("__nn"), F.col("__n"), F.col("__left")
    base = base.withColumn("__p", F.exp(log_choose(big, F.col("__at")) + log_choose(whole - big, drawn - F.col("__at")) - log_choose(whole, drawn)))

    def add(acc: Column, j: Column) -> Column:
        i = F.when(left, F.col("__at") - j + 1).otherwise(F.col("__at") + j - 1)  # the place of the term before
        down = i * (whole - big - drawn + i) / ((big - i + 1) * (drawn - i + 1))
        up = (big - i) * (drawn - i) / ((i + 1) * (whole - big - drawn + i + 1))
        term = acc["term"] * F.when(left, down).otherwise(up)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.least(F.col("__reach"), F.when(left, F.col("__at") - F.col("__lo")).otherwise(F.col("__hi") - F.col("__at")))
    places = F.when(steps > 0, F.sequence(F.lit(1).cast("bigint"), steps)).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("__tail", F.aggregate(places, F.struct(F.col("__p").alias("term"), F.col("__p").alias("sum")), add)["sum"])
    other = 1 - (F.col("__tail") - F.col("__p"))
    p_le = F.when(F.col("__k") < F.col("__lo"), 0.0).when(F.col("__k") >= F.col("__hi"), 1.0).when(left, F.col("__tail")).otherwise(other)
    p_ge = F.when(F.col("__k") > F.col("__hi"), 0.0).when(F.col("__k") <= F.col("__lo"), 1.0).when(left, other).otherwise(F.col("__tail"))
    out = base.withColumn("p_le", F.greatest(p_le, F.lit(0.0))).withColumn("p_ge", F.greatest(p_ge, F.lit(0.0)))
    out = out.withColumn("p_side", F.when(F.col("__k") < F.col("expected"), F.least(F.lit(1.0), F.col("p_le"))).otherwise(F.least(F.lit(1.0), F.col("p_ge"))))
    return out.drop("__kk", "__nn", "__n", "__k", "__lo", "__hi", "__at", "__reach", "__left", "__p", "__tail")


def lag_verdict(late: Sequence[Column]) -> Column:
    """Of the comparison groups against which an observation is late (booleans; null is no): none, both (all) or one."""
    hits = F.size(F.filter(F.array(*(F.coalesce(c, F.lit(False)) for c in late)), lambda x: x))
    return F.when(hits == 0, "size effect").when(hits == len(late), "late against all").otherwise("late against one")


def significance(p: Column, tests: Column) -> Column:
    """'**' below 0.05 / tests, '*' below 0.05, else ''."""
    return F.when(p < F.lit(0.05) / tests, "**").when(p < 0.05, "*").otherwise("")


def landis_koch(kappa: Column) -> Column:
    """Verbal band of a kappa, strict lower bounds."""
    return F.when(kappa > 0.8, "almost perfect").when(kappa > 0.6, "substantial").when(kappa > 0.4, "moderate").when(kappa > 0.2, "fair").otherwise("slight")


def kappa(pairs: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """(by, n, po, pe, kappa) of two codings; 1 where chance agreement is 1. Aggregates only: confusion counts, then
    their margins."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("c"))
    seen = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy(*by, F.col(a).alias("v")).agg(F.sum("c").alias("x"))
    right = cells.groupBy(*by, F.col(b).alias("v")).agg(F.sum("c").alias("y"))
    chance = left.join(right, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    out = seen.join(chance, list(by), "left").withColumn("po", F.col("same") / F.col("n")).withColumn("pe", F.coalesce("xy", F.lit(0)) / (F.col("n") * F.col("n")))
    return out.select(*by, "n", "po", "pe", F.when(F.col("pe") == 1, F.lit(1.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def first_year(df: DataFrame, by: Sequence[str], year: str, paper: str) -> DataFrame:
    """(by, first_year, papers)."""
    return df.groupBy(*by).agg(F.min(year).alias("first_year"), F.count_distinct(paper).alias("papers"))


def lag_between(firsts: DataFrame, item: str, group: str, lead: str, follow: str) -> DataFrame:
    """One row: shared items, how often the follower came later, earlier or in the same year, and the median lag."""
    side = lambda g, n: firsts.where(F.col(group) == g).select(item, F.col("first_year").alias(n))
    lag = side(lead, "x").join(side(follow, "y"), item).select((F.col("y") - F.col("x")).alias("lag"))
    return lag.agg(F.count("*").alias("shared"), F.count_if(F.col("lag") > 0).alias("later"), F.count_if(F.col("lag") < 0).alias("earlier"), F.count_if(F.col("lag") == 0).alias("same"), F.median("lag").alias("median_lag"))


def expected_occupancy(cells: DataFrame, by: str, n: int) -> DataFrame:
    """(by, expected): expected distinct cells among n rows drawn without replacement; cells: (by, cell..., c)."""
    total = cells.groupBy(by).agg(F.sum("c").alias("total"))
    joined = cells.join(total, by).where(F.col("total") >= n)
    none = F.when(F.col("total") - F.col("c") < n, F.lit(0.0)).otherwise(F.exp(log_choose(F.col("total") - F.col("c"), F.lit(n)) - log_choose(F.col("total"), F.lit(n))))
    return joined.groupBy(by).agg(F.sum(1 - none).alias("expected"))

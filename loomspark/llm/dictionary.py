"""Global integer dictionaries: dense identifiers for distinct values, without sorting or collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import cut


def number_rows(distinct: DataFrame, id_name: str = "id") -> DataFrame:
    """The rows of `distinct` with identifiers 0..n-1, contiguous within each partition.

    A partition numbers its rows itself; only the row count of every partition is summed up (one row per task).
    """
    split = 33  # monotonically_increasing_id puts the partition above this many bits
    local = cut(distinct.withColumn("__mono", F.monotonically_increasing_id()))
    here = local.withColumn("__part", F.shiftright("__mono", split)).withColumn("__at", F.col("__mono") - F.shiftleft("__part", split))
    sizes = here.groupBy("__part").agg((F.max("__at") + 1).alias("__n"))
    start = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    return here.join(F.broadcast(start), "__part").withColumn(id_name, F.col("__start") + F.col("__at")).drop("__mono", "__part", "__at", "__start")

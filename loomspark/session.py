"""Session helpers: table access and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory; nothing but the columns a query selects is read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_tasks(spark: SparkSession) -> int:
    """The number of tasks of a shuffle, for repartitions whose rows are small but cost much work each."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a table that a join sends to every task; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df for a join: with a broadcast hint if it is counted to have few rows, else as it is. Meant for tables that are
    cut or cheap, as the count runs at once."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "loomspark-checkpoints")  # one machine: tests only
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written once to the shared checkpoint folder and read from there.

    An executor that is lost afterwards takes nothing with it, and iterative plans stay short.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*cuts: DataFrame) -> None:
    """Delete the checkpoint files of tables made by cut that nothing will read again: the older states of an iteration
    whose newer state is cut itself. Files that are gone already are no error."""
    for df in cuts:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        if file is not None and file.isDefined():
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

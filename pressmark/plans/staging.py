"""Keeping intermediate tables that more than one job reads."""

from __future__ import annotations

import gc

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path, shared_folder

_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist a table several passes read.

    The cache spills to disk and keeps the partitioning of the plan, so later
    per-document steps need no second exchange; a block lost with its executor
    is computed again from the lineage.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(kept)
    return kept


def settle(df: DataFrame) -> DataFrame:
    """Compute a table now and cut its lineage with a checkpoint in the shared folder.

    For fitted tables and feature tables that many later jobs read: they survive
    the loss of executors, keep their partitioning, and later plans start from them
    instead of carrying (and re-analysing) every step behind them.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``settle`` for wide fitted tables: Parquet in the shared folder is a fraction of a checkpoint's size."""
    path = scratch_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of an iteration: a new one is written, and those it was made from are deleted once no later round reads them.

    Checkpoints and shuffles of all rounds would stay on disk together.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as Parquet in the shared folder."""
        path = scratch_path(self.spark, f"round-{name}")
        df.write.option("compression", "zstd").parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, last: int = 1) -> None:
        """Delete all but the ``last`` tables of every name, and let Spark clean the shuffles nothing refers to any more."""
        for name in names:
            old = self.paths.get(name, [])
            while len(old) > last:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(old.pop(0))
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        gc.collect()
        self.spark._jvm.System.gc()


def release() -> None:
    """Drop every table kept so far (call once the results have been written)."""
    while _kept:
        _kept.pop().unpersist()


def spread(df: DataFrame) -> DataFrame:
    """Even out an input of fewer files than cores.

    A small or unsplittable file (one row group, gzip) is read by one task; its rows
    are dealt out before the costly text functions.  An input of many files is left
    alone, so a large table does not move.
    """
    if len(df.inputFiles()) >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(shuffle_width(df))


def shuffle_width(df: DataFrame) -> int:
    """Number of partitions for an exchange of raw text.

    Text is several times smaller than the rows it explodes into, so the width is
    fixed here instead of letting AQE merge partitions by their size on the wire.
    Set ``spark.sql.shuffle.partitions`` to about (bytes of text / 32 MB).
    """
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

"""Session helpers: where intermediate tables go, and the few settings the plans rely on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_RUNS: list[str] = []


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the plans were written for. Every plan is also correct without them.

    Tables are laid out by match once and every later window, aggregate and join keys on (match, ...), so a
    join may reuse that layout instead of shuffling again on its full key. Collecting aggregates hold short lists
    (the players of a side, the pairs of a fight), so they may hash many groups before falling back to sorting.
    One task then sorts what it reads several times over, in about thirty times the shuffled bytes, so adaptive execution may
    merge partitions up to 8 MB only: larger data means more tasks, not larger ones. Beyond 200 partitions (`bypassMergeThreshold`)
    a task also sorts what it shuffles, in ten times the stored bytes and more, so it may read 32 MB only.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32m")
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "20000")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one given to `setCheckpointDir`, which is `spark.checkpoint.dir` by default.

    Driver and executors must share it, so there is no fallback to a local folder.
    """
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir (or call setCheckpointDir) to a folder that driver and executors share")
    return "/".join([shared.rstrip("/"), spark.sparkContext.applicationId, *_RUNS])


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def stages(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables stored inside the block share one folder, which is deleted at its end. Results must be written
    before that."""
    _RUNS.append(f"run-{uuid.uuid4().hex}")
    folder = scratch_dir(spark)
    try:
        yield folder
    finally:
        _RUNS.pop()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` once as parquet in the shared folder and read it back.

    Cuts the lineage (a lost executor costs a re-read, not a recompute) and keeps the columnar benefits a
    checkpoint would lose: later readers prune columns and get real file sizes for join planning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Exactly-once import: the ledger as a stream of files, one committed folder per micro-batch.

Spark gives a batch the same id and the same files when it repeats it after a failure. A batch is therefore imported against the
folders of the batches before it, written aside, and renamed to a name made of its id. If that name is there already, the batch was
committed and the checkpoint was not: nothing is done. If not, whatever an earlier attempt left aside is ignored. So every file
is in the ledger once, whenever the driver dies, and readers never see a part of a batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from skirmish.schema import TABLES
from skirmish.sources.ledger import import_files
from skirmish.sources.snapshots import Store

COLUMNS = [*TABLES["manifest"].names, "action", "original_file"]


def _schema() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES["manifest"].schema) + ", action string, original_file string"


def stream_files(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """New files of a folder as (replay_file, sha256, size_bytes)."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = source.option("maxFilesPerTrigger", per_batch).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("replay_file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


class StreamLedger:
    """The committed batches under one directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory, self.store = spark, directory.rstrip("/"), Store(spark, directory)

    def _folder(self, batch: int) -> str:
        return f"{self.directory}/batch-{batch:012d}"

    def batches(self) -> list[int]:
        """Ids of the committed batches: names only, one per trigger."""
        fs, path = self.store.fs, self.store._path(self.directory)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-"))

    def rows(self, before: int | None = None) -> DataFrame:
        """All committed rows (of batches before an id)."""
        chosen = [self._folder(b) for b in self.batches() if before is None or b < before]
        return self.spark.read.schema(_schema()).parquet(*chosen) if chosen else self.spark.createDataFrame([], _schema())

    def commit(self, files: DataFrame, batch: int, **provenance: str) -> bool:
        """Import one batch; False if it had been committed before."""
        if self.store.fs.exists(self.store._path(self._folder(batch))):
            return False
        known = self.rows(before=batch).where(F.col("action") != "duplicate")
        stored = known.select("replay_file", "sha256", "size_bytes")
        added = import_files(files, stored, known.select(*TABLES["manifest"].names), **provenance)
        aside = f"{self.directory}/.{uuid.uuid4().hex}"
        added.select(*COLUMNS).write.parquet(aside)
        self.store._move(aside, self._folder(batch))
        return True


def start_import(files: DataFrame, ledger: StreamLedger, checkpoint: str, acquired_at: Callable[[int], str] | None = None, **provenance: str) -> StreamingQuery:
    """Run the import until what is there now has been taken in. `acquired_at` gives the time to note for a batch id."""

    def batch_done(batch: DataFrame, number: int) -> None:
        times = {"acquired_at": acquired_at(number)} if acquired_at else {}
        ledger.commit(batch, number, **times, **provenance)

    return files.writeStream.foreachBatch(batch_done).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

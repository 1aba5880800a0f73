"""Snapshots of a set of tables: readers see all of an old set or all of a new one.

A commit moves the staged tables of one write to a folder of its own, `versions/<id>`, and then names the whole set in one small
numbered file, `_snapshots/<number>.json`: table -> folder. That file is written aside and renamed last, so it is there as a whole or
not at all, and whoever dies before the rename leaves the set before untouched. Tables that a write does not touch keep their
folder in the next set. Two writers that start from the same set cannot both get the next number: the second fails and may retry.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

_NAMES = "_snapshots"


class Store:
    """One directory of tables on any file system Spark reaches. Only names pass through the driver."""

    def __init__(self, spark: SparkSession, directory: str):
        self.jvm, self.directory = spark._jvm, directory.rstrip("/")
        self.fs = self._path(self.directory).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def _numbers(self) -> list[int]:
        names = self._path(f"{self.directory}/{_NAMES}")
        if not self.fs.exists(names):
            return []
        found = [s.getPath().getName() for s in self.fs.listStatus(names)]
        return sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json") and n[0] != ".")

    def latest(self) -> int:
        """Number of the newest set, 0 if there is none."""
        return max(self._numbers(), default=0)

    def tables(self, number: int | None = None) -> dict[str, str]:
        """Table -> path of a set (the newest)."""
        number = self.latest() if number is None else number
        if not number:
            return {}
        stream = self.fs.open(self._path(f"{self.directory}/{_NAMES}/{number:08d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return {name: f"{self.directory}/{folder}" for name, folder in json.loads(text).items()}

    def commit(self, staged: str, names: list[str], base: int) -> dict[str, str]:
        """Publish `<staged>/<name>.parquet` on top of set number `base`; returns the paths of the new tables."""
        folder = f"versions/{uuid.uuid4().hex}"
        kept = {n: p.removeprefix(f"{self.directory}/") for n, p in self.tables(base).items()}
        self._move(staged, f"{self.directory}/{folder}")
        self._publish(base + 1, {**kept, **{n: f"{folder}/{n}.parquet" for n in names}})
        return {n: f"{self.directory}/{folder}/{n}.parquet" for n in names}

    def _publish(self, number: int, tables: dict[str, str]) -> None:
        aside = f"{self.directory}/{_NAMES}/.{uuid.uuid4().hex}"
        out = self.fs.create(self._path(aside))
        try:
            out.write(bytearray(json.dumps(tables, indent=1, sort_keys=True).encode()))
        finally:
            out.close()
        target = f"{self.directory}/{_NAMES}/{number:08d}.json"
        if self.fs.exists(self._path(target)):
            self.fs.delete(self._path(aside), False)
            raise FileExistsError(f"{target}: another writer was first")
        self._move(aside, target)

    def _move(self, source: str, target: str) -> None:
        self.fs.mkdirs(self._path(target).getParent())
        if not self.fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot rename {source} to {target}")

    def discard(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def expire(self, keep: int = 2) -> int:
        """Forget all but the newest `keep` sets and delete the version folders that only those used; returns how many folders went.
        Readers of a forgotten set lose it, so keep as many as readers may still hold."""
        numbers = self._numbers()
        for number in numbers[:-keep]:
            self.discard(f"{self.directory}/{_NAMES}/{number:08d}.json")
        used = {path.split("/")[-2] for number in numbers[-keep:] for path in self.tables(number).values()}
        versions = self._path(f"{self.directory}/versions")
        gone = [s.getPath() for s in self.fs.listStatus(versions) if s.getPath().getName() not in used] if self.fs.exists(versions) else []
        for path in gone:
            self.fs.delete(path, True)
        return len(gone)

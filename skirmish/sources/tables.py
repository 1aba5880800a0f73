"""Processed tables as parquet: projected reads, and writes that publish all tables at once, after every one is valid."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from skirmish.schema import coerce, require_valid
from skirmish.sources.snapshots import Store


def read_table(spark: SparkSession, directory: str, name: str, columns: Sequence[str] | None = None,
               match_id: str | None = None, snapshot: int | None = None) -> DataFrame:
    """A stored table of the newest set (or of set number `snapshot`), or a plain parquet folder of that name where nothing was
    committed; `columns` and `match_id` reach the parquet scan."""
    directory = directory.rstrip("/")
    df = spark.read.parquet(Store(spark, directory).tables(snapshot).get(name, f"{directory}/{name}.parquet"))
    if match_id is not None:
        df = df.where(F.col("match_id") == match_id)
    return df.select(*columns) if columns else df


def clustered(df: DataFrame) -> DataFrame:
    """Rows ordered by match and time over the files, so that a match filter skips files and row groups by their
    statistics. Ranges are cut on time as well: a large match spans many files."""
    order = [c for c in ("match_id", "t", "t_ms", "spawn_t", "t0", "player_id") if c in df.columns]
    return df.repartitionByRange(*order).sortWithinPartitions(*order) if "match_id" in order else df


def write_tables(tables: dict[str, DataFrame], directory: str) -> list[str]:
    """Coerce, validate and write all tables, one parquet dataset each, and publish them as one new set (`snapshots`): readers see all
    of them or none, and nothing appears under `directory` if any is invalid. Other tables of the directory stay in the set.

    Each table is written once, in its final order, to a staging folder beside the target; the staged files are validated and then moved.
    """
    directory = directory.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    store, staging = Store(spark, directory), f"{directory}.staging-{uuid.uuid4().hex}"
    base = store.latest()
    try:
        staged = {}
        for name, df in tables.items():
            typed = coerce(df, name)
            clustered(typed).write.parquet(f"{staging}/{name}.parquet")
            staged[name] = spark.read.schema(typed.schema).parquet(f"{staging}/{name}.parquet")
        require_valid(staged)
        return list(store.commit(staging, list(tables), base).values())
    finally:
        store.discard(staging)

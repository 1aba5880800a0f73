"""What the operators share: reading tables, stored stages, batches of texts inside tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skirmish.session import materialize

__all__ = ["chunks", "join_dealt", "materialize", "read", "spans_of", "text_values"]

#: Characters of text that a task works on at once.
CHUNK_CHARS = 2_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_values(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text each, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64))
        start = 0
        while start < n:
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


#: Keys that a join deals out at most, and rows of a key that need no dealing whatever the total.
DEALT_KEYS, FEW_ROWS = 5000, 1000


def join_dealt(rows: DataFrame, side: DataFrame, keys: Sequence[str], sizes: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` joined to `side` (one row per key; null keys match each other), with large keys dealt over several tasks.

    `sizes` has the number of rows (`n`) per key. A key with more than a 5000th of all rows is cut into parts of about that many
    by the place of each row, never by a value, and its row of `side` is repeated once per part. At most 5000 keys are that
    large, so their list may be broadcast.
    """
    part = max(FEW_ROWS, (sizes.agg(F.sum("n")).first()[0] or 0) // DEALT_KEYS)
    large = F.broadcast(sizes.where(F.col("n") > part).select(*[F.col(k).alias(f"_l_{k}") for k in keys], F.ceil(F.col("n") / part).cast("long").alias("_parts")))

    def same(prefix: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])

    def with_parts(df: DataFrame) -> DataFrame:
        return df.join(large, same("_l_"), "left").drop(*[f"_l_{k}" for k in keys]).withColumn("_parts", F.coalesce("_parts", F.lit(1)))

    dealt = with_parts(rows).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.col("_parts"))).drop("_parts")
    repeated = with_parts(side).withColumn("_side_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    # stored, so that its size is known when the join is planned: a small side then leaves the rows where they are
    renamed = materialize(repeated.withColumnsRenamed({k: f"_s_{k}" for k in keys}), "dealt")
    return dealt.join(renamed, same("_s_") & (F.col("_part") == F.col("_side_part")), how).drop("_part", "_side_part", *[f"_s_{k}" for k in keys])


def spans_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every span, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)

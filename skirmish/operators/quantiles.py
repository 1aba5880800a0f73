"""Exact percentiles (linear interpolation) whose cost does not depend on how large one group is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skirmish.operators.ordered import Ordered


def percentiles(df: DataFrame, group: Sequence[str], value: str, qs: dict[str, float], split: bool = True,
                few_groups: bool = False) -> DataFrame:
    """Per group, one column per entry of `qs` (name -> fraction), plus `n_values`, the number of non-null values.

    `split=False` uses the built-in aggregate, which holds a group's distinct values in one task: only for groups
    known to be small. Otherwise values are counted, range-partitioned and ranked by running counts. `few_groups`:
    the groups are the cells of a fixed grid, so their sizes can be sent everywhere (always so without a group).
    """
    rows = df.where(F.col(value).isNotNull())
    if not split:
        return rows.groupBy(*group).agg(
            *[F.percentile(value, F.lit(q)).alias(name) for name, q in qs.items()], F.count("*").alias("n_values"))
    keys = list(group) or ["_all"]
    if not group:
        rows = rows.withColumn("_all", F.lit(0))
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranked = Ordered(counts, keys, [value], split=True).running("_upto", "sum", F.col("_c")).rows()
    sizes = ranked.groupBy(*keys).agg(F.max("_upto").alias("n_values"))
    at = ranked.join(F.broadcast(sizes) if few_groups or not group else sizes, keys)

    def value_at(rank):
        return F.max(F.when((F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto")), F.col(value)))

    cols = []
    for name, q in qs.items():
        pos = F.lit(float(q)) * (F.col("n_values") - 1)
        lo, hi = value_at(F.floor(pos)), value_at(F.ceil(pos))
        share = F.max(pos - F.floor(pos))
        cols.append((lo + (hi - lo) * share).alias(name))
    out = at.groupBy(*keys, "n_values").agg(*cols)
    return out.select(*group, *qs, "n_values")

"""Range joins as equi-joins: intervals are listed under the time buckets they touch, points fall in one bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket(t: str | Column, width: float) -> Column:
    return F.floor(_col(t) / F.lit(float(width)))


def bucketed_intervals(df: DataFrame, lo: str | Column, hi: str | Column, width: float, out: str = "_bucket") -> DataFrame:
    """One copy of each interval per bucket it touches; empty intervals (hi < lo) are dropped."""
    lo, hi = _col(lo), _col(hi)
    return df.where(hi >= lo).withColumn(out, F.explode(F.sequence(bucket(lo, width), bucket(hi, width))))


def point_in_interval(points: DataFrame, intervals: DataFrame, *, keys: Sequence[str], t: str, lo: str | Column,
                      hi: str | Column, width: float, lo_open: bool = False) -> DataFrame:
    """Points joined to the intervals of the same `keys` with lo <= t <= hi (lo < t if `lo_open`).

    The bucket is part of the join key, so a long key is spread over its timeline and a point only meets
    intervals near it. A point lies in exactly one bucket, so no pair appears twice.
    """
    ivs = bucketed_intervals(intervals.withColumns({"_lo": _col(lo), "_hi": _col(hi)}), "_lo", "_hi", width)
    pts = points.withColumn("_bucket", bucket(t, width))
    after = F.col(t) > F.col("_lo") if lo_open else F.col(t) >= F.col("_lo")
    return pts.join(ivs, [*keys, "_bucket"]).where(after & (F.col(t) <= F.col("_hi"))).drop("_bucket", "_lo", "_hi")

"""Quantiles over rolling windows from panes: one small sketch per (key, day), summed for every window that holds the day.

A sketch counts values by logarithmic bucket: bucket b holds (g^(b-1), g^b] with g = (1 + a) / (1 - a), and is read as the value within a
share `a` of everything in it. Sketches are rows (key, day, bucket, n), so merging is a sum with map-side combine, they can be stored
once and extended by later days, and no key's values ever meet in one task. A quantile from merged panes is off by at most `a` of
the value of that rank, however many panes there are.

Values up to `LEAST` count as 0; null and negative ones are left out. The quantile of rank q is the value of place floor(q * (n - 1)),
counted from 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skirmish.operators.ordered import Ordered

# Default parameters.
ACCURACY = 0.01
LEAST = 1e-6
WINDOW_DAYS = 30
ZERO = -(2 ** 31)


def bucket_of(value: Column, accuracy: float = ACCURACY) -> Column:
    grade = math.log((1 + accuracy) / (1 - accuracy))
    return F.when(value <= F.lit(LEAST), F.lit(ZERO)).otherwise(F.ceil(F.log(value) / F.lit(grade) - F.lit(1e-9))).cast("int")


def value_of(bucket: Column, accuracy: float = ACCURACY) -> Column:
    g = (1 + accuracy) / (1 - accuracy)
    return F.when(bucket == ZERO, F.lit(0.0)).otherwise(F.lit(2.0 / (g + 1)) * F.pow(F.lit(g), bucket))


def daily_panes(df: DataFrame, keys: Sequence[str], day: str, value: str, accuracy: float = ACCURACY) -> DataFrame:
    """(keys, day, bucket, n): to be stored and extended day by day."""
    rows = df.where(F.col(value).isNotNull() & (F.col(value) >= 0) & F.col(day).isNotNull())
    return rows.groupBy(*keys, F.col(day).alias("day"), bucket_of(F.col(value), accuracy).alias("bucket")).agg(F.count("*").alias("n"))


def window_panes(panes: DataFrame, ends: DataFrame, keys: Sequence[str], window_days: int = WINDOW_DAYS) -> DataFrame:
    """(keys, end_day, bucket, n): panes of the days before each end (not including it), at most `window_days` back. Days and ends meet in
    stretches of the window's length, so a day is listed twice and sees no end that cannot hold it beyond its neighbours."""
    stretch = lambda c: F.floor(F.col(c) / window_days)
    listed = panes.withColumn("_w", F.explode(F.array(stretch("day"), stretch("day") + 1)))
    met = listed.join(ends.select("end_day", stretch("end_day").alias("_w")).distinct(), "_w")
    inside = (F.col("day") < F.col("end_day")) & (F.col("day") >= F.col("end_day") - window_days)
    return met.where(inside).groupBy(*keys, "end_day", "bucket").agg(F.sum("n").alias("n"))


def pane_quantiles(panes: DataFrame, keys: Sequence[str], qs: dict[str, float], accuracy: float = ACCURACY, split: bool = False) -> DataFrame:
    """Per key, `n_values` and one column per entry of `qs` from summed panes."""
    scan = Ordered(panes, list(keys), ["bucket"], split).running("_upto", "sum", F.col("n")).rows()
    sizes = panes.groupBy(*keys).agg(F.sum("n").alias("n_values"))
    at = scan.join(sizes, list(keys))

    def read(q: float) -> Column:
        place = F.floor(F.lit(float(q)) * (F.col("n_values") - 1))
        return F.max(F.when((F.col("_upto") - F.col("n") <= place) & (place < F.col("_upto")), value_of(F.col("bucket"), accuracy)))

    return at.groupBy(*keys, "n_values").agg(*[read(q).alias(name) for name, q in qs.items()])


def trend(quantiles: DataFrame, keys: Sequence[str], value: str = "p50", least: int = 2) -> DataFrame:
    """(keys, windows, slope): change of a windowed quantile per day, over at least `least` windows."""
    rows = quantiles.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("windows"), F.regr_slope(F.col(value), F.col("end_day").cast("double")).alias("slope"))
    return rows.where(F.col("windows") >= least)

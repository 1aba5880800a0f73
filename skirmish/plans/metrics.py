"""Metrics of forecasts: rank measures with ties, calibration, and intervals by a block bootstrap over events.

Ties have mid-ranks (Spearman, AUC) or the average over all orders of the tied rows (NDCG). Everything is computed from counts per
distinct value, ranked by running sums over range partitions, so one giant event or one value shared by a third of the rows is as
good as any other; no event is collected.

The bootstrap weighs whole events by Poisson(1) counts drawn from a hash of event and replicate, so a result does not depend on
partitioning or order, and all replicates come from one scan of per-event sums with sums combined before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skirmish.functions.columns import unit_hash
from skirmish.operators.ordered import Ordered
from skirmish.operators.quantiles import percentiles

# Default parameters.
CUTS = (10, 25)
BINS = 10
REPLICATES = 200
SALT = "bootstrap-v1"


def value_counts(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """Per key and distinct value: `n`, the given sums, and `before_*`, each summed over the values before."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), *[F.sum(c).alias(s) for s, c in sums.items()])
    scan = Ordered(rows, list(keys), [value], split=True)
    scan.running_all({f"before_{c}": ("sum", F.col(c)) for c in ("n", *sums)}, inclusive=False, reverse=descending)
    return scan.rows().withColumns({f"before_{c}": F.coalesce(f"before_{c}", F.lit(0)) for c in ("n", *sums)})


def auc(df: DataFrame, score: str, label: Column, keys: Sequence[str] = ("_all",)) -> DataFrame:
    """(keys, positives, negatives, auc): the chance that a positive row scores above a negative one, ties half; null without either."""
    rows = df.where(label.isNotNull()).withColumn("_all", F.lit(0)) if list(keys) == ["_all"] else df.where(label.isNotNull())
    counts = value_counts(rows, keys, score, {"pos": label.cast("long"), "neg": 1 - label.cast("long")})
    above = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return counts.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
                                     F.try_divide(above, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc")).drop("_all")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho): the correlation of mid-ranks over rows that have both values; null if one of them never varies."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("c")).withColumn("_all", F.lit(0))

    def ranks(value: str, out: str) -> DataFrame:
        rows = pairs.groupBy("_all", value).agg(F.sum("c").alias("n"))
        scan = Ordered(rows, ["_all"], [value], split=True).running("_before", "sum", F.col("n"), inclusive=False).rows()
        return scan.select(value, (F.coalesce("_before", F.lit(0)) + (F.col("n") + 1) / 2).alias(out))

    both = pairs.join(ranks(x, "rx"), x).join(ranks(y, "ry"), y)
    n = F.sum("c")
    centred = lambda a, b: F.sum(F.col("c") * F.col(a) * F.col(b)) - n * ((n + 1) / 2) * ((n + 1) / 2)  # noqa: E731 (mid-ranks have a known mean)
    return both.agg(F.coalesce(n, F.lit(0)).alias("n"), F.try_divide(centred("rx", "ry"), F.sqrt(F.greatest(centred("rx", "rx") * centred("ry", "ry"), F.lit(0.0)))).alias("rho"))


def _discounts(k: int) -> Column:
    """Sums of the first 0..k position discounts."""
    sums = [0.0]
    for i in range(1, k + 1):
        sums.append(sums[-1] + 1 / math.log2(i + 1))
    return F.array(*map(F.lit, sums))


def ndcg(df: DataFrame, event: str, score: str, gain: str, k: int) -> DataFrame:
    """(event, rows, ndcg) at `k` with tied rows averaged over their orders; null for events without gain. Rows need both values."""
    rows = df.where(F.col(score).isNotNull() & F.col(gain).isNotNull())

    def dcg(by: str, out: str) -> DataFrame:
        counts = value_counts(rows.withColumn("_by", F.col(by)), [event], "_by", {"gain": F.col(gain).cast("double")}, descending=True)
        upto = lambda c: F.get(_discounts(k), F.least(c, F.lit(k)).cast("int"))
        taken = F.col("gain") / F.col("n") * (upto(F.col("before_n") + F.col("n")) - upto(F.col("before_n")))
        return counts.groupBy(event).agg(F.sum("n").alias(f"_n_{out}"), F.sum(taken).alias(out))

    both = dcg(score, "_got").join(dcg(gain, "_best"), event)
    return both.select(event, F.col("_n__got").alias("rows"), F.when(F.col("_best") > 0, F.col("_got") / F.col("_best")).alias("ndcg"))


def reliability_bins(df: DataFrame, p: str, label: Column, bins: int = BINS) -> DataFrame:
    """(bin, n, mean_p, rate, gap) over equal steps of the forecast; 1.0 belongs to the last bin."""
    number = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    rows = df.where(F.col(p).isNotNull() & label.isNotNull()).select(number.alias("bin"), F.col(p).alias("_p"), label.cast("double").alias("_y"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("_p").alias("mean_p"), F.avg("_y").alias("rate")).withColumn("gap", F.col("rate") - F.col("mean_p"))


def poisson_weight(u: Column) -> Column:
    """The Poisson(1) count whose step a uniform number falls on; up to 12, beyond which less than 1e-10 is left."""
    steps, total, term = [], 0.0, math.exp(-1)
    for i in range(12):
        total += term
        steps.append(total)
        term /= i + 1
    return sum((F.when(u >= F.lit(s), 1).otherwise(0) for s in steps), F.lit(0))


def bootstrap(df: DataFrame, event: str, numerator: Column, denominator: Column, replicates: int = REPLICATES, salt: str = SALT,
              level: float = 0.95) -> DataFrame:
    """One row (events, estimate, low, high, replicates): the ratio of sums, and quantiles of it over replicates that weigh whole events.
    Replicates without weight are left out and not counted."""
    sums = df.groupBy(event).agg(F.sum(numerator).alias("num"), F.sum(denominator).alias("den")).where(F.col("num").isNotNull() & F.col("den").isNotNull())
    drawn = sums.select("num", "den", F.col(event).cast("string").alias("_event"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    weight = poisson_weight(unit_hash(salt, F.concat_ws(":", F.col("rep").cast("string"), F.col("_event"))))
    ratios = drawn.withColumn("w", weight).groupBy("rep").agg(F.try_divide(F.sum(F.col("w") * F.col("num")), F.sum(F.col("w") * F.col("den"))).alias("ratio"))
    edge = (1 - level) / 2
    spread = percentiles(ratios, [], "ratio", {"low": edge, "high": 1 - edge}, split=False)  # a row per replicate
    whole = sums.agg(F.count("*").alias("events"), F.try_divide(F.sum("num"), F.sum("den")).alias("estimate"))
    return whole.join(F.broadcast(spread)).select("events", "estimate", "low", "high", F.col("n_values").alias("replicates"))

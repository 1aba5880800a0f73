"""Fights won above expected: residuals credited to players, shrunk with a fitted constant, and gated by reliability.

A side's residual is its outcome (1 for a win, 0 for a loss; undecided sides are left out) less what was expected of it. The players
of the side share it in proportion to the damage they dealt in the fight, or equally where none was dealt.

The constant k of sum / (n + k) is fitted by split-half reliability: each player's fights are numbered in time and dealt into odd and even
ones, and the halves' counts and sums are all that is needed to correlate the shrunk halves for every k of a grid, in one pass. The
value of a player before an event reads fights strictly before it and at most `WINDOW_DAYS` back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skirmish.operators.ordered import Ordered
from skirmish.plans.sweeps import each

# Default parameters.
WINDOW_DAYS = 90
MIN_RELIABILITY = 0.5
SHRINK_GRID = (0.0, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)


def side_residuals(fight_sides: DataFrame, expected: Column) -> DataFrame:
    """(match_id, fight_id, team_index, t0, players, residual) of decided sides."""
    won = F.when(F.col("outcome") == "win", 1.0).when(F.col("outcome") == "loss", 0.0)
    return fight_sides.select("match_id", "fight_id", "team_index", "t0", "players", (won - expected).alias("residual")).where(F.col("residual").isNotNull())


def player_credits(residuals: DataFrame, hits: DataFrame) -> DataFrame:
    """(match_id, fight_id, team_index, player_id, t0, dealt, credit): the side's residual shared among its players. `hits` are engagement
    rows with their fight (fight_id, source, source_team, magnitude)."""
    dealt = hits.groupBy("match_id", "fight_id", F.col("source_team").alias("team_index"), F.col("source").alias("player_id")).agg(F.sum("magnitude").alias("dealt"))
    members = residuals.select("*", F.explode(F.split("players", ";")).alias("player_id"), F.size(F.split("players", ";")).alias("_n")).drop("players")
    side = dealt.groupBy("match_id", "fight_id", "team_index").agg(F.sum("dealt").alias("_all"))
    key = ["match_id", "fight_id", "team_index"]
    rows = members.join(dealt, [*key, "player_id"], "left").join(side, key, "left")
    share = F.coalesce(F.try_divide(F.coalesce("dealt", F.lit(0.0)), F.when(F.col("_all") > 0, F.col("_all"))), 1 / F.col("_n"))
    return rows.select(*key, "player_id", "t0", F.coalesce("dealt", F.lit(0.0)).alias("dealt"), (F.col("residual") * share).alias("credit"))


def half_sums(credits: DataFrame, order: Sequence[str], split: bool = False) -> DataFrame:
    """(player_id, n0, s0, n1, s1): counts and sums of each player's even and odd fights in `order`."""
    odd = Ordered(credits, ["player_id"], list(order), split).running("_seen", "sum", F.lit(1), inclusive=False).rows().withColumn(
        "_odd", F.coalesce("_seen", F.lit(0)) % 2)
    return odd.groupBy("player_id").agg(*[a for h in (0, 1) for a in (
        F.count_if(F.col("_odd") == h).alias(f"n{h}"), F.coalesce(F.sum(F.when(F.col("_odd") == h, F.col("credit"))), F.lit(0.0)).alias(f"s{h}"))])


def reliability(halves: DataFrame, grid: Sequence[float] = SHRINK_GRID) -> DataFrame:
    """(k, players, r): correlation of the shrunk halves over players with fights in both; null where it is not defined."""
    rows = each(halves.where((F.col("n0") > 0) & (F.col("n1") > 0)), "k", grid)
    value = lambda h: F.col(f"s{h}") / (F.col(f"n{h}") + F.col("k"))
    spread = (F.stddev_pop(value(0)) > 1e-12) & (F.stddev_pop(value(1)) > 1e-12)
    return rows.groupBy("k").agg(F.count("*").alias("players"), F.when(spread, F.corr(value(0), value(1))).alias("r"))


def best_shrinkage(found: DataFrame, least: float = MIN_RELIABILITY) -> DataFrame:
    """One row (k, players, r, ok): the k of the highest correlation, the least among equals, and whether it passes the gate. The grid
    is a handful of rows."""
    rounded = F.round("r", 9)
    return found.orderBy(rounded.desc_nulls_last(), "k").limit(1).withColumn("ok", F.coalesce(F.col("r") >= F.lit(least), F.lit(False)))


def values_before(credits: DataFrame, days: DataFrame, events: DataFrame, k: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """(event_day, player_id, n, value, ok) from credits of fights strictly before each event and at most `window_days` back. `days` gives
    (match_id, day), `events` (event_day), `k` the row of `best_shrinkage`; players without a fight in the window have no row."""
    daily = credits.join(days, "match_id").groupBy("player_id", "day").agg(F.count("*").alias("n"), F.sum("credit").alias("s"))
    # a day counts for events in the same or the next stretch of `window_days`
    stretch = lambda c: F.floor(F.col(c) / window_days)
    listed = daily.withColumn("_w", F.explode(F.array(stretch("day"), stretch("day") + 1)))
    met = listed.join(events.select("event_day", stretch("event_day").alias("_w")).distinct(), "_w").where(
        (F.col("day") < F.col("event_day")) & (F.col("day") >= F.col("event_day") - window_days))
    sums = met.groupBy("event_day", "player_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return sums.join(F.broadcast(k.select("k", "ok"))).select("event_day", "player_id", "n", (F.col("s") / (F.col("n") + F.col("k"))).alias("value"), "ok")

"""Zone context: players' tracks against the storm's shrinking circle.

A phase keeps the circle (`radius` around the previous phase's next centre) until `start_shrink`, moves and shrinks it in a
straight line to (`next_x`, `next_y`, `next_radius`) until `finish_shrink`, and is over then. Tracks are straight lines between
two updates of a player. Place and radius are both linear over a stretch of such a line, so a player crosses the edge at a root
of one quadratic per stretch; nothing is sampled.

Stretches meet phases by a range join in time buckets, so a long match is spread over its timeline, and each of them is in two
phases at most.

Decisions: the first phase opens at 0 and its circle is taken as centred on its target; a gap between two updates of more than
`MAX_STEP_S` is not bridged (only the updates count); touching the edge is inside. A team has rotated when the last of its tracked
players is in; early is before the shrink begins, on time until it ends, late after that or never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skirmish.operators.intervals import point_in_interval
from skirmish.operators.ordered import Ordered, asof
from skirmish.plans.fights import HIT_POS_MAX_AGE_S, by_match, team_at

# Default parameters.
MAX_STEP_S = 10.0
LATE_S = 60.0
#: Width of the time buckets that stretches and phases meet in; results do not depend on it.
BUCKET_S = 60.0


def zone_phases(zones: DataFrame, late_s: float = LATE_S) -> DataFrame:
    """Phases numbered per match by shrink start, with the circle they start from and the span in which entries count:
    from the end of the phase before to the end of the phase after. A match has a handful of phases."""
    order = W.partitionBy("match_id").orderBy("start_shrink", "finish_shrink", "radius")
    before = lambda c: F.lag(c).over(order)
    return zones.withColumns({
        "phase": (F.row_number().over(order) - 1).cast("int"),
        "x": F.coalesce(before("next_x"), F.col("next_x")), "y": F.coalesce(before("next_y"), F.col("next_y")),
        "opens": F.coalesce(before("finish_shrink"), F.lit(0.0)),
        "closes": F.coalesce(F.lead("finish_shrink").over(order), F.col("finish_shrink") + F.lit(float(late_s))),
    }).select("match_id", "phase", "opens", "closes", "start_shrink", "finish_shrink", "x", "y", "radius", "next_x", "next_y", "next_radius")


def stretches(positions: DataFrame, max_step_s: float = MAX_STEP_S, split: bool = False) -> DataFrame:
    """(match_id, player_id, t, t_to, x, y, vx, vy): straight pieces of the tracks; an update without a near successor is a point."""
    points = positions.where(F.col("player_id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("match_id", "player_id", "t").agg(
        F.max(F.struct("x", "y")).alias("_p")).select("match_id", "player_id", "t", "_p.x", "_p.y")
    scan = Ordered(points, ["match_id", "player_id"], ["t"], split).neighbour("_to", {"t": F.col("t"), "x": F.col("x"), "y": F.col("y")}, after=True)
    step = F.col("_to.t") - F.col("t")
    near = step <= F.lit(float(max_step_s))
    return scan.rows().select("match_id", "player_id", "t", F.when(near, F.col("_to.t")).otherwise(F.col("t")).alias("t_to"), "x", "y", *[
        F.when(near, (F.col(f"_to.{c}") - F.col(c)) / step).otherwise(F.lit(0.0)).alias(f"v{c}") for c in ("x", "y")])


def _edge(x: Column, y: Column, vx: Column, vy: Column, r: Column, vr: Column) -> tuple[Column, Column, Column]:
    """a, b, c of a*s^2 + b*s + c, which is positive while the point is outside the circle; s counts from the stretch's start."""
    return vx * vx + vy * vy - vr * vr, 2 * (x * vx + y * vy - r * vr), x * x + y * y - r * r


def first_inside(a: Column, b: Column, c: Column) -> Column:
    """Least s >= 0 with a*s^2 + b*s + c <= 0; null if there is none."""
    under = b * b - 4 * a * c
    root = F.try_divide(2 * c, F.sqrt(F.greatest(under, F.lit(0.0))) - b)
    return F.when(c <= 0, F.lit(0.0)).when((under >= 0) & (root >= 0), root)


def first_outside(a: Column, b: Column, c: Column) -> Column:
    """Where a*s^2 + b*s + c first becomes positive for s >= 0; null if it never does."""
    under = b * b - 4 * a * c
    high = F.sqrt(F.greatest(under, F.lit(0.0)))
    root = F.when(b >= 0, F.try_divide(2 * c, -b - high)).otherwise(F.try_divide(high - b, 2 * a))
    return F.when((c > 0) | ((c == 0) & (b == 0) & (a > 0)), F.lit(0.0)).when((under >= 0) & (root >= 0), root)


def zone_crossings(positions: DataFrame, phases: DataFrame, max_step_s: float = MAX_STEP_S, split: bool = False) -> DataFrame:
    """(match_id, phase, player_id, entry_t, caught_t) of every player seen in a phase: when they were first inside the next circle,
    and when the moving edge was first past them during the shrink."""
    met = point_in_interval(by_match(stretches(positions, max_step_s, split), split),
                            phases.withColumnsRenamed({"x": "zx", "y": "zy"}), keys=["match_id"], t="t",
                            lo=F.col("opens") - F.lit(float(max_step_s)), hi="closes", width=BUCKET_S)
    track = lambda c, at: F.col(c) + F.col(f"v{c}") * (at - F.col("t"))
    start, end = F.greatest("t", "opens"), F.least("t_to", "closes")
    # the next circle stands still
    entry = start + first_inside(*_edge(track("x", start) - F.col("next_x"), track("y", start) - F.col("next_y"), F.col("vx"), F.col("vy"),
                                        F.col("next_radius"), F.lit(0.0)))
    # the shrinking one moves from (zx, zy, radius) to the next
    low, high = F.greatest("t", "start_shrink"), F.least("t_to", "finish_shrink")
    lasts = F.col("finish_shrink") - F.col("start_shrink")
    speed = lambda a, b: (F.col(b) - F.col(a)) / lasts
    moved = lambda a, b: F.col(a) + speed(a, b) * (low - F.col("start_shrink"))
    caught = low + first_outside(*_edge(track("x", low) - moved("zx", "next_x"), track("y", low) - moved("zy", "next_y"), F.col("vx") - speed("zx", "next_x"),
                                        F.col("vy") - speed("zy", "next_y"), moved("radius", "next_radius"), speed("radius", "next_radius")))
    return met.where(end >= start).groupBy("match_id", "phase", "player_id").agg(
        F.min(F.when(entry <= end, entry)).alias("entry_t"),
        F.min(F.when((lasts > 0) & (high >= low), F.when(caught <= high, caught))).alias("caught_t"))


def rotation_timing(crossings: DataFrame, phases: DataFrame, teams: DataFrame, split: bool = False) -> DataFrame:
    """Per (match, phase, team at shrink start): tracked players, those who entered the next circle, when the last one did
    (null if not all did), its lead over the shrink start, players caught by the edge, and early / on_time / late."""
    rows = crossings.join(phases.select("match_id", "phase", "start_shrink", "finish_shrink"), ["match_id", "phase"])
    placed = team_at(rows, "player_id", "start_shrink", by_match(teams, split), "team_index", split).where(F.col("team_index").isNotNull())
    sides = placed.groupBy("match_id", "phase", "team_index", "start_shrink", "finish_shrink").agg(
        F.count("*").alias("players"), F.count("entry_t").alias("entered"), F.max("entry_t").alias("_last"), F.count("caught_t").alias("caught"))
    entry = F.when(F.col("entered") == F.col("players"), F.col("_last"))
    timing = F.when(entry < F.col("start_shrink"), "early").when(entry <= F.col("finish_shrink"), "on_time").otherwise("late")
    return sides.select("match_id", "phase", "team_index", "players", "entered", "caught", entry.alias("entry_t"),
                        (F.col("start_shrink") - entry).alias("lead_s"), timing.alias("timing"))


def zone_at(df: DataFrame, t: str, phases: DataFrame, split: bool = False) -> DataFrame:
    """Add the phase at time `t`, its circle at that time (`zone_x`, `zone_y`, `zone_r`), the next one and `to_shrink_s` (negative while
    it shrinks). Null after the last phase."""
    names = ("phase", "start_shrink", "finish_shrink", "x", "y", "radius", "next_x", "next_y", "next_radius")
    placed = asof(df, phases, left_keys=["match_id"], right_keys=["match_id"], left_t=t, right_t="finish_shrink",
                  payload={f"_z_{c}": c for c in names}, forward=True, split=split)
    z = lambda c: F.col(f"_z_{c}")
    done = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(t) - z("start_shrink"), z("finish_shrink") - z("start_shrink")), F.lit(0.0))))
    at = lambda a, b: z(a) + (z(b) - z(a)) * done
    return placed.withColumns({
        "phase": z("phase"), "zone_x": at("x", "next_x"), "zone_y": at("y", "next_y"), "zone_r": at("radius", "next_radius"),
        "next_x": z("next_x"), "next_y": z("next_y"), "next_r": z("next_radius"), "to_shrink_s": z("start_shrink") - F.col(t),
    }).drop(*[f"_z_{c}" for c in names])


def fight_zone_context(fight_sides: DataFrame, positions: DataFrame, phases: DataFrame, max_age_s: float = HIT_POS_MAX_AGE_S,
                       split: bool = False) -> DataFrame:
    """Per side of a fight, at its start: the phase, seconds to the shrink, players with a fresh position, and their mean distance to
    the current and the next edge (negative inside). Nothing after `t0` is read."""
    sides = fight_sides.select("match_id", "fight_id", "team_index", "t0", F.explode(F.split("players", ";")).alias("player_id"))
    placed = asof(by_match(sides, split), by_match(positions.select("match_id", "player_id", "t", "x", "y"), split), left_keys=["match_id", "player_id"],
                  right_keys=["match_id", "player_id"], left_t="t0", payload={"x": "x", "y": "y"}, max_age=max_age_s, split=split)
    rows = zone_at(placed, "t0", phases, split)
    gap = lambda x, y, r: F.hypot(F.col("x") - F.col(x), F.col("y") - F.col(y)) - F.col(r)
    return rows.groupBy("match_id", "fight_id", "team_index", "phase", "to_shrink_s").agg(
        F.count("x").alias("placed"), F.avg(gap("zone_x", "zone_y", "zone_r")).alias("edge_now"), F.avg(gap("next_x", "next_y", "next_r")).alias("edge_next"))

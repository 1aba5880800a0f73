"""Cover: standing pieces near a point or between two points at a given time, through a grid index over places.

Pieces that ever stood in one place (and of one team) are one indexed place: a step function says how many of them stand at any
time (spawns up to then minus closes), so a spot that is built on again and again costs as much as any other, and lifetimes are
looked up by an as-of join instead of being compared.

Places are listed by the cube of side `CELL` they lie in. A cube with more than `DENSE` places is divided into 4 x 4 x 4, and once more
where that is not enough. A query descends the same way: it lists the cubes it can touch, meets the occupied ones by an equal join,
and goes into the children of dense ones only where they still touch it. So a crowded cube is neither one join key nor compared
whole with every query nearby; exact tests then see places that are close.

Decisions: a piece stands from its spawn up to, not including, its close (null: for good); distances are three-dimensional, the radius is
inclusive; a piece lies between two points if the straight line between them touches the box around its centre. Pieces without a
place, and queries without one, count nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skirmish.operators.ordered import Ordered, asof
from skirmish.plans.fights import HIT_POS_MAX_AGE_S, by_match, team_at
from skirmish.session import materialize

# Side of a building tile and default sizes, in uu.
TILE = 512.0
RADIUS = 2 * TILE
HALF_BOX = (256.0, 256.0, 192.0)

CELL, DENSE, SPLIT, LEVELS = 512.0, 64, 4, 3
AXES = ("x", "y", "z")
PLACE = ("px", "py", "pz", "piece_team")
CUBE = ("cx", "cy", "cz")


def standing_steps(pieces: DataFrame, split: bool = False) -> DataFrame:
    """(match_id, px, py, pz, piece_team, t, standing): per place and team, how many pieces stand from `t` on; -1 is no team."""
    here = reduce(lambda a, b: a & b, [F.col(a).isNotNull() for a in AXES])
    alive = by_match(pieces, split).where(here & (F.col("close_t").isNull() | (F.col("close_t") > F.col("spawn_t"))))
    changes = alive.select("match_id", *[(F.col(a) + 0.0).alias(p) for a, p in zip(AXES, PLACE)], F.coalesce("team_index", F.lit(-1)).cast("long").alias("piece_team"),
                           F.inline(F.array(F.struct(F.col("spawn_t").alias("t"), F.lit(1).alias("by")), F.struct(F.col("close_t").alias("t"), F.lit(-1).alias("by")))))
    times = changes.where(F.col("t").isNotNull()).groupBy("match_id", *PLACE, "t").agg(F.sum("by").alias("by"))
    return Ordered(times, ["match_id", *PLACE], ["t"], split).running("standing", "sum", F.col("by")).rows().drop("by")


def _cube(value: Column, level: int) -> Column:
    return F.floor(value / F.lit(CELL / SPLIT ** level)).cast("long")


class PlaceIndex:
    """Places by cube. `cells[level]` has the occupied cubes and whether they are divided further; `leaves[level]` the places that stay."""

    def __init__(self, steps: DataFrame, dense: int = DENSE):
        rest = materialize(steps.select("match_id", *PLACE).distinct(), "places")
        self.cells, self.leaves = [], []
        for level in range(LEVELS):
            rest = rest.withColumns({c: _cube(F.col(p), level) for c, p in zip(CUBE, PLACE)})
            counts = rest.groupBy("match_id", *CUBE).agg(F.count("*").alias("_n"))
            cells = materialize(counts.select("match_id", *CUBE, (F.col("_n") > (dense if level + 1 < LEVELS else 2 ** 62)).alias("dense")), "cubes")
            self.cells.append(cells)
            placed = rest.join(cells, ["match_id", *CUBE])
            self.leaves.append(placed.where(~F.col("dense")).drop("dense"))
            rest = placed.where("dense").drop("dense")

    def pairs(self, queries: DataFrame, listed: Column, touches: Callable[[Sequence[Column], Sequence[Column]], Column]) -> DataFrame:
        """Queries with every place that may touch them. `listed` is an array of (cx, cy, cz) cubes per query; `touches(low, high)` tells
        whether the query touches a box."""
        now, found = queries.select("*", F.inline(F.array_distinct(listed))), []
        for level, (cells, leaves) in enumerate(zip(self.cells, self.leaves)):
            met = now.join(cells, ["match_id", *CUBE])
            found.append(met.where(~F.col("dense")).drop("dense").join(leaves, ["match_id", *CUBE]).drop(*CUBE))
            if level + 1 < LEVELS:
                side = F.lit(CELL / SPLIT ** (level + 1))
                children = met.where("dense").drop("dense")
                for c in CUBE:
                    children = children.withColumn(c, F.explode(F.sequence(F.col(c) * SPLIT, F.col(c) * SPLIT + SPLIT - 1)))
                now = children.where(touches([F.col(c) * side for c in CUBE], [(F.col(c) + 1) * side for c in CUBE]))
        return reduce(lambda a, b: a.unionByName(b), found).where(touches([F.col(p) for p in PLACE[:3]], [F.col(p) for p in PLACE[:3]]))


def cubes_of(low: Sequence[Column], high: Sequence[Column]) -> Column:
    """All cubes that a box touches, as array<struct<cx, cy, cz>>."""
    x, y, z = (F.sequence(_cube(a, 0), _cube(b, 0)) for a, b in zip(low, high))
    return F.flatten(F.transform(x, lambda i: F.flatten(F.transform(y, lambda j: F.transform(z, lambda k: F.struct(i.alias("cx"), j.alias("cy"), k.alias("cz")))))))


def in_reach(at: Sequence[Column], radius: float) -> Callable[[Sequence[Column], Sequence[Column]], Column]:
    """Whether a box comes within `radius` of a point."""
    def test(low: Sequence[Column], high: Sequence[Column]) -> Column:
        gaps = [F.greatest(a - p, p - b, F.lit(0.0)) for a, b, p in zip(low, high, at)]
        return reduce(lambda s, g: s + g * g, gaps, F.lit(0.0)) <= F.lit(float(radius) ** 2)
    return test


def crossed(start: Sequence[Column], end: Sequence[Column], half: Sequence[float]) -> Callable[[Sequence[Column], Sequence[Column]], Column]:
    """Whether the line from start to end touches a box widened by `half` on every side: its spans within the three slabs meet."""
    def test(low: Sequence[Column], high: Sequence[Column]) -> Column:
        enters, leaves = [F.lit(0.0)], [F.lit(1.0)]
        for p, q, a, b, h in zip(start, end, low, high, half):
            step, a, b = q - p, a - F.lit(float(h)), b + F.lit(float(h))
            flat = F.when((a <= p) & (p <= b), F.lit(0.0)).otherwise(F.lit(2.0))  # beyond the end if it stays outside
            enters.append(F.when(step == 0, flat).otherwise(F.least(F.try_divide(a - p, step), F.try_divide(b - p, step))))
            leaves.append(F.when(step == 0, F.lit(1.0)).otherwise(F.greatest(F.try_divide(a - p, step), F.try_divide(b - p, step))))
        return F.greatest(*enters) <= F.least(*leaves)
    return test


def standing_at(pairs: DataFrame, steps: DataFrame, keys: Sequence[str], t: str, split: bool = False) -> DataFrame:
    """Per query and piece team, the pieces standing at the query's time over all its places."""
    counted = asof(pairs.select("match_id", *keys, t, *PLACE), steps, left_keys=["match_id", *PLACE], right_keys=["match_id", *PLACE], left_t=t,
                   payload={"standing": "standing"}, split=split)
    return counted.groupBy("match_id", *keys, "piece_team").agg(F.sum("standing").alias("pieces")).where(F.col("pieces") > 0)


def pieces_near(points: DataFrame, steps: DataFrame, index: PlaceIndex, keys: Sequence[str], t: str, radius: float = RADIUS,
                split: bool = False) -> DataFrame:
    """(match_id, *keys, piece_team, pieces) standing within `radius` of each point (x, y, z) at its time."""
    at = [F.col(a) for a in AXES]
    asked = points.where(reduce(lambda a, b: a & b, [a.isNotNull() for a in at])).select("match_id", *keys, t, *AXES)
    reach = F.lit(float(radius))
    return standing_at(index.pairs(asked, cubes_of([a - reach for a in at], [a + reach for a in at]), in_reach(at, radius)), steps, keys, t, split)


def pieces_between(lines: DataFrame, steps: DataFrame, index: PlaceIndex, keys: Sequence[str], t: str, half: Sequence[float] = HALF_BOX,
                   split: bool = False) -> DataFrame:
    """(match_id, *keys, piece_team, pieces) standing on the line from (x, y, z) to (x2, y2, z2) at its time."""
    start, end = [F.col(a) for a in AXES], [F.col(f"{a}2") for a in AXES]
    asked = lines.where(reduce(lambda a, b: a & b, [c.isNotNull() for c in (*start, *end)])).select("match_id", *keys, t, *AXES, *[f"{a}2" for a in AXES])
    # listed bit by bit, so that a long slanting line touches cubes along itself only
    bits = F.ceil(F.greatest(F.lit(1.0), *[F.abs(q - p) / F.lit(CELL) for p, q in zip(start, end)])).cast("int")

    def listed(k: Column) -> Column:
        a = [p + (q - p) * (k / bits) for p, q in zip(start, end)]
        b = [p + (q - p) * ((k + 1) / bits) for p, q in zip(start, end)]
        return cubes_of([F.least(x, y) - F.lit(h) for x, y, h in zip(a, b, half)], [F.greatest(x, y) + F.lit(h) for x, y, h in zip(a, b, half)])

    cubes = F.flatten(F.transform(F.sequence(F.lit(0), bits - 1), listed))
    return standing_at(index.pairs(asked, cubes, crossed(start, end, half)), steps, keys, t, split)


def side_places(fight_sides: DataFrame, positions: DataFrame, max_age_s: float = HIT_POS_MAX_AGE_S, split: bool = False) -> DataFrame:
    """(match_id, fight_id, team_index, opp_team_index, t0, x, y, z): mean place of a side's players with a fresh position at `t0`."""
    sides = fight_sides.select("match_id", "fight_id", "team_index", "opp_team_index", "t0", F.explode(F.split("players", ";")).alias("player_id"))
    placed = asof(by_match(sides, split), by_match(positions.select("match_id", "player_id", "t", *AXES), split), left_keys=["match_id", "player_id"],
                  right_keys=["match_id", "player_id"], left_t="t0", payload={a: a for a in AXES}, max_age=max_age_s, split=split)
    return placed.groupBy("match_id", "fight_id", "team_index", "opp_team_index", "t0").agg(*[F.avg(a).alias(a) for a in AXES])


def cover_at_start(fight_sides: DataFrame, positions: DataFrame, pieces: DataFrame, radius: float = RADIUS, half: Sequence[float] = HALF_BOX,
                   max_age_s: float = HIT_POS_MAX_AGE_S, dense: int = DENSE, split: bool = False) -> DataFrame:
    """Per side of a fight at its start: own and other pieces within `radius`, and pieces on the line to the main opponent. Null where the
    side (or the opponent) has no place. `pieces` have (match_id, spawn_t, close_t, x, y, z, team_index). Nothing after `t0` is read."""
    steps = materialize(standing_steps(pieces, split), "standing")
    index = PlaceIndex(steps, dense)
    sides = materialize(side_places(fight_sides, positions, max_age_s, split), "side-places")
    opponents = sides.select("match_id", "fight_id", F.col("team_index").alias("opp_team_index"), *[F.col(a).alias(f"{a}2") for a in AXES])
    lines = sides.join(opponents, ["match_id", "fight_id", "opp_team_index"], "left")
    keys = ["fight_id", "team_index"]
    own = F.col("piece_team") == F.col("team_index")
    near = pieces_near(sides, steps, index, keys, "t0", radius, split).groupBy("match_id", *keys).agg(
        F.sum(F.when(own, F.col("pieces")).otherwise(0)).alias("_own"), F.sum(F.when(own, F.lit(0)).otherwise(F.col("pieces"))).alias("_other"))
    between = pieces_between(lines, steps, index, keys, "t0", half, split).groupBy("match_id", *keys).agg(F.sum("pieces").alias("_between"))
    rows = lines.join(near, ["match_id", *keys], "left").join(between, ["match_id", *keys], "left")
    known, facing = F.col("x").isNotNull(), F.col("x").isNotNull() & F.col("x2").isNotNull()
    return rows.select("match_id", *keys, F.when(known, F.coalesce("_own", F.lit(0))).alias("own_near"), F.when(known, F.coalesce("_other", F.lit(0))).alias("other_near"),
                       F.when(facing, F.coalesce("_between", F.lit(0))).alias("between"))


def with_builder_team(pieces: DataFrame, teams: DataFrame, split: bool = False) -> DataFrame:
    """Pieces with `team_index`, their builder's team when they were placed."""
    return team_at(by_match(pieces, split), "builder", "spawn_t", by_match(teams, split), "team_index", split)

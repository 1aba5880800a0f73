"""Building pieces: classification, predicted/confirmed merge, edits and resets, builder attribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from skirmish.functions.columns import distance, is_edited, piece_kind, piece_material, piece_shape
from skirmish.operators.ordered import Ordered, asof, needs_split
from skirmish.plans.fights import by_match
from skirmish.session import materialize

# Seconds and Unreal units.
DUPLICATE_WINDOW_S = 0.2
EDIT_WINDOW_S = 1.5
MAX_BUILDER_DIST = 800.0
RANKED_DIST = 1e5

MIN_BUCKET_ROWS = 32
"""Least number of player states per bucket; results do not depend on it."""


def _tie(df: DataFrame) -> list[str]:
    """Order of rows that share a spawn time: the ingest id if there is one, else content."""
    return ["row_id"] if "row_id" in df.columns else ["path", "close_t"]


def classify(builds: DataFrame) -> DataFrame:
    """Add material, shape, kind and edited from the actor class."""
    shaped = builds.withColumns({"material": piece_material("path"), "shape": piece_shape("path")})
    return shaped.withColumns({"kind": piece_kind(F.col("shape")), "edited": is_edited(F.col("shape"))})


def parse_pieces(builds: DataFrame, split: bool = False) -> DataFrame:
    """Classified pieces without predicted spawns: a row closed within 0.2 s of the next spawn of the same piece in
    the same spot is dropped, and that next row takes over its spawn time."""
    key = ["match_id", "path", "x", "y", "z", "yaw"]
    scan = Ordered(by_match(classify(builds), split), key, ["spawn_t", *[c for c in _tie(builds) if c not in key]], split)
    scan.neighbour("_next", {"spawn_t": F.col("spawn_t")}, after=True)
    scan.with_column("predicted", F.coalesce(
        F.abs(F.col("_next.spawn_t") - F.col("close_t")) <= F.lit(DUPLICATE_WINDOW_S), F.lit(False)))
    scan.neighbour("_prev", {"spawn_t": F.col("spawn_t"), "predicted": F.col("predicted")})
    inherited = F.when(F.coalesce("_prev.predicted", F.lit(False)), F.col("_prev.spawn_t")).otherwise(F.col("spawn_t"))
    return scan.rows().where(~F.col("predicted")).withColumn("spawn_t", inherited).drop("_next", "_prev", "predicted")


def detect_edits(pieces: DataFrame, split: bool = False) -> DataFrame:
    """Add what the piece replaced in its cell (same kind): an edit if the new shape is an edit variant, else a reset."""
    key = ["match_id", "x", "y", "z", "kind"]
    scan = Ordered(pieces, key, ["spawn_t", *_tie(pieces)], split)
    scan.neighbour("_prev", {"shape": F.col("shape"), "close_t": F.col("close_t")})
    replaced = F.coalesce(
        (F.col("prev_shape") != F.col("shape")) & (F.abs(F.col("spawn_t") - F.col("prev_close_t")) <= F.lit(EDIT_WINDOW_S)),
        F.lit(False))
    return scan.rows().withColumns({"prev_shape": F.col("_prev.shape"), "prev_close_t": F.col("_prev.close_t")}).drop("_prev").withColumns(
        {"is_edit": replaced & F.col("edited"), "is_reset": replaced & ~F.col("edited")})


def player_states(positions: DataFrame, teams: DataFrame, weapons: DataFrame | None, split: bool = False) -> DataFrame:
    """What is known of each player over time: rows valid on [since, until) with place, team and whether the
    building tool is held. Covers every player with any position, from before the first event to the end.

    A match's states are numbered in time and cut into buckets of a few states per player, however unevenly they are
    spread over time; a state covers `bucket` to `last_bucket` (null: to the end of the match).
    """
    keys = ["match_id", "player_id"]
    since = F.col("t").cast("double").alias("since")
    place = positions.where(F.col("player_id").isNotNull()).select(
        *keys, since, F.struct(F.col("t").cast("double").alias("t"), "x", "y", "z").alias("place"))
    side = teams.where(F.col("player_id").isNotNull()).select(
        *keys, since, F.struct(F.col("t").cast("double").alias("t"), F.col("team_index").cast("long").alias("v")).alias("side"))
    sources = [place, side]
    if weapons is not None:
        tool = F.coalesce(F.contains(F.col("weapon_class"), F.lit("BuildingTool")), F.lit(False))
        sources.append(weapons.where(F.col("player_id").isNotNull()).select(
            *keys, since, F.struct(F.col("t").cast("double").alias("t"), tool.alias("v")).alias("held")))
    start = place.select(*keys).distinct().withColumns({"since": F.lit(float("-inf")), "seen": F.lit(True)})
    events = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [by_match(s, split) for s in [*sources, start]])
    if weapons is None:
        events = events.withColumn("held", F.lit(None).cast("struct<t:double,v:boolean>"))
    # One row per instant, so that the order is unique: at the same time the highest payload counts.
    events = events.groupBy(*keys, "since").agg(
        *[F.max(c).alias(c) for c in ("place", "side", "held")], F.bool_or("seen").alias("seen"))
    scan = Ordered(events, keys, ["since"], split)
    scan.running_all({f"_{c}": ("max", F.col(c)) for c in ("place", "side", "held", "seen")})
    known = scan.rows().where(F.col("_seen")).select(
        *keys, "since", F.col("_place.x").alias("px"), F.col("_place.y").alias("py"), F.col("_place.z").alias("pz"),
        F.col("_side.v").alias("team"), F.coalesce("_held.v", F.lit(False)).alias("tool"))
    size = by_match(start, split).groupBy("match_id").agg(F.count("*").alias("_players"))
    ranked = Ordered(known.join(size, "match_id"), ["match_id"], ["since", "player_id"], split).running(
        "_rank", "sum", F.lit(1), inclusive=False).rows()
    bucket = F.floor(F.coalesce("_rank", F.lit(0)) / F.greatest(F.lit(MIN_BUCKET_ROWS), 2 * F.col("_players"))).alias("bucket")
    ranked = ranked.select("*", bucket).drop("_rank", "_players")
    scan = Ordered(ranked, keys, ["since"], split).neighbour("_next", {"since": F.col("since"), "bucket": F.col("bucket")}, after=True)
    return scan.rows().select("*", F.coalesce("_next.since", F.lit(float("inf"))).alias("until"),
                              F.col("_next.bucket").alias("last_bucket")).drop("_next")


def attribute_builders(pieces: DataFrame, positions: DataFrame, teams: DataFrame, weapons: DataFrame | None = None,
                       max_dist: float = MAX_BUILDER_DIST, split: bool | None = None) -> DataFrame:
    """Add builder, builder_dist and builder_source to pieces.

    Candidates are the players on the piece's team at spawn time, or everyone seen in the match if there is none.
    New pieces prefer holders of the building tool; then the nearest wins, then the lowest id. Without a team the
    builder is only named within `max_dist`. builder_dist is the best candidate's distance (infinite if unknown).

    A piece meets each player's one state that is valid at its spawn time. States are listed under every bucket
    they cover, which at most doubles them; a piece has one bucket, so it is compared with a few states per
    candidate, and the best one is kept while joining, before any shuffle.
    """
    split = needs_split([positions, pieces]) if split is None else split
    pieces = materialize(pieces.withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    states = materialize(player_states(positions, teams, weapons, split), "states")
    new = ~(F.col("is_edit") | F.col("is_reset")) if "is_edit" in pieces.columns else F.lit(True)
    wanted = pieces.select("match_id", "_piece", F.col("spawn_t").alias("_at"), *[F.col(c).alias(f"_{c}") for c in "xyz"],
                           F.col("team_index").cast("long").alias("_team") if "team_index" in pieces.columns
                           else F.lit(None).cast("long").alias("_team"), new.alias("_new"))
    wanted = asof(by_match(wanted, split), by_match(states.select("match_id", "since", "bucket"), split), left_keys=["match_id"],
                  right_keys=["match_id"], left_t="_at", right_t="since", payload={"_bucket": "bucket"}, split=split)
    ends = states.groupBy("match_id").agg(F.max("bucket").alias("_end"))
    listed = states.join(ends, "match_id").withColumn(
        "_bucket", F.explode(F.sequence("bucket", F.coalesce("last_bucket", "_end")))).drop("bucket", "last_bucket", "_end")
    live = (F.col("since") <= F.col("_at")) & (F.col("_at") < F.col("until"))
    dist = F.coalesce(distance(*[F.col(f"p{c}") - F.col(f"_{c}") for c in "xyz"]), F.lit(float("inf")))
    used_tool = F.col("_new") & F.col("tool")
    score = F.struct((F.col("_new") & ~F.col("tool")).alias("no_tool"), F.least(dist, F.lit(RANKED_DIST)).alias("near"), "player_id",
                     dist.alias("dist"), used_tool.alias("used_tool"))

    def best(rows: DataFrame) -> DataFrame:
        return rows.where(live).groupBy("_piece").agg(F.min(score).alias("best"), F.count("*").alias("n"))

    of_team = best(wanted.where(F.col("_team").isNotNull()).join(
        listed.where(F.col("team").isNotNull()).withColumnRenamed("team", "_team"), ["match_id", "_team", "_bucket"]))
    of_team = materialize(of_team, "team-builders")
    others = wanted.join(of_team.select("_piece"), "_piece", "left_anti")
    of_all = best(others.join(listed, ["match_id", "_bucket"]))
    tool_or = F.when(F.col("best.used_tool"), "tool").otherwise("nearest")
    team_source = F.when(F.col("n") == 1, "team").otherwise(F.concat(F.lit("team+"), tool_or))
    close = F.col("best.dist") <= F.lit(float(max_dist))
    chosen = of_team.select("_piece", F.col("best.player_id").alias("builder"), F.col("best.dist").alias("builder_dist"),
                            team_source.alias("builder_source")).unionByName(of_all.select(
        "_piece", F.when(close, F.col("best.player_id")).alias("builder"), F.col("best.dist").alias("builder_dist"),
        F.when(close, tool_or).alias("builder_source")))
    return pieces.join(chosen, "_piece", "left").withColumn(
        "builder_dist", F.coalesce("builder_dist", F.lit(float("inf")))).drop("_piece")


def build_pieces(builds: DataFrame, positions: DataFrame, teams: DataFrame, weapons: DataFrame | None = None,
                 split: bool | None = None) -> DataFrame:
    """The pieces table: parse, detect edits, attribute builders."""
    split = needs_split([builds, positions]) if split is None else split
    return attribute_builders(detect_edits(parse_pieces(builds, split), split), positions, teams, weapons, split=split)

"""Poke labels: what a one-sided engagement without a knock caused afterwards. Produces the pokes table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skirmish.functions.columns import distance, joined
from skirmish.operators.intervals import point_in_interval
from skirmish.operators.ordered import asof, needs_split
from skirmish.plans.fights import (
    BUCKET_S, GAP_S, GRACE_S, HIT_POS_MAX_AGE_S, OVERLAP_TOL_S, POKE_CONVERT_S, POKE_MINORITY_SHARE, by_match,
    fresh_positions, group_fights, seconds, seg_version, team_at,
)
from skirmish.session import materialize

# Build tile in Unreal units, structure radius in tiles.
TILE_UU = 512.0
STRUCTURE_RADIUS_TILES = 2.0


def check_segmentation(poke_ids: DataFrame, hits: DataFrame) -> None:
    """Raise if a poke's fight is not among the hits' fights (fight_sides came from other parameters)."""
    if not poke_ids.join(hits.select("match_id", "fight_id"), ["match_id", "fight_id"], "left_anti").isEmpty():
        raise ValueError("some pokes have no fight under this gap and tolerance: use the segmentation fight_sides came from")


def poke_pairs(hits: DataFrame) -> DataFrame:
    """Per fight: the team that dealt most, its main target team (ties: lowest index), net damage between the two,
    the target players it hit there, and the fight's span."""
    fight = ["match_id", "fight_id"]
    flows = hits.groupBy(*fight, "source_team", "target_team").agg(
        F.sum("magnitude").alias("dealt"), F.collect_set("target").alias("targets"),
        F.min("t").alias("t0"), F.max("t").alias("t_end"))
    # Team pairs of a fight are few; the whole exchange travels as a small map next to the totals.
    by_source = flows.groupBy(*fight, "source_team").agg(
        F.sum("dealt").alias("total"), F.min("t0").alias("t0"), F.max("t_end").alias("t_end"),
        F.max(F.struct("dealt", (-F.col("target_team")).alias("order"), "target_team", "targets")).alias("main"),
        F.map_from_entries(F.collect_list(F.struct("target_team", "dealt"))).alias("dealt_to"))
    best = by_source.groupBy(*fight).agg(
        F.min("t0").alias("t0"), F.max("t_end").alias("t_end"),
        F.max_by(F.struct("source_team", "main"), F.struct("total", -F.col("source_team"))).alias("best"),
        F.map_from_entries(F.collect_list(F.struct("source_team", "dealt_to"))).alias("exchange"))
    poker, target = F.col("best.source_team"), F.col("best.main.target_team")
    back = F.coalesce(F.col("exchange")[target][poker], F.lit(0.0))
    return best.select(*fight, poker.alias("poker_team"), target.alias("target_team"), "t0", "t_end",
                       (F.col("best.main.dealt") - back).alias("net_damage"), joined(F.col("best.main.targets")).alias("target_players"))


def target_members(pairs: DataFrame, *keep: str) -> DataFrame:
    """One row per (poke, target player)."""
    return pairs.select("match_id", "fight_id", "t0", "t_end", *keep, F.explode(F.split("target_players", ";")).alias("player"))


def label_conversion(pairs: DataFrame, elims: DataFrame, teams: DataFrame, convert_s: float | Column = POKE_CONVERT_S,
                     grace_s: float = GRACE_S, by: Sequence[str] = (), split: bool = False) -> DataFrame:
    """First knock or elimination of a target player in (t_end + grace, t_end + convert]: who caused it and when.

    environment: the victim itself, or nobody with a team; poker: the poking team; third_party: any other.
    Simultaneous events: lowest victim id, then lowest eliminator id.
    """
    convert = convert_s if isinstance(convert_s, Column) else F.lit(float(convert_s))
    targets = target_members(pairs, "poker_team", *by).withColumnRenamed("player", "eliminated")
    events = elims.where(F.col("eliminated").isNotNull()).select("match_id", "eliminated", "eliminator", seconds().alias("t"))
    inside = point_in_interval(events, targets, keys=["match_id", "eliminated"], t="t", lo=F.col("t_end") + F.lit(float(grace_s)),
                               hi=F.col("t_end") + convert, width=BUCKET_S, lo_open=True)
    first = inside.groupBy(*by, "match_id", "fight_id", "poker_team", "t_end").agg(
        F.min(F.struct("t", "eliminated", "eliminator")).alias("e")).select(
        *by, "match_id", "fight_id", "poker_team", "t_end", "e.*")
    placed = team_at(by_match(first, split), "eliminator", "t", by_match(teams, split), "killer_team", split)
    nobody = F.col("killer_team").isNull() | F.coalesce(F.col("eliminator") == F.col("eliminated"), F.lit(False))
    source = F.when(nobody, "environment").when(F.col("killer_team") == F.col("poker_team"), "poker").otherwise("third_party")
    return placed.select(*by, "match_id", "fight_id", source.alias("converted_by"),
                         F.when(~nobody, F.col("killer_team")).alias("converter_team"), (F.col("t") - F.col("t_end")).alias("t_convert"))


def storm_deaths(players: DataFrame, positions: DataFrame, split: bool = False) -> DataFrame:
    """Players who died while the last known (non-null) storm flag at or before their death was on."""
    dead = players.where(F.col("death_time").isNotNull()).select("match_id", "player_id", "death_time")
    flags = positions.where(F.col("in_storm").isNotNull()).select("match_id", "player_id", "t", "in_storm")
    placed = asof(by_match(dead, split), by_match(flags, split), left_keys=["match_id", "player_id"],
                  right_keys=["match_id", "player_id"], left_t="death_time", payload={"storm": "in_storm"}, split=split)
    return placed.where("storm").select("match_id", "player_id", "death_time")


def label_storm_death(pairs: DataFrame, players: DataFrame, positions: DataFrame, convert_s: float | Column = POKE_CONVERT_S,
                      by: Sequence[str] = (), split: bool = False) -> DataFrame:
    """Fights with a target player who died in the storm in [t0, t_end + convert]."""
    convert = convert_s if isinstance(convert_s, Column) else F.lit(float(convert_s))
    died = storm_deaths(players, positions, split).withColumnRenamed("player_id", "player")
    near = target_members(pairs, *by).join(died, ["match_id", "player"])
    return near.where((F.col("death_time") >= F.col("t0")) & (F.col("death_time") <= F.col("t_end") + convert)).select(
        *by, "match_id", "fight_id").distinct()


def structure_hits(damage: DataFrame, teams: DataFrame, split: bool = False) -> DataFrame:
    """Damage to anything but players with a known place and source, the source's team at that time, and a row id."""
    rows = damage.where(F.col("target").isNull() & F.col("source").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
                        & (F.col("magnitude") > 0)).select("match_id", "t", "source", "magnitude", "x", "y")
    placed = team_at(by_match(rows, split), "source", "t", by_match(teams, split), "team", split)
    return materialize(placed.where(F.col("team").isNotNull()).withColumn("hit", F.monotonically_increasing_id()), "structure")


def label_structure_pressure(pairs: DataFrame, damage: DataFrame, teams: DataFrame, positions: DataFrame,
                             radius_uu: float = STRUCTURE_RADIUS_TILES * TILE_UU, max_age_s: float = HIT_POS_MAX_AGE_S,
                             split: bool = False) -> DataFrame:
    """Per fight with any: structure damage and hits of the poking team during [t0, t_end] that land within
    `radius_uu` (horizontally) of a target player's last position. A hit counts once, however many are near."""
    hits = structure_hits(damage, teams, split)
    pokes = pairs.select("match_id", F.col("poker_team").alias("team"), "fight_id", "t0", "t_end", "target_players")
    during = point_in_interval(hits, pokes, keys=["match_id", "team"], t="t", lo="t0", hi="t_end", width=BUCKET_S)
    looks = materialize(during.select("match_id", "fight_id", "hit", "t", "magnitude", "x", "y",
                                      F.explode(F.split("target_players", ";")).alias("player_id")), "structure-looks")
    points = fresh_positions(positions.select("match_id", "player_id", "t", "x", "y"), looks, max_age_s)
    placed = asof(by_match(looks, split), by_match(points, split), left_keys=["match_id", "player_id"], right_keys=["match_id", "player_id"],
                  left_t="t", payload={"px": "x", "py": "y"}, max_age=max_age_s, split=split)
    near = placed.where(distance(F.col("px") - F.col("x"), F.col("py") - F.col("y")) <= F.lit(float(radius_uu)))
    once = near.groupBy("match_id", "fight_id", "hit").agg(F.max("magnitude").alias("magnitude"))
    return once.groupBy("match_id", "fight_id").agg(F.sum("magnitude").alias("structure_damage"), F.count("*").alias("structure_hits"))


def build_pokes(damage: DataFrame, teams: DataFrame, elims: DataFrame, players: DataFrame, positions: DataFrame,
                fight_sides: DataFrame, *, gap_s: float = GAP_S, overlap_tol_s: float = OVERLAP_TOL_S, grace_s: float = GRACE_S,
                poke_minority_share: float = POKE_MINORITY_SHARE, convert_s: float = POKE_CONVERT_S,
                structure_radius_tiles: float = STRUCTURE_RADIUS_TILES, hits: DataFrame | None = None,
                split: bool | None = None) -> DataFrame:
    """The pokes table, one row per fight of type poke. Parameters must be those `fight_sides` was built with."""
    split = needs_split([damage, positions]) if split is None else split
    if hits is None:
        hits = group_fights(damage, teams, gap_s, overlap_tol_s, split)
    ids = fight_sides.where(F.col("engagement_type") == "poke").select("match_id", "fight_id").distinct()
    check_segmentation(ids, hits)
    pairs = materialize(poke_pairs(by_match(hits, split).join(by_match(ids, split), ["match_id", "fight_id"], "left_semi")), "pokes")
    fight = ["match_id", "fight_id"]
    conv = label_conversion(pairs, elims, teams, convert_s, grace_s, split=split)
    storm = label_storm_death(pairs, players, positions, convert_s, split=split).withColumn("storm", F.lit(True))
    struct = label_structure_pressure(pairs, damage, teams, positions, structure_radius_tiles * TILE_UU, split=split)
    out = pairs.join(conv, fight, "left").join(storm, fight, "left").join(struct, fight, "left")
    version = seg_version(gap_s, overlap_tol_s, grace_s, poke_minority_share, convert_s)
    return out.withColumns({
        "converted": F.col("converted_by").isNotNull(), "storm_death": F.coalesce("storm", F.lit(False)),
        "structure_damage": F.coalesce("structure_damage", F.lit(0.0)), "structure_hits": F.coalesce("structure_hits", F.lit(0).cast("long")),
        "seg_version": F.lit(version)}).select(
        "fight_id", "match_id", "poker_team", "target_team", "t0", "t_end", "net_damage", "target_players", "converted", "converted_by",
        "converter_team", "t_convert", "storm_death", "structure_damage", "structure_hits", "seg_version")

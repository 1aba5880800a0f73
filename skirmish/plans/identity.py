"""Relational parts of reading a match: who a channel is, who recorded it, and what a piece last looked like."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skirmish.operators.ordered import asof


def resolve_players(reads: DataFrame, links: DataFrame, states: DataFrame, opens: DataFrame, split: bool = False) -> DataFrame:
    """Reads (match_id, t, channel, ...) with `player_id`: pawn channel -> player-state guid -> state channel -> player.

    `links` (match_id, t, channel, state_guid): what a pawn last pointed at. `opens` (match_id, t, channel, guid): the
    channel an actor guid was last opened on. `states` (match_id, t, channel, player_id): the player a state channel
    announced. A row with a null payload is a reset (the channel was reused) and hides everything before it. If the
    chain breaks, the channel's own announced player is used.
    """
    def look(df: DataFrame, by: str, table: DataFrame, key: str, value: str, out: str) -> DataFrame:
        return asof(df, table, left_keys=["match_id", by], right_keys=["match_id", key], left_t="t", payload={out: value}, split=split)

    step = look(reads, "channel", links, "channel", "state_guid", "_guid")
    step = look(step, "_guid", opens, "guid", "channel", "_state_channel")
    step = look(step, "_state_channel", states, "channel", "player_id", "_linked")
    step = look(step, "channel", states, "channel", "player_id", "_own")
    return step.withColumn("player_id", F.coalesce("_linked", "_own")).drop("_guid", "_state_channel", "_linked", "_own")


def _most_frequent(rows: DataFrame, out: str) -> DataFrame:
    """Per match the player with most rows; ties go to the earliest first row, then the lowest id."""
    counts = rows.where(F.col("player_id").isNotNull()).groupBy("match_id", "player_id").agg(
        F.count("*").alias("n"), F.min("t").alias("first_t"))
    return counts.groupBy("match_id").agg(F.min_by("player_id", F.struct(-F.col("n"), "first_t", "player_id")).alias(out))


def match_owners(match_ids: DataFrame, players: DataFrame, health: DataFrame, positions: DataFrame) -> DataFrame:
    """`match_id, replay_owner`: the flagged player, else the most frequent health owner, else the most frequent
    position owner."""
    flagged = players.where("is_replay_owner").groupBy("match_id").agg(F.min("player_id").alias("_flagged"))
    out = match_ids.select("match_id").join(flagged, "match_id", "left")
    out = out.join(_most_frequent(health, "_health"), "match_id", "left").join(_most_frequent(positions, "_positions"), "match_id", "left")
    return out.select("match_id", F.coalesce("_flagged", "_health", "_positions").alias("replay_owner"))


def class_counts(spawns: DataFrame, path: str = "path") -> DataFrame:
    """Spawn count per actor class."""
    return spawns.groupBy(F.col(path).alias("path")).agg(F.count("*").alias("spawns"))


def fold_pieces(updates: DataFrame) -> DataFrame:
    """Per piece the latest non-null attributes and the lowest health over its property updates
    (match_id, piece, t, seq, owner_persistent_id, team_index, max_health, player_placed, health)."""
    when = F.struct("t", "seq")

    def latest(c: str):
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), when)).alias(c)

    return updates.groupBy("match_id", "piece").agg(
        *[latest(c) for c in ("owner_persistent_id", "team_index", "max_health", "player_placed")], F.min("health").alias("min_health"))

"""Results of events: who a name stood for when, gates on placements, and what follows about players.

A name at a source belongs to whoever was last seen under it: sightings become ranges [valid_from, valid_to), the last one open. Names
are matched as they are written, never by likeness; a name seen for two players on one day is nobody's on that day and until its
next sighting. Results outside every range stay unresolved and count against the gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skirmish.operators.ordered import Ordered, asof, change_only

# Least share of resolved results, and what counts as resolved.
MIN_RESOLVED = 0.95
TRUSTED = ("exact", "manual")


def name_ranges(sightings: DataFrame, split: bool = False) -> DataFrame:
    """(source, source_key, player_id, valid_from, valid_to) from (source, source_key, player_id, day); null player_id marks a dispute."""
    daily = sightings.where(F.col("player_id").isNotNull()).groupBy("source", "source_key", "day").agg(
        F.min("player_id").alias("_low"), F.max("player_id").alias("_high"))
    seen = daily.withColumn("player_id", F.when(F.col("_low") == F.col("_high"), F.col("_low"))).drop("_low", "_high")
    changed = change_only(seen, ["source", "source_key"], ["day"], "player_id", split)
    scan = Ordered(changed, ["source", "source_key"], ["day"], split).neighbour("_next", {"day": F.col("day")}, after=True)
    return scan.rows().select("source", "source_key", "player_id", F.col("day").alias("valid_from"), F.col("_next.day").alias("valid_to"))


def resolve_results(results: DataFrame, ranges: DataFrame, split: bool = False) -> DataFrame:
    """Results (source, source_key, day, ...) with `player_id`: the owner of the name on that day, null if nobody is known."""
    return asof(results, ranges, left_keys=["source", "source_key"], right_keys=["source", "source_key"], left_t="day", right_t="valid_from",
                payload={"player_id": "player_id"}, split=split)


def placement_gate(results: DataFrame) -> DataFrame:
    """Per event: teams, entrants, missing and repeated places, places out of range, teams with several places, and `ok`."""
    teams = results.groupBy("event_id", "team_key").agg(F.min("placement").alias("placement"), F.max("placement").alias("_high"), F.count("placement").alias("_known"),
                                                       F.count("*").alias("_rows"), F.max("field_size").alias("field_size"))
    split_teams = F.sum(((F.col("placement") != F.col("_high")) | (F.col("_known") < F.col("_rows"))).cast("long"))
    places = teams.groupBy("event_id", "placement").agg(F.count("*").alias("_n"), F.max("field_size").alias("field_size"), F.coalesce(split_teams, F.lit(0)).alias("_split"))
    in_range = F.col("placement").between(1, F.col("field_size"))
    events = places.groupBy("event_id").agg(
        F.sum("_n").alias("teams"), F.max("field_size").alias("field_size"), F.count_if(in_range).alias("_found"),
        F.coalesce(F.sum(F.when(F.col("placement").isNotNull(), F.col("_n") - 1)), F.lit(0)).alias("repeated"),
        F.coalesce(F.sum(F.when(~F.coalesce(in_range, F.lit(False)), F.col("_n"))), F.lit(0)).alias("out_of_range"), F.coalesce(F.sum("_split"), F.lit(0)).cast("long").alias("divided"))
    missing = F.col("field_size") - F.col("_found")
    ok = (missing == 0) & (F.col("repeated") == 0) & (F.col("out_of_range") == 0) & (F.col("divided") == 0)
    return events.select("event_id", "teams", "field_size", missing.alias("missing"), "repeated", "out_of_range", "divided", F.coalesce(ok, F.lit(False)).alias("ok"))


def resolved_gate(resolved: DataFrame, wanted: Column | None = None, least: float = MIN_RESOLVED) -> DataFrame:
    """One row (n, share, ok): results (that are `wanted`) with a known player."""
    rows = resolved.where(wanted) if wanted is not None else resolved
    share = F.try_divide(F.count("player_id"), F.count("*"))
    return rows.agg(F.count("*").alias("n"), share.alias("share"), F.coalesce(share >= F.lit(least), F.lit(False)).alias("ok"))


def player_careers(resolved: DataFrame) -> DataFrame:
    """(player_id, debut_day, last_day, events, display_name): the first day in the results, and the latest name (the greatest of one day)."""
    rows = resolved.where(F.col("player_id").isNotNull())
    return rows.groupBy("player_id").agg(F.min("day").alias("debut_day"), F.max("day").alias("last_day"), F.count_distinct("event_id").alias("events"),
                                         F.max(F.struct("day", "source_key"))["source_key"].alias("display_name"))

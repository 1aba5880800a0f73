"""Queries of the operators that go beyond the inventory: response times, zone context, and what follows from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.catalog.queries import query, rounded
from skirmish.plans import cover, fights as fp, latency, metrics, panes, results, skill, zones


def responses(t):
    eng = fp.engagement_damage(t.damage, t.teams, t.split)
    return latency.hit_responses(eng, t.placed_pieces, t.poses, split=t.split)


@query
def p1_hit_responses(t):
    return rounded(responses(t), *latency.RESPONSES)


@query
def p1_response_quantiles(t):
    return rounded(latency.response_quantiles(responses(t)), "p25", "p50", "p75", "iqr")


@query
def p2_zone_crossings(t):
    return rounded(zones.zone_crossings(t.positions, zones.zone_phases(t.zones), split=t.split), "entry_t", "caught_t")


@query
def p2_rotation_timing(t):
    phases = zones.zone_phases(t.zones)
    return rounded(zones.rotation_timing(zones.zone_crossings(t.positions, phases, split=t.split), phases, t.teams, t.split), "entry_t", "lead_s")


@query
def p2_fight_zone_context(t):
    found = zones.fight_zone_context(t.sides, t.positions, zones.zone_phases(t.zones), split=t.split)
    return rounded(found.drop("match_id"), "to_shrink_s", "edge_now", "edge_next")


@query
def p3_cover_at_start(t):
    pieces = cover.with_builder_team(t.placed_pieces, t.teams, t.split)
    return cover.cover_at_start(t.sides, t.positions, pieces, radius=300.0, split=t.split).drop("match_id")


def with_expected(sides):
    """Sides with `expected`, their share of the players on both sides."""
    size = F.size(F.split("players", ";"))
    other = sides.select("fight_id", F.col("team_index").alias("opp_team_index"), size.alias("_opp"))
    return sides.join(other, ["fight_id", "opp_team_index"]).withColumn("expected", size / (size + F.col("_opp"))).drop("_opp")


def credits(t):
    return skill.player_credits(skill.side_residuals(with_expected(t.sides), F.col("expected")), t.hits)


def shrinkage(t):
    return skill.reliability(skill.half_sums(credits(t), ["match_id", "t0", "fight_id", "team_index"], t.split))


@query
def p4_player_credits(t):
    return rounded(credits(t).select("fight_id", "team_index", "player_id", "dealt", "credit"), "dealt", "credit")


@query
def p4_shrinkage(t):
    return rounded(shrinkage(t), "r")


@query
def p4_values_before(t):
    """One day per match, an event every ten days."""
    days = match_days(t)
    events = days.select(((F.floor(F.col("day") / 10) + 1) * 10).cast("int").alias("event_day")).distinct()
    found = skill.values_before(credits(t), days, events, skill.best_shrinkage(shrinkage(t)))
    return rounded(found, "value")


def forecasts(t):
    """Decided sides with a forecast of the win, and a graded gain."""
    won = F.when(F.col("outcome") == "win", 1).when(F.col("outcome") == "loss", 0)
    gain = F.when(F.col("outcome") == "win", 2).when(F.col("outcome") == "tie", 1).otherwise(0)
    return with_expected(t.sides).select("match_id", "fight_id", "team_index", "hits_dealt", "hits_taken", "expected", won.alias("won"), gain.alias("gain"))


@query
def p5_bootstrap(t):
    decided = F.col("won").isNotNull().cast("int")
    return rounded(metrics.bootstrap(forecasts(t), "match_id", F.coalesce("won", F.lit(0)), decided), "estimate", "low", "high")


@query
def p6_auc(t):
    return rounded(metrics.auc(forecasts(t), "expected", F.col("won")), "auc")


@query
def p6_auc_by_match(t):
    return rounded(metrics.auc(forecasts(t), "hits_dealt", F.col("won"), ["match_id"]), "auc")


@query
def p6_spearman(t):
    return rounded(metrics.spearman(forecasts(t), "hits_dealt", "hits_taken"), "rho")


@query
def p6_ndcg(t):
    rows = forecasts(t)
    at = [metrics.ndcg(rows, "match_id", "hits_dealt", "gain", k).withColumn("k", F.lit(k)) for k in metrics.CUTS]
    return rounded(at[0].unionByName(at[1]), "ndcg")


@query
def p6_reliability_bins(t):
    return rounded(metrics.reliability_bins(forecasts(t), "expected", F.col("won")), "mean_p", "rate", "gap")


def match_days(t):
    return t.match_ids.select("match_id", (F.substring("match_id", 2, 10).cast("int") * 3 % 200).alias("day"))


def window_quantiles(t):
    rows = responses(t).join(match_days(t), "match_id").select(F.col("victim").alias("player_id"), "day", "build_s")
    stored = panes.daily_panes(rows, ["player_id"], "day", "build_s")
    ends = match_days(t).select(((F.floor(F.col("day") / 10) + 1) * 10).cast("int").alias("end_day")).distinct()
    summed = panes.window_panes(stored, ends, ["player_id"])
    return panes.pane_quantiles(summed, ["player_id", "end_day"], {"p25": 0.25, "p50": 0.5, "p75": 0.75}, split=t.split)


@query
def p7_pane_quantiles(t):
    return rounded(window_quantiles(t), "p25", "p50", "p75")


@query
def p7_trend(t):
    return rounded(panes.trend(window_quantiles(t), ["player_id"]), "slope")


def event_results(t):
    """Every match as an event of four teams: names move on from player to player, some events give one place twice."""
    n, p = F.substring("match_id", 2, 10).cast("int"), F.col("p")
    place = F.when((n % 5 == 0) & (p % 4 == 3), 1 + n % 4).otherwise(1 + (p % 4 + n) % 4)
    return t.roster.join(match_days(t), "match_id").select(
        F.col("match_id").alias("event_id"), "day", F.lit("list").alias("source"), F.concat(F.lit("N"), ((p + F.floor(F.col("day") / 40)) % 12).cast("string")).alias("source_key"),
        F.col("player_id").alias("_player"), F.concat(F.lit("T"), (p % 4).cast("string")).alias("team_key"), place.cast("long").alias("placement"),
        F.lit(4).cast("long").alias("field_size"), ((n + p) % 4 != 0).alias("_seen"))


def name_ranges(t):
    seen = event_results(t).where("_seen").select("source", "source_key", F.col("_player").alias("player_id"), "day")
    return results.name_ranges(seen, t.split)


def resolved(t):
    return results.resolve_results(event_results(t).drop("_player", "_seen"), name_ranges(t), t.split)


@query
def p8_name_ranges(t):
    return name_ranges(t)


@query
def p8_resolved_results(t):
    return resolved(t).select("event_id", "source_key", "day", "team_key", "player_id")


@query
def p8_placement_gate(t):
    return results.placement_gate(event_results(t))


@query
def p8_resolved_gate(t):
    return rounded(results.resolved_gate(resolved(t)), "share")


@query
def p8_player_careers(t):
    return results.player_careers(resolved(t))

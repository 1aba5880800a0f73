"""Exploration reports over damage, knocks and segments, as long (metric, value) or grouped rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skirmish.operators.intervals import bucketed_intervals, point_in_interval
from skirmish.operators.ordered import Ordered, asof
from skirmish.operators.quantiles import percentiles
from skirmish.plans.fights import (
    BUCKET_S, GRACE_S, by_match, first_knocks, is_engagement, seconds, segment_spans, team_at, team_pair_segments, with_teams,
)
from skirmish.plans.sweeps import GAPS, each
from skirmish.session import materialize

# Reported quantiles and link windows.
GAP_QUANTILES = {"p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}
LINK_WINDOWS = (0.0, 5.0, 10.0, 20.0, 30.0)


def long_rows(row: DataFrame, *names: str) -> DataFrame:
    """One (metric, value) row per column of a one-row table."""
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))


def damage_facts(damage: DataFrame, teams: DataFrame, split: bool = False) -> DataFrame:
    """Row counts and rates: no target, zero magnitude, self-hits; then resolved and friendly among engagement rows."""
    share = lambda c: F.try_divide(F.count_if(c), F.count("*"))
    raw = damage.agg(F.count("*").alias("rows"), share(F.col("target").isNull()).alias("target_null"),
                     share(F.col("magnitude") == 0).alias("mag0"), share(F.col("source") == F.col("target")).alias("self_hits"))
    hits = by_match(damage.where(is_engagement()).select("match_id", "t", "source", "target"), split)
    placed = with_teams(hits, by_match(teams, split), split)
    known = F.col("source_team").isNotNull() & F.col("target_team").isNotNull()
    eng = placed.agg(F.count("*").alias("engagement_rows"), share(known).alias("team_resolved"),
                     F.try_divide(F.count_if(F.col("source_team") == F.col("target_team")), F.count_if(known)).alias("friendly"))
    return long_rows(raw, "rows", "target_null", "mag0", "self_hits").unionByName(
        long_rows(eng, "engagement_rows", "team_resolved", "friendly"))


def hit_gaps(eng: DataFrame, split: bool = False) -> DataFrame:
    """Time since the previous hit of the same team pair, one row per hit that has one."""
    scan = Ordered(eng, ["match_id", "team_a", "team_b"], ["t"], split).running("_prev", "max", F.col("t"), inclusive=False)
    return scan.rows().withColumn("gap", F.col("t") - F.col("_prev")).where(F.col("gap").isNotNull()).drop("_prev")


def gap_quantiles(eng: DataFrame, split: bool = False) -> DataFrame:
    return percentiles(hit_gaps(eng, split), [], "gap", GAP_QUANTILES)


def segments_by_gap(eng: DataFrame, gaps: Sequence[float] = GAPS, split: bool = False) -> DataFrame:
    """Number of team-pair segments per gap, and of (match, pair) groups."""
    spans = segment_spans(team_pair_segments(each(eng, "gap", gaps), F.col("gap"), by=["gap"], split=split), ["gap"])
    per_pair = spans.groupBy("gap", "match_id", "team_a", "team_b").agg(F.count("*").alias("n"))
    return per_pair.groupBy("gap").agg(F.sum("n").alias("segments"), F.count("*").alias("pairs"))


def elims_with_context(elims: DataFrame, teams: DataFrame, matches: DataFrame, split: bool = False) -> DataFrame:
    """Knocks and eliminations with both teams at event time and `recorder`: the match's recorder took part."""
    rows = by_match(elims.select("match_id", seconds().alias("t"), "eliminator", "eliminated", F.coalesce("knocked", F.lit(False)).alias("knocked")), split)
    tm = by_match(teams, split)
    rows = team_at(team_at(rows, "eliminated", "t", tm, "victim_team", split), "eliminator", "t", tm, "killer_team", split)
    owners = by_match(matches.select("match_id", "replay_owner"), split)
    took_part = (F.col("eliminated") == F.col("replay_owner")) | (F.col("eliminator") == F.col("replay_owner"))
    return rows.join(owners, "match_id", "left").withColumn("recorder", F.coalesce(took_part, F.lit(False))).drop("replay_owner")


def since_damage(events: DataFrame, damage: DataFrame, split: bool = False) -> DataFrame:
    """Events with `since`, the time since the last damage on the victim (null if there was none)."""
    hits = damage.where(F.col("target").isNotNull()).select("match_id", "target", "t")
    placed = asof(by_match(events, split), by_match(hits, split), left_keys=["match_id", "eliminated"], right_keys=["match_id", "target"],
                  left_t="t", payload={"hit_t": "t"}, split=split)
    return placed.withColumn("since", F.col("t") - F.col("hit_t")).drop("hit_t")


def since_damage_report(context: DataFrame, damage: DataFrame, split: bool = False) -> DataFrame:
    """Per knock group (recorder, all): knocks, share never damaged before, median and p90 time since damage."""
    knocks = since_damage(context.where("knocked"), damage, split)
    groups = F.when(F.col("recorder"), F.array(F.lit("recorder"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    rows = materialize(knocks.select(F.explode(groups).alias("knock_group"), "since"), "since-damage")
    base = rows.groupBy("knock_group").agg(F.count("*").alias("knocks"), F.try_divide(F.count_if(F.col("since").isNull()), F.count("*")).alias("no_damage"))
    return base.join(F.broadcast(percentiles(rows, ["knock_group"], "since", {"p50": 0.5, "p90": 0.9}, few_groups=True).drop("n_values")), "knock_group", "left")


def segment_links(spans: DataFrame, window_s: float) -> DataFrame:
    """Ordered pairs (segment, segment of another pair sharing a team) whose lag (later start - earlier end) is at
    most `window_s`: one row per pair with `lag`. Pairs meet in the time buckets their (widened) spans touch."""
    base = spans.select("match_id", "team_a", "team_b", "seg_start", "seg_end")
    per_team = base.withColumn("team", F.explode(F.array("team_a", "team_b")))
    left = bucketed_intervals(per_team, "seg_start", F.col("seg_end") + F.lit(float(window_s)), BUCKET_S)
    # Both sides end `window_s` later, so a pair within the window shares a bucket whichever comes first.
    right = left.select("match_id", "team", "_bucket", *[F.col(c).alias(f"o_{c}") for c in ("team_a", "team_b", "seg_start", "seg_end")])
    lag = F.greatest("seg_start", "o_seg_start") - F.least("seg_end", "o_seg_end")
    # Counted in the first bucket they share only.
    shared = F.floor(F.greatest("seg_start", "o_seg_start") / F.lit(BUCKET_S))
    other = (F.col("team_a") != F.col("o_team_a")) | (F.col("team_b") != F.col("o_team_b"))
    return left.join(right, ["match_id", "team", "_bucket"]).where(
        other & (F.col("_bucket") == shared)).withColumn("lag", lag).where(F.col("lag") <= F.lit(float(window_s))).drop("_bucket")


def link_counts(spans: DataFrame, window_s: float, split: bool = False) -> DataFrame:
    """Segments with `links`, the number of segments of other pairs that share a team and lie within `window_s` of them, and `lag`, the
    step to the nearest (0 if they overlap). Linear: what began by a segment's end plus the window, plus what ended from its start less the window on, less
    all, counts those within it; its own pair's are taken off. `segment_links` lists the pairs themselves, on request."""
    window = F.lit(float(window_s))
    key = ["match_id", "team_a", "team_b", "seg_start"]
    base = spans.select(*key, "seg_end")
    groups = F.array(F.array(F.col("team_a"), F.lit(None).cast("long")), F.array(F.col("team_b"), F.lit(None).cast("long")), F.array("team_a", "team_b"))
    rows = base.select("*", F.explode(groups).alias("_g")).select(*key, "seg_end", F.col("_g")[0].alias("_one"), F.coalesce(F.col("_g")[1], F.lit(-1)).alias("_two"))
    by = ["match_id", "_one", "_two"]

    def upto(column: str, out: str, back: bool) -> DataFrame:
        """How many segments of a group have `column` at or before (at or after) each of its values."""
        counts = rows.groupBy(*by, F.col(column).alias("t")).agg(F.count("*").alias("n"))
        return Ordered(counts, by, ["t"], split).running(out, "sum", F.col("n"), reverse=back).rows().select(*by, "t", out)

    met = asof(rows, upto("seg_start", "began", False), left_keys=by, right_keys=by, left_t=F.col("seg_end") + window, payload={"_began": "began"}, split=split)
    met = asof(met, upto("seg_end", "ending", True), left_keys=by, right_keys=by, left_t=F.col("seg_start") - window, payload={"_ending": "ending"}, forward=True, split=split)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_all"))
    near = F.col("_began") + F.col("_ending") - F.col("_all")
    counted = met.join(sizes, by).groupBy(*key).agg(F.sum(F.when(F.col("_two") == -1, near).otherwise(-2 * near)).alias("links"))
    return counted.join(nearest_links(spans, split), key, "left").withColumn("lag", F.when(F.col("lag").isNotNull(), F.greatest("lag", F.lit(0.0))))


def third_party_links(spans: DataFrame, windows: Sequence[float] = LINK_WINDOWS) -> DataFrame:
    """Per window: segments, how many have a team-sharing segment of another pair within it, and that share."""
    rows = each(nearest_links(spans), "link_window", windows)
    linked = F.count_if(F.col("lag") <= F.col("link_window"))
    return rows.groupBy("link_window").agg(F.count("*").alias("segments"), linked.alias("linked"), F.try_divide(linked, F.count("*")).alias("share"))


def nearest_links(spans: DataFrame, split: bool = False) -> DataFrame:
    """Segments with `lag`, the step to the nearest segment of another pair that shares a team; 0 or less if they overlap.

    Linear, whatever the bursts: per team, the latest end among the segments that began before and the earliest start among
    those that begin after are carried along, each with the best of any other opponent beside the best of all.
    """
    per_team = spans.select("match_id", "team_a", "team_b", "seg_start", "seg_end", F.explode(F.array(
        F.struct(F.col("team_a").alias("team"), F.col("team_b").alias("opp")), F.struct(F.col("team_b").alias("team"), F.col("team_a").alias("opp")))).alias("_s"))
    scan = Ordered(per_team.select("*", "_s.*").drop("_s"), ["match_id", "team"], ["seg_start", "seg_end", "opp"], split)
    for side, fn, value, pick, back in (("before", "max", "seg_end", F.least, False), ("after", "min", "seg_start", F.greatest, True)):
        own = F.struct(F.col(value).alias("v"), F.col("opp").alias("opp"))
        best, second = f"_{side}", f"_{side}_2"
        scan.running(best, fn, own, inclusive=False, reverse=back)
        # When another opponent comes up, the worse of it and the best so far is the best of the others.
        other = F.when(F.col(f"{best}.opp") != F.col("opp"), pick(own, F.col(best)))
        scan.running(second, fn, other, inclusive=False, reverse=back)
        scan.with_column(side, F.when(F.col(f"{best}.opp") != F.col("opp"), F.col(f"{best}.v")).otherwise(F.col(f"{second}.v")))
    lag = F.least(F.col("seg_start") - F.col("before"), F.col("after") - F.col("seg_end"))
    return scan.rows().groupBy("match_id", "team_a", "team_b", "seg_start").agg(F.min(lag).alias("lag"))


def in_segment(events: DataFrame, spans: DataFrame, grace_s: float = GRACE_S) -> DataFrame:
    """Events (with row id `event`) of a team pair with `in_seg`: inside a segment of that pair, grace included."""
    pairs = events.withColumns({"team_a": F.least("victim_team", "killer_team"), "team_b": F.greatest("victim_team", "killer_team")})
    inside = point_in_interval(pairs, spans.select("match_id", "team_a", "team_b", "seg_start", "seg_end"),
                               keys=["match_id", "team_a", "team_b"], t="t", lo="seg_start", hi=F.col("seg_end") + F.lit(float(grace_s)),
                               width=BUCKET_S).select("match_id", "event").distinct().withColumn("_in", F.lit(True))
    return pairs.join(inside, ["match_id", "event"], "left").withColumn("in_seg", F.coalesce("_in", F.lit(False))).drop("_in")


def opposing(context: DataFrame) -> DataFrame:
    return context.where(F.col("victim_team") != F.col("killer_team"))


def knock_segment_report(context: DataFrame, spans: DataFrame) -> DataFrame:
    """Per group (recorder, all): opposing-team knocks, inside a segment of their pair, misses, and misses whose pair
    has a segment elsewhere in the match."""
    events = materialize(opposing(context).where("knocked").withColumn("event", F.monotonically_increasing_id()), "knock-events")
    rows = in_segment(events, spans)
    pairs = spans.select("match_id", "team_a", "team_b").distinct().withColumn("_pair", F.lit(True))
    rows = rows.join(pairs, ["match_id", "team_a", "team_b"], "left")
    groups = F.when(F.col("recorder"), F.array(F.lit("recorder"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    return rows.withColumn("knock_group", F.explode(groups)).groupBy("knock_group").agg(
        F.count("*").alias("knocks"), F.count_if("in_seg").alias("inside"), F.count_if(~F.col("in_seg")).alias("misses"),
        F.count_if(~F.col("in_seg") & F.col("_pair")).alias("misses_elsewhere"))


def direct_elim_report(context: DataFrame, elims: DataFrame, spans: DataFrame) -> DataFrame:
    """Not-knocked eliminations, those without an earlier knock of the victim, the opposing-team ones, inside a segment."""
    rows = context.where(~F.col("knocked")).join(first_knocks(elims), ["match_id", "eliminated"], "left")
    rows = materialize(rows.withColumns({"direct": F.coalesce(F.col("first_knock") > F.col("t"), F.lit(True)),
                                         "event": F.monotonically_increasing_id()}), "direct-elims")
    counts = rows.agg(F.count("*").alias("elims"), F.count_if("direct").alias("direct"))
    placed = in_segment(opposing(rows.where("direct")), spans).agg(F.count("*").alias("opposing"), F.count_if("in_seg").alias("inside"))
    return long_rows(counts, "elims", "direct").unionByName(long_rows(placed, "opposing", "inside"))


def bot_teams(teams: DataFrame, players: DataFrame) -> DataFrame:
    """Per (match, team): `any_bot` and `all_bot` over the team's assignment rows; unknown players count as null."""
    rows = teams.select("match_id", "team_index", "player_id").join(
        players.select("match_id", "player_id", "is_bot"), ["match_id", "player_id"], "left")
    return rows.groupBy("match_id", "team_index").agg(
        F.bool_or("is_bot").alias("any_bot"), F.bool_and("is_bot").alias("all_bot"),
        F.count_if("is_bot").alias("bot_rows"), F.count("is_bot").alias("known_rows"))


def bot_report(teams: DataFrame, players: DataFrame, spans: DataFrame) -> DataFrame:
    """Shares: assignment rows of bots, teams with any / only bots, segments involving such a team."""
    flags = materialize(bot_teams(teams, players), "bot-teams")
    share = lambda c: F.try_divide(F.count_if(c), F.count("*"))
    per_team = flags.agg(F.try_divide(F.sum("bot_rows"), F.sum("known_rows")).alias("bot_rows"), share("any_bot").alias("teams_any_bot"),
                         share("all_bot").alias("teams_all_bot"))
    sides = spans.select("match_id", "team_a", "team_b", "seg_start", F.explode(F.array("team_a", "team_b")).alias("team_index"))
    segs = sides.join(flags, ["match_id", "team_index"], "left").groupBy("match_id", "team_a", "team_b", "seg_start").agg(
        F.coalesce(F.bool_or("any_bot"), F.lit(False)).alias("any_bot"), F.coalesce(F.bool_or("all_bot"), F.lit(False)).alias("all_bot"))
    per_seg = segs.agg(share("any_bot").alias("segments_any_bot"), share("all_bot").alias("segments_all_bot"))
    return long_rows(per_team, "bot_rows", "teams_any_bot", "teams_all_bot").unionByName(
        long_rows(per_seg, "segments_any_bot", "segments_all_bot"))


def side_tracks(fight_sides: DataFrame, positions: DataFrame, pad_s: float = 5.0) -> DataFrame:
    """Positions of a fight's engaged players from `pad_s` before its start to `pad_s` after its end."""
    sides = fight_sides.select("match_id", "fight_id", "team_index", "t0", "t_end", F.explode(F.split("players", ";")).alias("player_id"))
    points = positions.where(F.col("player_id").isNotNull()).select("match_id", "player_id", "t", "x", "y")
    pad = F.lit(float(pad_s))
    return point_in_interval(points, sides, keys=["match_id", "player_id"], t="t", lo=F.col("t0") - pad, hi=F.col("t_end") + pad,
                             width=BUCKET_S).select("match_id", "fight_id", "team_index", "player_id", "t", "x", "y")


def sample_ids(df: DataFrame, column: str, n: int, seed: int = 0) -> DataFrame:
    """`n` distinct ids in a seeded pseudo-random but reproducible order (the sampling operator)."""
    order: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(column)), 256)
    return df.select(column).distinct().orderBy(order, F.col(column)).limit(n)

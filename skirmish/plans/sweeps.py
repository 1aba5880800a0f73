"""Parameter sweeps: every setting of a grid in one job, the setting being part of the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from skirmish.operators.ordered import needs_split
from skirmish.operators.quantiles import percentiles
from skirmish.plans.fights import (
    by_match, engagement_damage, knock_coverage, label_outcomes, link_segments, outcome_events, recorder_knocks,
    segment_spans, team_pair_segments,
)
from skirmish.plans.pokes import label_conversion, label_storm_death, label_structure_pressure
from skirmish.session import materialize

# The grids.
GAPS = (5.0, 10.0, 15.0, 20.0)
TOLS = (0.0, 1.0, 2.0, 3.0)
GRACES = (1.0, 3.0, 5.0)
MINORITY_SHARES = (0.0, 0.05, 0.10, 0.15, 0.20, 0.30)
CONVERT_WINDOWS = (10.0, 20.0, 30.0, 45.0)
MERGE_WINDOWS = (0.0, 5.0, 10.0)

FEW_KNOCKS = 500_000
"""Knocks up to which a sweep leaves it to the planner how to meet the sides, mostly by sending the knocks around."""


def each(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """One copy of the rows per parameter value."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def link_by_tolerance(spans: DataFrame, tols: Sequence[float], by: Sequence[str] = (), split: bool = False) -> DataFrame:
    """Stored spans linked under every tolerance `tol`: tasks are sized by the copies, each once for either team."""
    rows = spans.count() * len(tols) * 2
    copies = each(by_match(spans, split, rows), "tol", tols)
    return link_segments(copies, F.col("tol"), by=[*by, "tol"], split=split, rows=rows)


def sides_of_segments(linked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(fight, team) rows with span, team list, `n_teams` and `first` (one true row per fight), from linked segments."""
    fight = [*by, "match_id", "n"]
    sides = linked.withColumn("team", F.explode(F.array("team_a", "team_b"))).groupBy(*fight, "team").agg(
        F.min("t0").alias("t0"), F.max("t_end").alias("t_end"))
    over = W.partitionBy(*fight)
    return sides.withColumns({"fight_teams": F.collect_list("team").over(over), "n_teams": F.count("*").over(over),
                              "first": F.col("team") == F.min("team").over(over)})


def segmentation_sweep(damage: DataFrame, teams: DataFrame, elims: DataFrame, matches: DataFrame, *,
                       gaps: Sequence[float] = GAPS, tols: Sequence[float] = TOLS, graces: Sequence[float] = GRACES,
                       split: bool | None = None) -> DataFrame:
    """Per (gap, tol, grace): fights, share with more than two teams, outcome shares of two-team sides, labelled
    two-team fights, duration p50 / p90 / max, and the share of recorder knocks inside / covered by a fight."""
    split = needs_split([damage]) if split is None else split
    grid = ["gap", "tol", "grace"]
    eng = materialize(engagement_damage(damage, teams, split), "engagement")
    # Copies are made after each layout, so that they are not shuffled, but counted before it: they are what a task sorts.
    copies = each(by_match(eng, split, eng.count() * len(gaps)), "gap", gaps)
    spans = materialize(segment_spans(team_pair_segments(copies, F.col("gap"), by=["gap"], split=split), ["gap"]), "sweep-spans")
    linked = link_by_tolerance(spans, tols, ["gap"], split)
    sides = materialize(sides_of_segments(linked, ["gap", "tol"]), "sweep-sides")
    n_sides = sides.count() * len(graces)
    events = materialize(outcome_events(elims, teams, split=split), "events")
    labelled = materialize(label_outcomes(
        each(by_match(sides, split, n_sides), "grace", graces), events, F.col("grace"), by=grid), "sweep-outcomes")
    two = F.col("n_teams") <= 2
    n_two = F.count_if(two)
    # A setting may leave no fight of two teams: its shares are 0.
    shares = [F.coalesce(F.try_divide(F.count_if(two & (F.col("outcome") == o)), n_two), F.lit(0.0)).alias(o) for o in ("win", "loss", "tie", "disengage")]
    counts = labelled.groupBy(*grid).agg(
        F.count_if("first").alias("fights"), F.try_divide(F.count_if(F.col("first") & (F.col("n_teams") > 2)), F.count_if("first")).alias("multi"),
        *shares, F.floor(F.count_if(two & F.col("outcome").isin("win", "loss")) / 2).cast("long").alias("labelled_2team"),
        F.max(F.col("t_end") - F.col("t0")).alias("dur_max"))
    spread = percentiles(sides.where("first").withColumn("dur", F.col("t_end") - F.col("t0")), ["gap", "tol"], "dur",
                         {"dur_p50": 0.5, "dur_p90": 0.9}, few_groups=True).drop("n_values")
    knocks = recorder_knocks(elims, teams, matches, split)
    n_knocks = knocks.count()
    skeleton = labelled.drop("first")
    if n_knocks > FEW_KNOCKS:
        skeleton = by_match(skeleton, split, n_sides)
    found = knock_coverage(knocks, skeleton, F.col("grace"), by=grid).groupBy(*grid).agg(
        F.count("*").alias("_in"), F.count_if("covered").alias("_covered"))
    rate = {new: F.coalesce(F.col(old), F.lit(0)) / F.nullif(F.lit(n_knocks), F.lit(0))
            for new, old in (("in_fight", "_in"), ("coverage", "_covered"))}
    # A handful of rows per table from here on: one per grid cell.
    return counts.join(F.broadcast(spread), ["gap", "tol"]).join(F.broadcast(found), grid, "left").withColumns(rate).select(
        *grid, "fights", "multi", "win", "loss", "tie", "disengage", "labelled_2team", "dur_p50", "dur_p90", "dur_max",
        "in_fight", "coverage")


def fight_rows(fight_sides: DataFrame) -> DataFrame:
    """One row per fight (its lowest team's side) with `decisive`: any side has an outcome."""
    over = W.partitionBy("match_id", "fight_id")
    return fight_sides.withColumns({
        "decisive": F.bool_or(F.col("outcome") != "disengage").over(over),
        "_first": F.col("team_index") == F.min("team_index").over(over)}).where("_first").drop("_first")


def type_sweep(fight_sides: DataFrame, shares: Sequence[float] = MINORITY_SHARES) -> DataFrame:
    """Per minority threshold, in percent: fights / picks / pokes, picks among decided fights, pokes among two-team ones."""
    rows = each(fight_rows(fight_sides).select("mutual", "minority_damage_share", "decisive", "multi_team"), "share", shares)
    two_sided = F.col("mutual") & (F.col("minority_damage_share") >= F.col("share"))
    kind = F.when(two_sided, "fight").when(F.col("decisive"), "pick").otherwise("poke")
    rows = rows.withColumn("kind", kind)

    def percent(hit, among=F.lit(True)):
        return F.lit(100.0) * F.count_if(among & hit) / F.nullif(F.count_if(among), F.lit(0))

    is_kind = {k: F.col("kind") == k for k in ("fight", "pick", "poke")}
    return rows.groupBy("share").agg(
        *[percent(c).alias(f"{k}_pct") for k, c in is_kind.items()],
        percent(is_kind["pick"], F.col("decisive")).alias("decided_pick_pct"),
        percent(is_kind["poke"], ~F.col("multi_team")).alias("two_team_poke_pct"))


def type_summary(fight_sides: DataFrame) -> DataFrame:
    """Per engagement type: fights, median hits per side, median of the fights' median distance, two-team percent."""
    f = materialize(fight_rows(fight_sides).withColumn("hits", (F.col("hits_dealt") + F.col("hits_taken")).cast("double")), "fight-rows")
    base = f.groupBy("engagement_type").agg(
        F.count("*").alias("fights"), (F.lit(100.0) * F.count_if(~F.col("multi_team")) / F.count("*")).alias("two_team_pct"))
    hits = percentiles(f, ["engagement_type"], "hits", {"hits_median": 0.5}, few_groups=True).select(
        "engagement_type", (F.col("hits_median") / 2).alias("hits_per_side_median"))
    dist = percentiles(f, ["engagement_type"], "dist_median_m", {"dist_median_m": 0.5}, few_groups=True).drop("n_values")
    return base.join(F.broadcast(hits), "engagement_type").join(F.broadcast(dist), "engagement_type", "left")


def convert_sweep(pairs: DataFrame, damage: DataFrame, teams: DataFrame, elims: DataFrame, players: DataFrame,
                  positions: DataFrame, windows: Sequence[float] = CONVERT_WINDOWS, split: bool = False) -> DataFrame:
    """Per conversion window: pokes, percent converted (and by whom), storm deaths, pokes with structure hits."""
    grid = each(pairs, "conv", windows)
    key = ["conv", "match_id", "fight_id"]
    conv = label_conversion(grid, elims, teams, F.col("conv"), by=["conv"], split=split)
    storm = label_storm_death(grid, players, positions, F.col("conv"), by=["conv"], split=split).withColumn("storm", F.lit(True))
    struct = label_structure_pressure(pairs, damage, teams, positions, split=split).select("match_id", "fight_id", "structure_hits")
    rows = grid.select(*key).join(conv, key, "left").join(storm, key, "left").join(struct, ["match_id", "fight_id"], "left")

    def percent(hit):
        return F.lit(100.0) * F.count_if(hit) / F.count("*")

    return rows.groupBy("conv").agg(
        F.count("*").alias("pokes"), percent(F.col("converted_by").isNotNull()).alias("converted_pct"),
        *[percent(F.col("converted_by") == c).alias(f"{c}_pct") for c in ("poker", "third_party", "environment")],
        F.count_if("storm").alias("storm_death"), F.count_if(F.col("structure_hits") > 0).alias("structure_pokes"))


def merge_window_report(segmented: DataFrame, windows: Sequence[float] = MERGE_WINDOWS, split: bool = False) -> DataFrame:
    """Per merge window: fights, multi-team share, teams and duration p50 / p90 / max, share of fights >= 60."""
    spans = materialize(segment_spans(segmented), "merge-spans")
    sides = sides_of_segments(link_by_tolerance(spans, windows, split=split), ["tol"])
    f = materialize(sides.where("first").select("tol", F.col("n_teams").cast("double").alias("n_teams"),
                                                (F.col("t_end") - F.col("t0")).alias("dur")), "merge-windows")
    base = f.groupBy("tol").agg(
        F.count("*").alias("fights"), (F.count_if(F.col("n_teams") > 2) / F.count("*")).alias("multi"),
        F.max("n_teams").alias("teams_max"), F.max("dur").alias("dur_max"), (F.count_if(F.col("dur") >= 60) / F.count("*")).alias("long_share"))
    teams = percentiles(f, ["tol"], "n_teams", {"teams_p50": 0.5, "teams_p90": 0.9}, few_groups=True).drop("n_values")
    dur = percentiles(f, ["tol"], "dur", {"dur_p50": 0.5, "dur_p90": 0.9}, few_groups=True).drop("n_values")
    return base.join(F.broadcast(teams), "tol").join(F.broadcast(dur), "tol")


def split_fights(segmented: DataFrame, hits: DataFrame, alt_gap: float = 5.0, tol_s: float = 1.0, split: bool = False) -> DataFrame:
    """Fights that break into two or more under `alt_gap` (same tolerance), with the number of parts."""
    alt = team_pair_segments(by_match(segmented, split).drop("seg_start"), alt_gap, split=split)
    spans = link_segments(by_match(segment_spans(alt), split), tol_s, split=split)
    sub = alt.join(by_match(spans.select("match_id", "team_a", "team_b", "seg_start", F.col("n").alias("sub")), split),
                   ["match_id", "team_a", "team_b", "seg_start"]).select("match_id", "hit", "sub")
    both = by_match(hits.select("match_id", "hit", "fight_id"), split).join(sub, ["match_id", "hit"])
    parts = both.select("match_id", "fight_id", "sub").distinct().groupBy("match_id", "fight_id").agg(F.count("*").alias("parts"))
    return parts.where(F.col("parts") >= 2)



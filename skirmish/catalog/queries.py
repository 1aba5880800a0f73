"""One query per operator, over the driver's tables or the telemetry derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from skirmish.catalog.telemetry import Telemetry
from skirmish.functions import columns as fc
from skirmish.operators.ordered import Ordered, asof, change_only, global_rank, interpolate, open_close_pairs
from skirmish.operators.quantiles import percentiles
from skirmish.plans import explore, fights as fp, identity, pieces as pc, pokes as pk, quality as ql, splits as sp, sweeps as sw
from skirmish.schema import coerce, parse_bool, validate, validation_summary
from skirmish.session import materialize, scratch_path
from skirmish.sources import ledger
from skirmish.sources.tables import read_table, write_tables
from skirmish.sources.telemetry import elims_table, finished_matches, load_table, pending, read_tolerant

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Telemetry], DataFrame]) -> Callable[[Telemetry], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Telemetry.of(spark, sf_dir))
    return fn


def r6(c: str | Column) -> Column:
    """A double rounded as DuckDB rounds it: the product with 1e6 to the nearest whole number, halves away from zero. `F.round(c, 6)` rounds
    the shortest decimal of the double, which is another number next to a half."""
    return F.round((F.col(c) if isinstance(c, str) else c) * F.lit(1e6)) / F.lit(1e6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def by_match(t: Telemetry, df: DataFrame) -> DataFrame:
    return fp.by_match(df, t.split)


# ------------------------------------------------------------------------------------------ scans, sources, sinks
CSV_EXPORT = "{dir}/*/file={name}.csv"


def export_csv(df: DataFrame, path: str, name: str) -> None:
    """Per-match CSV folders `match_id=<m>/file=<name>.csv/`, as load_table reads them."""
    # The work is one file per match, however few bytes: adaptive execution would merge small rows into one task.
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    df.withColumn("file", F.lit(f"{name}.csv")).repartition(tasks, "match_id").write.mode("append").partitionBy("match_id", "file").csv(path, header=True)


@query
def a1_load_table(t):
    path = scratch_path(t.spark, "export")
    export_csv(t.damage.select("match_id", "t", "source", "target", "magnitude", "x", "y"), path, "damage")
    export_csv(t.match_ids.select("match_id", F.lit("b").alias("branch")), path, "meta")
    return load_table(t.spark, path, "damage", CSV_EXPORT).select("match_id", "t", "source", "target", "magnitude", "x", "y")


@query
def a2_finished_matches(t):
    path = scratch_path(t.spark, "export")
    export_csv(t.match_ids.select("match_id", F.lit(0.0).alias("t")), path, "damage")
    export_csv(t.matches.where(F.col("rec_other_damage").isNotNull()).select("match_id", F.lit("b").alias("branch")), path, "meta")
    return finished_matches(t.spark, path, CSV_EXPORT)


@query
def a4_projection(t):
    return t.table("events").select("event_id", "user_id", "event_type")


@query
def a5_pushed_filter(t):
    return t.table("events").where(F.col("event_type") == "purchase").select("event_id", "user_id", "value")


@query
def a6_parquet_sink(t):
    path = scratch_path(t.spark, "processed")
    write_tables({"teams": t.teams.drop("row_id")}, path)
    return read_table(t.spark, path, "teams", ["match_id", "player_id", "t", "team_index"])


def document_manifest(t: Telemetry, docs: DataFrame) -> DataFrame:
    return docs.select(
        F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".replay")).alias("replay_file"), F.sha2("text", 256).alias("sha256"),
        F.col("n_chars").cast("long").alias("size_bytes"), F.lit("local_demos").alias("source"), F.lit("client").alias("replay_kind"),
        F.lit(None).cast("string").alias("contributor"), F.lit(None).cast("string").alias("consent_ref"),
        F.lit("2024-01-01T00:00:00+00:00").alias("acquired_at"), F.lit(None).cast("string").alias("notes"))


@query
def a7_manifest_csv(t):
    path = scratch_path(t.spark, "manifest")
    ledger.write_manifest(document_manifest(t, t.table("documents")), path)
    return ledger.load_manifest(t.spark, path).select("replay_file", "sha256", "size_bytes", "source", "notes")


@query
def a8_ledger(t):
    """Every document arrives. Some were imported before (listed), some are stored under their name with other
    content but not listed (backfilled, so the newcomer is renamed)."""
    docs = t.table("documents")
    listed = document_manifest(t, docs.where("doc_id % 7 = 0"))
    other = document_manifest(t, docs.where("doc_id % 7 = 1").withColumn("text", F.concat("text", F.lit("!"))))
    incoming = document_manifest(t, docs).select("replay_file", "sha256", "size_bytes")
    stored = listed.unionByName(other).select("replay_file", "sha256", "size_bytes")
    out = ledger.import_files(incoming, stored, listed, acquired_at="2024-01-02T00:00:00+00:00", notes="batch")
    return out.select("replay_file", "sha256", "size_bytes", "action", "original_file", "notes")


@query
def a9_pending(t):
    return pending(t.table("documents").select("doc_id", "lang"), t.table("labels"), "doc_id")


def _tolerant(t: Telemetry) -> tuple[DataFrame, DataFrame]:
    path = scratch_path(t.spark, "lines")
    line = F.concat_ws(",", F.col("row_id").cast("string"), F.when(F.col("row_id") % 9 == 0, "x").otherwise(F.col("t_ms").cast("string")), "eliminated")
    t.elims.select(line.alias("value")).write.text(path)
    return read_tolerant(t.spark, path, "row_id long, t_ms long, eliminated string")


@query
def a10_good_rows(t):
    return _tolerant(t)[0]


@query
def a10_rejected_lines(t):
    return _tolerant(t)[1]


# -------------------------------------------------------------------------------------------------------- schema
def raw_elims(t: Telemetry) -> DataFrame:
    """Elims as text with tokens that do not parse."""
    return t.elims.select(
        "row_id", "match_id",
        F.expr("case row_id % 5 when 0 then 'bad' when 1 then concat(cast(t_ms as string), '.5') else cast(t_ms as string) end").alias("t_ms"),
        "eliminator", "eliminated",
        F.expr("case row_id % 7 when 0 then 'TRUE ' when 1 then '0' when 2 then 'yes' when 3 then '' when 4 then ' False' else '1' end").alias("knocked"),
        F.lit("7").alias("gun_type"))


@query
def b2_coerce(t):
    return coerce(raw_elims(t), "elims").select("row_id", "match_id", "t_ms", "eliminator", "eliminated", "knocked", "gun_type")


@query
def b3_parse_bool(t):
    raw = raw_elims(t)
    return raw.select("row_id", parse_bool(F.col("knocked"), raw.schema["knocked"].dataType).alias("flag"))


@query
def b4_validate(t):
    broken = coerce(raw_elims(t), "elims").drop("gun_type").withColumn("bogus", F.lit(1))
    return validate(broken, "elims")


@query
def b4_duplicate_keys(t):
    return validate(t.sides.unionByName(t.sides.where("has_bots")), "fight_sides")


@query
def b5_validation_summary(t):
    tables = {"teams": t.teams.drop("row_id"), "fight_sides": t.sides, "elims": coerce(raw_elims(t), "elims"), "matches": t.matches}
    return validation_summary(tables, ["teams", "fight_sides", "elims", "matches", "pokes"])


@query
def b7_seg_version(t):
    return t.sides.select("seg_version").distinct()


@query
def b8_segmentation_mismatch(t):
    """Poke ids (gap 10) that do not exist under gap 100."""
    ids = t.sides.where(F.col("engagement_type") == "poke").select("match_id", "fight_id").distinct()
    other = fp.group_fights(t.damage, t.teams, gap_s=100.0, split=t.split).select("match_id", "fight_id")
    return ids.join(other, ["match_id", "fight_id"], "left_anti").select("fight_id")


# ---------------------------------------------------------------------------------------- projections and filters
@query
def c1_engagement_filter(t):
    return t.damage.where(fp.is_engagement()).select("row_id", "match_id", "source", "target", "magnitude")


@query
def c2_opposing_pairs(t):
    hits = by_match(t, t.damage.where(fp.is_engagement()).select("row_id", "match_id", "t", "source", "target"))
    out = fp.opposing_pairs(fp.with_teams(hits, by_match(t, t.teams), t.split))
    return out.select("row_id", "match_id", "source_team", "target_team", "team_a", "team_b")


@query
def c3_elims_table(t):
    raw = t.elims.select("match_id", (F.col("t_ms") / 1000.0 + 0.0005).alias("t"), "eliminator", "eliminated",
                         F.when(F.col("row_id") % 3 != 0, F.col("knocked")).alias("knocked"), F.lit(7).cast("long").alias("gun_type"))
    return elims_table(raw)


@query
def c4_known_players(t):
    return t.damage.where(F.col("target").isNotNull()).select("row_id", "match_id", "target")


@query
def c5_structure_hits(t):
    rows = t.damage.where(F.col("target").isNull() & F.col("source").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
                          & (F.col("magnitude") > 0))
    return rows.select("row_id", "match_id", "source", "magnitude", "x", "y")


@query
def c6_recorder_involved(t):
    rows = explore.elims_with_context(t.elims, t.teams, t.matches, t.split)
    return rows.where("recorder").select("match_id", "t", "eliminator", "eliminated", "knocked")


@query
def c7_downed_rows(t):
    return t.positions.where("downed").select("row_id", "match_id", "player_id")


# --------------------------------------------------------------------------------------------------------- joins
@query
def d1_team_at(t):
    hits = by_match(t, t.damage.select("row_id", "match_id", "t", "source", "target"))
    return fp.with_teams(hits, by_match(t, t.teams), t.split).select("row_id", "match_id", "source_team", "target_team")


@query
def d2_hit_distances(t):
    hits = t.damage.where(fp.is_engagement()).select("match_id", "t", "source", "target", F.col("row_id").alias("hit"))
    return rounded(fp.hit_distances(hits, t.positions, split=t.split), "dist")


@query
def d3_candidate_states(t):
    """State of every player at every piece of unknown team: number of candidates and of tool holders."""
    pieces = pc.parse_pieces(t.builds, t.split).where(F.col("team_index").isNull()).select("row_id", "match_id", F.col("spawn_t").alias("at"))
    states = pc.player_states(t.positions, t.teams, t.weapons, t.split)
    first = states.groupBy("match_id", "player_id").agg(F.min("since").alias("since"))
    n = first.groupBy("match_id").agg(F.count("*").alias("candidates"))
    # Holders change over time: +1 / -1 steps summed up to the piece.
    steps = states.where("tool").select("match_id", F.inline(F.array(
        F.struct(F.col("since").alias("at"), F.lit(1).alias("step")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("step")))))
    steps = steps.groupBy("match_id", "at").agg(F.sum("step").alias("step"))
    both = by_match(t, pieces.withColumn("_kind", F.lit(1))).unionByName(by_match(t, steps.withColumn("_kind", F.lit(0))), allowMissingColumns=True)
    scan = Ordered(both, ["match_id"], ["at", "_kind", "row_id"], t.split).running("holders", "sum", F.coalesce("step", F.lit(0)))
    return scan.rows().where("_kind = 1").join(n, "match_id").select("row_id", "match_id", "candidates", F.col("holders").cast("long").alias("holders"))


@query
def d4_last_known_flag(t):
    dead = t.players.where(F.col("death_time").isNotNull()).select("match_id", "player_id", "death_time")
    flags = t.positions.where(F.col("in_storm").isNotNull())
    return asof(by_match(t, dead), by_match(t, flags.select("match_id", "player_id", "t", "in_storm")), left_keys=["match_id", "player_id"],
                right_keys=["match_id", "player_id"], left_t="death_time", payload={"in_storm": "in_storm"}, split=t.split)


@query
def d5_since_damage(t):
    events = t.elims.select("row_id", "match_id", "eliminated", fp.seconds().alias("t"))
    return explore.since_damage(events, t.damage, t.split).select("row_id", "match_id", r6("since").alias("since"))


@query
def d6_downed_after(t):
    return rounded(ql.downed_offsets(t.elims, t.positions, split=t.split).select("match_id", "victim", "t", "offset"), "t", "offset")


def skeleton(t: Telemetry) -> DataFrame:
    return fp.skeleton_of(t.sides)


@query
def d7_events_in_fights(t):
    events = fp.outcome_events(t.elims, t.teams, split=t.split)
    return fp.events_in_fights(skeleton(t), events).select("fight_id", "t", "eliminator", "eliminated", "victim_team", "killer_team")


@query
def d8_knock_coverage(t):
    return fp.recorder_knock_coverage(t.elims, t.sides, t.teams, t.matches, split=t.split)


def pairs(t: Telemetry, only_pokes: bool = True) -> DataFrame:
    hits = t.hits
    if only_pokes:
        hits = hits.join(t.sides.where(F.col("engagement_type") == "poke").select("match_id", "fight_id").distinct(),
                         ["match_id", "fight_id"], "left_semi")
    return pk.poke_pairs(hits)


@query
def d9_target_events(t):
    targets = pk.target_members(pairs(t)).withColumnRenamed("player", "eliminated")
    events = t.elims.select("row_id", "match_id", "eliminated", fp.seconds().alias("t"))
    near = fp.point_in_interval(events, targets, keys=["match_id", "eliminated"], t="t", lo="t0", hi=F.col("t_end") + F.lit(20.0), width=fp.BUCKET_S)
    return near.select("fight_id", "row_id", "eliminated")


@query
def d10_structure_pressure(t):
    out = pk.label_structure_pressure(pairs(t, only_pokes=False), t.damage, t.teams, t.positions, split=t.split)
    return rounded(out.select("fight_id", "structure_damage", "structure_hits"), "structure_damage")


@query
def d11_hits_of_fights(t):
    return t.hits.select("fight_id", "match_id", "t", "source", "target", "magnitude")


@query
def d12_left_labels(t):
    conv = pk.label_conversion(pairs(t), t.elims, t.teams, split=t.split)
    return pairs(t).select("match_id", "fight_id").join(conv, ["match_id", "fight_id"], "left").select(
        "fight_id", F.col("converted_by").isNotNull().alias("converted"), "converted_by")


@query
def d13_owner_lookup(t):
    return by_match(t, t.damage.select("row_id", "match_id", "source")).join(
        by_match(t, t.matches.select("match_id", "replay_owner")), "match_id").select(
        "row_id", "match_id", (F.col("source") == F.col("replay_owner")).alias("by_recorder"))


@query
def d14_decided_fights(t):
    decided = t.sides.where(F.col("outcome") != "disengage").select("match_id", "fight_id").distinct()
    return t.hits.join(decided, ["match_id", "fight_id"], "left_semi").groupBy("fight_id").agg(F.count("*").alias("hits"))


@query
def d15_unlabelled_documents(t):
    return t.table("documents").select("doc_id").join(t.table("labels").select("doc_id"), "doc_id", "left_anti")


def spans(t: Telemetry) -> DataFrame:
    return fp.segment_spans(t.hits)


@query
def d16_segment_links(t):
    cols = ["match_id", "team_a", "team_b", "seg_start", "o_team_a", "o_team_b", "o_seg_start"]
    return rounded(explore.segment_links(spans(t), 10.0).select(*cols, "lag"), "lag")


@query
def d16_link_counts(t):
    return rounded(explore.link_counts(spans(t), 10.0, t.split), "lag")


@query
def d17_interpolated(t):
    events = t.elims.where(F.col("eliminated").isNotNull()).select("row_id", "match_id", "eliminated", fp.seconds().alias("t"))
    out = interpolate(by_match(t, events), by_match(t, t.positions.select("match_id", "player_id", "t", "x", "y")),
                      left_keys=["match_id", "eliminated"], right_keys=["match_id", "player_id"], left_t="t", columns=["x", "y"], split=t.split)
    return rounded(out.select("row_id", "match_id", "x", "y"), "x", "y")


@query
def d18_tracks(t):
    return explore.side_tracks(t.sides, t.positions)


# -------------------------------------------------------------------------------------------------- aggregations
@query
def e1_sides(t):
    out = fp.sum_sides(fp.side_members(t.hits))
    return out.select("match_id", "n", "team", "events", "hits_dealt", "hits_taken", r6("dealt").alias("dealt"), r6("taken").alias("taken"), "players")


@query
def e2_primary_opponent(t):
    return fp.sum_sides(fp.side_members(t.hits), exact=False).select("match_id", "n", "team", "opp")


@query
def e3_fight_span(t):
    sides = fp.sum_sides(fp.side_members(t.hits))
    return sides.groupBy("match_id", "n").agg(F.min("t0").alias("t0"), F.max("t_end").alias("t_end"), F.count("*").alias("n_teams"))


@query
def e4_minority_share(t):
    sides = fp.fight_level(fp.sum_sides(fp.side_members(t.hits)))
    return sides.select("match_id", "n", "team", "mutual", r6("minority_damage_share").alias("minority_damage_share"))


@query
def e5_fight_distances(t):
    return rounded(fp.fight_distances(t.hits, t.positions, t.split), "dist_median_m", "dist_max_m")


@query
def e6_solo_matches(t):
    return fp.match_team_sizes(t.teams)


@query
def e7_first_knocks(t):
    return fp.first_knocks(t.elims)


@query
def e8_fight_flags(t):
    members = fp.flag_members(fp.side_members(t.hits), t.players, t.matches, t.split)
    return members.groupBy("match_id", "n").agg(F.bool_or("is_owner").alias("recorder_involved"), F.bool_or("is_bot").alias("has_bots"))


@query
def e9_decisive(t):
    over = W.partitionBy("match_id", "fight_id")
    return t.sides.select("fight_id", "match_id", "team_index", F.bool_or(F.col("outcome") != "disengage").over(over).alias("decisive"))


@query
def e10_poke_pairs(t):
    return rounded(pairs(t, only_pokes=False).drop("match_id"), "net_damage")


@query
def e11_damage_vs_stats(t):
    return rounded(ql.damage_vs_stats(t.damage, t.matches), "value")


@query
def e12_non_null_share(t):
    return rounded(t.damage.agg(F.avg(F.col("target").isNotNull().cast("double")).alias("share")), "share")


@query
def e13_median_offset(t):
    return rounded(percentiles(ql.downed_offsets(t.elims, t.positions, split=t.split), [], "offset", {"median": 0.5}), "median")


@query
def e14_gap_quantiles(t):
    return rounded(explore.gap_quantiles(by_match(t, t.hits), t.split), *explore.GAP_QUANTILES)


@query
def e15_outcome_shares(t):
    counts = t.sides.groupBy("outcome").agg(F.count("*").alias("n"))
    # Four rows: the total is a window over the distinct outcomes.
    return counts.select("outcome", "n", r6(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))).alias("share"))


@query
def e16_bot_teams(t):
    return explore.bot_teams(t.teams, t.players).select("match_id", "team_index", "any_bot", "all_bot")


@query
def e17_match_owner(t):
    """Owners over all rows: bots are flagged as owners of their matches, so the flag decides where a match has one."""
    players = t.players.select("match_id", "player_id", F.col("is_bot").alias("is_replay_owner"))
    return identity.match_owners(t.match_ids, players, t.weapons.select("match_id", "player_id", "t"), t.positions.select("match_id", "player_id", "t"))


@query
def e17_most_frequent_owner(t):
    """The same without any flag: whoever has most health rows."""
    nobody = t.players.select("match_id", "player_id", F.lit(False).alias("is_replay_owner"))
    return identity.match_owners(t.match_ids, nobody, t.weapons.select("match_id", "player_id", "t"), t.positions.select("match_id", "player_id", "t"))


@query
def e18_class_counts(t):
    return identity.class_counts(t.builds)


@query
def e19_fold_pieces(t):
    updates = t.ev.select(
        "match_id", (F.col("k") % 10).cast("long").alias("piece"), "t", F.col("event_id").alias("seq"), F.lit(None).cast("long").alias("owner_persistent_id"),
        F.when(F.col("event_id") % 3 != 0, (F.col("k") % 4).cast("long")).alias("team_index"),
        F.when(F.col("event_id") % 5 == 0, F.lit(100).cast("long") + F.col("event_id") % 50).alias("max_health"),
        F.when(F.col("event_id") % 4 == 0, F.col("k") % 2 == 0).alias("player_placed"), F.floor("value").cast("long").alias("health"))
    return identity.fold_pieces(updates)


@query
def e20_split_fights(t):
    return sw.split_fights(t.hits.drop("fight_id", "n", "t0", "t_end"), t.hits, alt_gap=5.0, split=t.split).select("fight_id", "parts")


# ------------------------------------------------------------------------------------------------------- windows
@query
def f1_gap_segments(t):
    eng = fp.engagement_damage(t.damage, t.teams, t.split)
    return fp.segment_spans(fp.team_pair_segments(eng, split=t.split))


@query
def f2_parse_pieces(t):
    return pc.parse_pieces(t.builds, t.split).select("row_id", "match_id", "spawn_t", "close_t", "material", "shape", "kind", "edited", "team_index")


@query
def f3_detect_edits(t):
    out = pc.detect_edits(pc.parse_pieces(t.builds, t.split), t.split)
    return out.select("row_id", "match_id", "prev_shape", "prev_close_t", "is_edit", "is_reset")


@query
def f4_fight_numbers(t):
    return t.hits.select("match_id", "n", "t0").distinct()


@query
def f5_first_conversion(t):
    out = pk.label_conversion(pairs(t), t.elims, t.teams, split=t.split)
    return out.select("fight_id", r6("t_convert").alias("t_convert"))


@query
def f6_best_candidates(t):
    out = pc.build_pieces(t.builds, t.positions, t.teams, t.weapons, split=t.split)
    return out.select("row_id", "builder")


@query
def f7_hit_gaps(t):
    return rounded(explore.hit_gaps(by_match(t, t.hits), t.split).select("match_id", "team_a", "team_b", "t", "gap"), "gap")


@query
def f8_held_items(t):
    rows = by_match(t, t.weapons)
    return change_only(rows, ["match_id", "player_id"], ["t", "row_id"], "weapon_class", t.split)


@query
def f9_start_rank(t):
    return global_rank(sp.match_start(t.split_matches), [F.col("start").asc_nulls_last(), F.col("match_id")], "rank").select("match_id", "rank")


@query
def f10_history_count(t):
    return sp.rolling_origins(dated_events(t), min_train_events=0).select(F.col("origin").alias("date"), "n_train")


# --------------------------------------------------------------------------------------------------------- graph
@query
def g1_components(t):
    out = fp.link_segments(by_match(t, spans(t)), split=t.split)
    return out.select("match_id", "team_a", "team_b", "seg_start", "seg_end", "n", "t0", "t_end")


@query
def g2_group_fights(t):
    return fp.group_fights(t.damage, t.teams, split=t.split).select("match_id", "t", "source", "target", "magnitude", "fight_id")


# ---------------------------------------------------------------------------------------------------------- rules
@query
def h1_engagement(t):
    return fp.engagement_damage(t.damage, t.teams, t.split).select(
        "match_id", "t", "source", "target", "magnitude", "source_team", "target_team", "team_a", "team_b")


@query
def h2_outcome_events(t):
    return fp.outcome_events(t.elims, t.teams, split=t.split)


@query
def h2_outcome_events_direct(t):
    return fp.outcome_events(t.elims, t.teams, direct_elim_all_modes=True, split=t.split)


@query
def h3_outcomes(t):
    events = fp.outcome_events(t.elims, t.teams, direct_elim_all_modes=True, split=t.split)
    return fp.label_outcomes(skeleton(t).drop("outcome"), events).select("fight_id", "team", "outcome")


@query
def h4_engagement_types(t):
    return t.sides.select("fight_id", "engagement_type").distinct()


SIDE_FLOATS = ("damage_dealt", "damage_taken", "minority_damage_share", "dist_median_m", "dist_max_m")


@query
def h5_fight_sides(t):
    return rounded(t.build_sides(), *SIDE_FLOATS)


@query
def h6_conversion(t):
    return rounded(pk.label_conversion(pairs(t), t.elims, t.teams, split=t.split).drop("match_id"), "t_convert")


@query
def h7_storm_death(t):
    return pk.label_storm_death(pairs(t), t.players, t.positions, split=t.split).select("fight_id")


@query
def h8_structure_labels(t):
    out = pk.label_structure_pressure(pairs(t), t.damage, t.teams, t.positions, split=t.split)
    return rounded(out.select("fight_id", "structure_damage", "structure_hits"), "structure_damage")


@query
def h9_pokes(t):
    out = pk.build_pokes(t.damage, t.teams, t.elims, t.players, t.positions, t.sides, split=t.split)
    return rounded(out, "net_damage", "t_convert", "structure_damage")


@query
def h10_classify(t):
    return pc.classify(t.builds).select("row_id", "material", "shape", "kind", "edited")


@query
def h11_builders(t):
    pieces = pc.detect_edits(pc.parse_pieces(t.builds, t.split), t.split)
    out = pc.attribute_builders(pieces, t.positions, t.teams, t.weapons, split=t.split)
    return rounded(out.select("row_id", "builder", "builder_dist", "builder_source"), "builder_dist")


@query
def h12_pieces(t):
    out = pc.build_pieces(t.builds, t.positions, t.teams, t.weapons, split=t.split)
    return rounded(out.select("row_id", "match_id", "spawn_t", "path", "x", "y", "z", "yaw", "close_t", "team_index", "material", "shape", "kind",
                              "edited", "prev_shape", "prev_close_t", "is_edit", "is_reset", "builder", "builder_dist", "builder_source"), "builder_dist")


# ------------------------------------------------------------------------------------------------------- scalars
@query
def i1_regex_extract(t):
    return t.builds.select("row_id", fc.extract("path", fc.PIECE_CLASS, 1).alias("letter"), fc.piece_shape("path").alias("shape"))


@query
def i2_name_time(t):
    return t.split_matches.select("match_id", F.unix_micros(fc.name_time("match_id")).alias("start_us"))


@query
def i3_lookup(t):
    return t.builds.select("row_id", fc.piece_material("path").alias("material"))


@query
def i4_string_tests(t):
    shape = fc.piece_shape("path")
    return t.builds.select("row_id", F.lower(shape).startswith("stair").alias("stair"), shape.contains("Large").alias("large"),
                           F.upper(shape).alias("upper_shape"))


@query
def i5_member_lists(t):
    rows = t.sides.select("match_id", "fight_id", F.explode(F.split("players", ";")).alias("player_id"))
    return rows.groupBy("fight_id").agg(fc.joined(F.collect_set("player_id")).alias("members"))


@query
def i6_id_suffix(t):
    return t.sides.select("fight_id", "team_index", fc.id_suffix("fight_id").alias("n"))


@query
def i7_distance(t):
    return t.positions.select("row_id", r6(fc.distance(F.col("x"), F.col("y"), F.col("z")) / 100).alias("metres"),
                              r6(fc.distance(F.col("x"), F.col("y"))).alias("flat"))


@query
def i8_unit_hash(t):
    return t.roster.select("match_id", "player_id", fc.unit_hash(sp.HOLDOUT_SALT, F.concat_ws("-", "match_id", "player_id")).alias("u"))


@query
def i9_iso_time(t):
    text = F.when(F.day(F.to_date(F.substring("utc_start", 1, 10))) % 3 == 0, F.concat("utc_start", F.lit("?"))).otherwise(F.col("utc_start"))
    return t.split_matches.select("match_id", F.unix_micros(fc.iso_time(text)).alias("start_us"))


@query
def i10_half_even(t):
    return t.ev.select("event_id", fc.half_even((F.col("k") * 5).cast("double") / 10).alias("half_even"))


@query
def i11_content_hash(t):
    return t.table("documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


# ----------------------------------------------------------------------------------------------- sorts, set operations
@query
def j1_sorted_hits(t):
    return t.hits.select("match_id", "t", "source", "target").orderBy("match_id", "t", "source", "target")


@query
def j2_sampled_fights(t):
    return explore.sample_ids(t.sides.where("recorder_involved"), "fight_id", 12, seed=0)


@query
def j3_union_all(t):
    knocks = t.elims.where("knocked").select("match_id", F.col("eliminated").alias("player_id"), fp.seconds().alias("t"))
    deaths = t.players.where(F.col("death_time").isNotNull()).select("match_id", "player_id", F.col("death_time").alias("death_t"))
    return knocks.unionByName(deaths, allowMissingColumns=True)


@query
def j4_except(t):
    """Shapes seen in a match, but not on any of its pieces without a team."""
    seen = t.builds.select("match_id", fc.piece_shape("path").alias("shape"), "team_index")
    return seen.select("match_id", "shape").distinct().join(seen.where(F.col("team_index").isNull()).select("match_id", "shape").distinct(), ["match_id", "shape"], "left_anti")


@query
def j5_first_per_key(t):
    return t.sides.select("match_id", "fight_id", "t0", "t_end", "multi_team").dropDuplicates(["match_id", "fight_id"])


# -------------------------------------------------------------------------------------------------------- splits
@query
def k1_held_out(t):
    ids = t.roster.select(F.when(F.col("p") == 0, F.concat_ws("_", F.lit("BOT"), "match_id")).otherwise(F.concat_ws("-", "match_id", "player_id")).alias("player_id"))
    return ids.select("player_id", sp.is_held_out_player("player_id").alias("held_out"))


@query
def k2_match_start(t):
    return sp.match_start(t.split_matches).select("match_id", F.unix_micros("start").alias("start_us"))


@query
def k3_chronological_split(t):
    return sp.chronological_split(t.split_matches).select("match_id", "split")


@query
def k4_folds(t):
    return t.split_matches.select("match_id", sp.cross_fit_fold("match_id").alias("fold"))


def dated_events(t: Telemetry) -> DataFrame:
    return t.table("events").select("event_id", F.to_date("ts").alias("date"))


@query
def k5_rolling_origins(t):
    return sp.rolling_origins(dated_events(t))


@query
def k5_rolling_membership(t):
    return sp.rolling_membership(dated_events(t))


# ------------------------------------------------------------------------------------------------------- quality
@query
def l1_damage_gate(t):
    return rounded(ql.with_verdict(ql.damage_vs_stats(t.damage, t.matches)), "value")


@query
def l2_position_gate(t):
    return rounded(ql.position_resolution(t.positions), "value")


@query
def l3_clock_gate(t):
    return rounded(ql.clock_offset(t.elims, t.positions, t.split), "value")


@query
def l4_coverage_gate(t):
    return rounded(ql.knock_coverage_rate(t.elims, t.sides, t.teams, t.matches, t.split), "value")


@query
def l5_unknown_shapes(t):
    return ql.unknown_build_shapes(identity.class_counts(t.builds))


def replay_manifest(t: Telemetry) -> DataFrame:
    """Replays of all matches and of as many days as there are orders; only the matches were exported."""
    return t.match_ids.unionByName(t.split_matches.select("match_id")).select(F.concat("match_id", F.lit(".replay")).alias("replay_file"))


@query
def l6_unexported(t):
    return ql.unexported_replays(replay_manifest(t), t.matches)


@query
def l7_quality_report(t):
    out = ql.quality_report(damage=t.damage, matches=t.matches, positions=t.positions, elims=t.elims, teams=t.teams, fight_sides=t.sides,
                            actor_classes=identity.class_counts(t.builds), manifest=replay_manifest(t), split=t.split)
    return rounded(out, "value")


# -------------------------------------------------------------------------------------------- sweeps and reports
@query
def m1_segmentation_sweep(t):
    out = sw.segmentation_sweep(t.damage, t.teams, t.elims, t.matches, split=t.split)
    return rounded(out, "multi", "win", "loss", "tie", "disengage", "dur_p50", "dur_p90", "dur_max", "in_fight", "coverage")


@query
def m2_type_sweep(t):
    return rounded(sw.type_sweep(t.sides), "fight_pct", "pick_pct", "poke_pct", "decided_pick_pct", "two_team_poke_pct")


@query
def m2_type_summary(t):
    return rounded(sw.type_summary(t.sides), "two_team_pct", "hits_per_side_median", "dist_median_m")


@query
def m3_convert_sweep(t):
    poke_pairs = materialize(pairs(t), "pokes")
    out = sw.convert_sweep(poke_pairs, t.damage, t.teams, t.elims, t.players, t.positions, split=t.split)
    return rounded(out, "converted_pct", "poker_pct", "third_party_pct", "environment_pct")


@query
def m4_damage_facts(t):
    return rounded(explore.damage_facts(t.damage, t.teams, t.split), "value")


@query
def m4_segments_by_gap(t):
    return explore.segments_by_gap(by_match(t, t.hits.drop("seg_start")), split=t.split)


def context(t: Telemetry) -> DataFrame:
    return explore.elims_with_context(t.elims, t.teams, t.matches, t.split)


@query
def m5_since_damage_report(t):
    return rounded(explore.since_damage_report(context(t), t.damage, t.split), "no_damage", "p50", "p90")


@query
def m6_third_party_links(t):
    return rounded(explore.third_party_links(spans(t)), "share")


@query
def m7_merge_windows(t):
    return rounded(sw.merge_window_report(t.hits, split=t.split), "multi", "dur_max", "long_share", "teams_p50", "teams_p90", "dur_p50", "dur_p90")


@query
def m8_knocks_in_segments(t):
    return explore.knock_segment_report(context(t), spans(t))


@query
def m9_direct_elims(t):
    return explore.direct_elim_report(context(t), t.elims, spans(t))


@query
def m9_bot_shares(t):
    return rounded(explore.bot_report(t.teams, t.players, spans(t)), "value")


# ------------------------------------------------------------------------------------------------ channel identity
@query
def n1_resolve_players(t):
    ev = t.ev.withColumns({"channel": (F.col("k") % 8).cast("long"), "guid": (F.col("k") % 6).cast("long")})
    reset = F.col("event_type") == "signup"
    opens = ev.where(reset).select("match_id", "t", "guid", "channel")
    links = ev.where(reset | (F.col("event_type") == "view")).select("match_id", "t", "channel", F.when(~reset, F.col("guid")).alias("state_guid"))
    states = ev.where(reset | (F.col("event_type") == "purchase")).select("match_id", "t", "channel", F.when(~reset, F.col("player")).alias("player_id"))
    reads = ev.where(F.col("event_type") == "click").select(F.col("event_id").alias("row_id"), "match_id", "t", "channel")
    out = identity.resolve_players(by_match(t, reads), by_match(t, links), by_match(t, states), by_match(t, opens), t.split)
    return out.select("row_id", "match_id", "channel", "player_id")


@query
def n2_open_close(t):
    ev = t.ev.where(F.col("event_type").isin("signup", "error")).select(
        F.col("event_id").alias("row_id"), "match_id", (F.col("k") % 8).cast("long").alias("channel"), "t",
        F.when(F.col("event_type") == "signup", "open").otherwise("close").alias("event"),
        F.when(F.col("k") % 2 == 0, "Destroyed").otherwise("Dormancy").alias("reason"))
    out = open_close_pairs(by_match(t, ev), ["match_id", "channel"], ["t", "row_id"], "t", "event", "reason", split=t.split)
    return out.select("row_id", "match_id", "channel", F.col("t").alias("spawn_t"), "close_t", "close_reason")

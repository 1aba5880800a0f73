"""Quality gates over the processed tables, reported as rows (gate, value, n, ok)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from skirmish.functions.columns import KNOWN_SHAPES, known_number, piece_shape
from skirmish.operators.ordered import asof, needs_split
from skirmish.operators.quantiles import percentiles
from skirmish.plans.fights import by_match, recorder_knock_coverage, seconds

# Gate thresholds.
GATES = {
    "damage_corr": 0.90,
    "damage_ratio_lo": 0.90,
    "damage_ratio_hi": 1.10,
    "position_resolution": 0.99,
    "clock_offset_s": 0.05,
    "recorder_knock_coverage": 0.90,
}
MIN_MATCHES = 5
CLOCK_WINDOW_S = 5.0


def recorder_damage(damage: DataFrame, matches: DataFrame) -> DataFrame:
    """Per match with a positive reported total: damage the recorder dealt to others (`parsed`) and reported (`game`)."""
    hits = damage.where(F.col("target").isNotNull() & (F.col("source") != F.col("target"))).select("match_id", "source", "magnitude")
    # Summed per source before meeting the owners, so a large match arrives at the join as a few rows.
    dealt = hits.groupBy("match_id", "source").agg(F.sum("magnitude").alias("parsed"))
    w, o = F.col("rec_weapon_damage"), F.col("rec_other_damage")
    game = F.when(F.coalesce(w, o).isNotNull(), F.coalesce(w, F.lit(0)) + F.coalesce(o, F.lit(0))).cast("double")
    stats = matches.select("match_id", F.col("replay_owner").alias("source"), game.alias("game")).where(F.col("game") > 0)
    return stats.join(dealt, ["match_id", "source"], "left").select(
        "match_id", "game", F.coalesce(known_number("parsed"), F.lit(0.0)).alias("parsed"))


def damage_vs_stats(damage: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows damage_corr (Pearson r) and damage_ratio (median parsed / game) with n; null below five matches."""
    both = recorder_damage(damage, matches)
    enough = F.col("n") >= MIN_MATCHES
    r = both.agg(F.corr("parsed", "game").alias("value"), F.count("*").alias("n")).select(
        F.lit("damage_corr").alias("gate"), F.when(enough, known_number("value")).alias("value"), "n")
    ratio = percentiles(both.withColumn("ratio", F.col("parsed") / F.col("game")), [], "ratio", {"value": 0.5})
    ratio = ratio.withColumnRenamed("n_values", "n").select(
        F.lit("damage_ratio").alias("gate"), F.when(enough, F.col("value")).alias("value"), "n")
    return r.unionByName(_always(ratio, "damage_ratio"))


def _always(row: DataFrame, gate: str) -> DataFrame:
    """The metric's row, or a row with no value and n = 0 if there was nothing to measure."""
    return row.agg(F.max("value").alias("value"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n")).select(
        F.lit(gate).alias("gate"), "value", "n")


def position_resolution(positions: DataFrame) -> DataFrame:
    return positions.agg(F.avg(F.col("player_id").isNotNull().cast("double")).alias("value"), F.count("*").alias("n")).select(
        F.lit("position_resolution").alias("gate"), "value", "n")


def downed_offsets(elims: DataFrame, positions: DataFrame, window_s: float = CLOCK_WINDOW_S, split: bool | None = None) -> DataFrame:
    """Per knock, the first downed update from `window_s` before it on, if within `window_s` after: `offset` seconds."""
    split = needs_split([elims, positions]) if split is None else split
    knocks = elims.where("knocked").select("match_id", F.upper("eliminated").alias("victim"), seconds().alias("t"))
    downs = positions.where(F.col("downed") & F.col("player_id").isNotNull()).select("match_id", "player_id", "t")
    placed = asof(by_match(knocks, split), by_match(downs, split), left_keys=["match_id", "victim"],
                  right_keys=["match_id", "player_id"], left_t=F.col("t") - F.lit(float(window_s)), payload={"down_t": "t"},
                  forward=True, split=split)
    return placed.withColumn("offset", F.col("down_t") - F.col("t")).where(F.col("offset") < F.lit(float(window_s)))


def clock_offset(elims: DataFrame, positions: DataFrame, split: bool | None = None) -> DataFrame:
    mid = percentiles(downed_offsets(elims, positions, split=split), [], "offset", {"value": 0.5}).withColumnRenamed("n_values", "n")
    return _always(mid, "clock_offset_s")


def knock_coverage_rate(elims: DataFrame, fight_sides: DataFrame, teams: DataFrame, matches: DataFrame,
                        split: bool | None = None) -> DataFrame:
    rows = recorder_knock_coverage(elims, fight_sides, teams, matches, split=split)
    return rows.agg(F.avg(F.col("covered").cast("double")).alias("value"), F.count("*").alias("n")).select(
        F.lit("recorder_knock_coverage").alias("gate"), "value", "n")


def unknown_build_shapes(actor_classes: DataFrame, known: tuple[str, ...] = KNOWN_SHAPES) -> DataFrame:
    """Shapes of build pieces that are not in the known list."""
    shape = piece_shape("path").alias("shape")
    return actor_classes.select(shape).where(F.col("shape").isNotNull() & ~F.col("shape").isin(*known)).distinct()


def unexported_replays(manifest: DataFrame, matches: DataFrame) -> DataFrame:
    """Manifest files whose stem has no exported match."""
    stem = F.regexp_replace("replay_file", r"\.replay$", "")
    return manifest.select("replay_file", stem.alias("match_id")).join(
        matches.select("match_id"), "match_id", "left_anti").select("replay_file")


def _counted(rows: DataFrame, gate: str) -> DataFrame:
    return rows.agg(F.count("*").cast("double").alias("value"), F.count("*").alias("n")).select(
        F.lit(gate).alias("gate"), "value", "n")


def quality_report(*, damage: DataFrame, matches: DataFrame, positions: DataFrame, elims: DataFrame, teams: DataFrame,
                   fight_sides: DataFrame, actor_classes: DataFrame, manifest: DataFrame,
                   known_shapes: tuple[str, ...] = KNOWN_SHAPES, split: bool | None = None) -> DataFrame:
    """All gates. A metric that cannot be measured (null) fails; missing exports are reported and always pass."""
    metrics = [
        damage_vs_stats(damage, matches), position_resolution(positions), clock_offset(elims, positions, split),
        knock_coverage_rate(elims, fight_sides, teams, matches, split),
        _counted(unknown_build_shapes(actor_classes, known_shapes), "unknown_build_shapes"),
        _counted(unexported_replays(manifest, matches), "unexported_replays"),
    ]
    return with_verdict(reduce(lambda a, b: a.unionByName(b), metrics))


def with_verdict(rows: DataFrame) -> DataFrame:
    """Metric rows (gate, value, n) with `ok`, by the gate's own rule; a value that could not be measured fails."""
    v = F.col("value")
    rules = {
        "damage_corr": v >= GATES["damage_corr"],
        "damage_ratio": v.between(GATES["damage_ratio_lo"], GATES["damage_ratio_hi"]),
        "position_resolution": v >= GATES["position_resolution"],
        "clock_offset_s": F.abs(v) <= GATES["clock_offset_s"],
        "recorder_knock_coverage": v >= GATES["recorder_knock_coverage"],
        "unknown_build_shapes": v == 0,
        "unexported_replays": F.lit(True),
    }
    ok = reduce(lambda acc, kv: F.when(F.col("gate") == kv[0], kv[1]).otherwise(acc), rules.items(), F.lit(False))
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False)))


def all_gates_pass(report: DataFrame) -> bool:
    return report.where(~F.col("ok")).isEmpty()

"""Declared tables, coercion to them, validation against them.

Four column types: text, real, whole, flag. A null flag means "not sent with this update", not false. Each field's
metadata holds a comment, a unit where it has one, and a mark if it is known only during or after what it describes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


@dataclass(frozen=True)
class TableSpec:
    name: str
    layer: str  # raw | interim | processed
    grain: str
    key: tuple[str, ...]
    notes: str
    schema: T.StructType
    planned: bool = False

    @property
    def names(self) -> list[str]:
        return self.schema.names

    @property
    def path(self) -> str:
        """Where a stored table lies below the data folder."""
        return f"{self.layer}/{self.name}.parquet"

    @property
    def status(self) -> str:
        return "planned" if self.planned else "built"


def _field(kind: T.DataType, name: str, comment: str, unit: str = "", null: bool = False, label: bool = False) -> T.StructField:
    metadata = {"comment": comment} | ({"unit": unit} if unit else {}) | ({"label_only": True} if label else {})
    return T.StructField(name, kind, null, metadata)


_text = partial(_field, T.StringType())
_real = partial(_field, T.DoubleType())
_whole = partial(_field, T.LongType())
_flag = partial(_field, T.BooleanType())

MATCH = _text("match_id", "match the row belongs to")
TIME = _real("t", "time since the match clock began", "s")
PLACE = [_real("x", "east-west place", "uu"), _real("y", "north-south place", "uu"), _real("z", "height", "uu")]
BUILD = [
    _real("spawn_t", "when the piece appeared", "s"), _whole("channel", "network channel of the piece"), _text("path", "class path"), *PLACE,
    _real("yaw", "facing", "deg"), _real("close_t", "when its channel closed", "s", null=True), _text("close_reason", "why it closed", null=True),
    _whole("owner_persistent_id", "id of the owner", null=True), _whole("team_index", "team of the owner", null=True),
    _whole("max_health", "health when whole", null=True), _whole("min_health", "lowest health seen", null=True),
    _flag("player_placed", "placed by a player", null=True), _text("editors", "players seen editing it", null=True),
]

# The tables, their keys, columns and types.
_DECLARED = [
    TableSpec("manifest", "raw", "replay file", ("replay_file",), "what was taken in, from whom, and under which hash", T.StructType([
        _text("replay_file", "stored name"), _text("sha256", "hash of the content"), _whole("size_bytes", "size", "B"),
        _text("source", "where it came from"), _text("replay_kind", "client or server recording"),
        _text("contributor", "who gave it", null=True), _text("consent_ref", "record of the consent", null=True),
        _text("acquired_at", "when it was taken in"), _text("notes", "remarks", null=True)])),
    TableSpec("matches", "processed", "replay", ("match_id",), "one row per recorded match, with the recorder's own totals", T.StructType([
        MATCH, _text("branch", "game build"), _text("session_id", "server session", null=True), _text("playlist", "mode", null=True),
        _text("utc_start", "start in UTC", null=True), _real("match_end_time", "end of the match", "s", null=True),
        _whole("max_players", "seats", null=True), _whole("team_size", "seats per team", null=True), _whole("total_teams", "teams", null=True),
        _whole("total_bots", "bots", null=True), _whole("tournament_round", "round", null=True), _whole("winning_team", "team that won", null=True),
        _real("aircraft_start", "start of the flight", "s", null=True), _text("replay_owner", "player who recorded", null=True),
        _whole("rec_eliminations", "recorder's eliminations", null=True), _whole("rec_assists", "recorder's assists", null=True),
        _real("rec_accuracy", "recorder's accuracy", null=True), _whole("rec_weapon_damage", "recorder's weapon damage", null=True),
        _whole("rec_other_damage", "recorder's other damage", null=True), _whole("rec_damage_taken", "damage the recorder took", null=True),
        _whole("rec_damage_to_structures", "recorder's damage to pieces", null=True),
        _whole("rec_materials_gathered", "recorder's materials gathered", null=True),
        _whole("rec_materials_used", "recorder's materials used", null=True), _whole("rec_total_traveled", "recorder's way", null=True),
        _whole("rec_revives", "recorder's revives", null=True)])),
    TableSpec("players", "processed", "match x player", ("match_id", "player_id"), "who took part and how it ended for them", T.StructType([
        MATCH, _text("player_id", "player"), _text("name", "shown name", null=True), _flag("is_bot", "a bot"),
        _whole("team_index", "team", null=True), _whole("placement", "final place", null=True), _whole("kills", "eliminations", null=True),
        _whole("team_kills", "eliminations of the team", null=True), _flag("is_replay_owner", "recorded the match"),
        _whole("state_player_id", "id in the state channel", null=True), _whole("world_player_id", "id in the world", null=True),
        _text("platform", "device", null=True), _real("death_time", "death", "s", null=True), _whole("death_cause", "cause", null=True),
        _real("death_x", "place of death", "uu", null=True), _real("death_y", "place of death", "uu", null=True),
        _real("death_z", "place of death", "uu", null=True)])),
    TableSpec("positions", "processed", "pawn update", (), "movement updates; a null flag was not sent with the update", T.StructType([
        MATCH, TIME, _whole("channel", "network channel of the pawn"), _text("player_id", "player", null=True), *PLACE,
        _real("yaw", "facing", "deg", null=True), _real("pitch", "view angle", "deg", null=True), _real("vx", "speed", "uu/s", null=True),
        _real("vy", "speed", "uu/s", null=True), _real("vz", "speed", "uu/s", null=True), _flag("downed", "knocked down", null=True),
        _flag("in_storm", "in the storm", null=True), _flag("targeting", "aiming", null=True), _flag("crouched", "crouching", null=True),
        _flag("sprinting", "sprinting", null=True), _flag("jumping", "jumping", null=True), _flag("skydiving", "in the air", null=True)])),
    TableSpec("damage", "processed", "damage cue", (), "hits as shown to the recorder; structures have no target", T.StructType([
        MATCH, TIME, _whole("source_channel", "channel of the shooter"), _text("source", "shooter", null=True),
        _whole("hit_actor", "what was hit", null=True), _text("target", "player hit", null=True), _real("magnitude", "damage"),
        _flag("fatal", "deadly", null=True), _flag("critical", "critical", null=True), _flag("shield", "on the shield", null=True),
        _flag("shield_destroyed", "broke the shield", null=True), _flag("ballistic", "by a bullet", null=True),
        _flag("weapon_activate", "weapon went off", null=True), _real("x", "place of the hit", "uu", null=True),
        _real("y", "place of the hit", "uu", null=True), _real("z", "place of the hit", "uu", null=True)])),
    TableSpec("health", "processed", "health change", (), "health and shield after each change", T.StructType([
        MATCH, TIME, _whole("channel", "network channel"), _text("player_id", "player", null=True), _real("health", "health"), _real("shield", "shield")])),
    TableSpec("eliminations", "interim", "knock or elimination", (), "kill feed as exported, before the match is added", T.StructType([
        TIME, _text("eliminated", "victim", null=True), _text("eliminator", "who did it", null=True), _flag("knocked", "down, not out"),
        _whole("gun_type", "weapon type", null=True), _real("distance", "distance", "uu", null=True), _real("victim_x", "place of the victim", null=True),
        _real("victim_y", "place of the victim", null=True), _real("victim_z", "place of the victim", null=True),
        _real("actor_x", "place of the eliminator", null=True), _real("actor_y", "place of the eliminator", null=True),
        _real("actor_z", "place of the eliminator", null=True)])),
    TableSpec("elims", "processed", "knock or elimination", (), "kill feed in whole milliseconds", T.StructType([
        MATCH, _whole("t_ms", "time since the match clock began", "ms"), _text("eliminator", "who did it", null=True),
        _text("eliminated", "victim", null=True), _flag("knocked", "down, not out"), _text("gun_type", "weapon type", null=True)])),
    TableSpec("builds", "interim", "piece actor spawn", (), "actors of building pieces as exported", T.StructType(BUILD)),
    TableSpec("pieces", "processed", "build piece", (), "building pieces with edits and the likely builder", T.StructType([
        MATCH, *BUILD, _text("material", "wood, brick or metal", null=True), _text("shape", "shape in the path", null=True),
        _text("kind", "wall, floor, stair or roof", null=True), _flag("edited", "shape is an edited one"),
        _text("prev_shape", "shape before", null=True), _real("prev_close_t", "when that closed", "s", null=True),
        _flag("is_edit", "follows a piece it edits"), _flag("is_reset", "edit back to the plain shape"), _text("builder", "likely builder", null=True),
        _real("builder_dist", "distance of the builder", "uu"), _text("builder_source", "how the builder was found", null=True)])),
    TableSpec("teams", "processed", "team assignment update", (), "change log of who is in which team", T.StructType([
        MATCH, TIME, _text("player_id", "player"), _whole("team_index", "team from then on")])),
    TableSpec("weapons", "processed", "held-item change", (), "change log of what is in hand", T.StructType([
        MATCH, TIME, _whole("channel", "network channel"), _text("player_id", "player", null=True), _whole("weapon_guid", "item"),
        _text("weapon_class", "class of the item", null=True)])),
    TableSpec("safezones", "processed", "storm phase", (), "one row per phase of the storm", T.StructType([
        MATCH, _real("start_shrink", "shrinking begins", "s"), _real("finish_shrink", "shrinking ends", "s"), _real("radius", "radius", "uu"),
        _real("next_radius", "radius after", "uu"), _real("next_x", "next centre", "uu", null=True), _real("next_y", "next centre", "uu", null=True)])),
    TableSpec("actor_classes", "interim", "actor class", ("path",), "how often each class was spawned", T.StructType([
        _text("path", "class path"), _whole("spawns", "spawns")])),
    TableSpec("fight_sides", "processed", "fight x team", ("fight_id", "team_index"), "each team's view of each fight", T.StructType([
        _text("fight_id", "fight"), MATCH, _whole("team_index", "this team"), _whole("opp_team_index", "main opponent"),
        _real("t0", "first hit", "s"), _real("t_end", "last hit", "s", label=True), _text("players", "players engaged, joined by semicolons"),
        _text("outcome", "win, loss, tie or disengage", label=True), _flag("multi_team", "more than two teams"),
        _whole("n_damage_events", "hits in the fight", label=True), _whole("hits_dealt", "hits dealt", label=True),
        _whole("hits_taken", "hits taken", label=True), _real("damage_dealt", "damage dealt", label=True),
        _real("damage_taken", "damage taken", label=True), _flag("recorder_involved", "the recorder takes part"), _flag("has_bots", "a bot takes part"),
        _flag("mutual", "damage both ways", label=True), _real("minority_damage_share", "damage share of the weaker side", label=True),
        _text("engagement_type", "fight, pick or poke", label=True), _real("dist_median_m", "median distance of hits", "m", null=True, label=True),
        _real("dist_max_m", "largest distance of hits", "m", null=True, label=True), _text("seg_version", "settings the row was made with")])),
    TableSpec("pokes", "processed", "poke", ("fight_id",), "one-sided exchanges and what became of them", T.StructType([
        _text("fight_id", "fight"), MATCH, _whole("poker_team", "team that dealt the damage"), _whole("target_team", "team that took it"),
        _real("t0", "first hit", "s"), _real("t_end", "last hit", "s", label=True), _real("net_damage", "damage dealt less taken"),
        _text("target_players", "players hit, joined by semicolons"), _flag("converted", "a player hit went down soon after"),
        _text("converted_by", "who did it", null=True), _whole("converter_team", "their team", null=True),
        _real("t_convert", "time from the last hit", "s", null=True), _flag("storm_death", "a player hit died in the storm"),
        _real("structure_damage", "damage to pieces near the targets"), _whole("structure_hits", "hits on such pieces"),
        _text("seg_version", "settings the row was made with")])),
    TableSpec("events", "processed", "competitive event", ("event_id",), "tournaments", T.StructType([
        _text("event_id", "event"), _text("name", "name"), _text("date", "day"), _text("region", "region", null=True), _text("format", "format"),
        _flag("is_lan", "on site"), _text("tier", "rank of the event"), _text("source", "origin"), _text("source_key", "key there")]), True),
    TableSpec("event_results", "processed", "event x player", ("event_id", "player_id"), "placings", T.StructType([
        _text("event_id", "event"), _text("player_id", "player"), _text("team_key", "team"), _whole("placement", "place"),
        _whole("field_size", "entrants"), _real("points", "points", null=True), _real("earnings_usd", "prize", "USD", null=True)]), True),
    TableSpec("player_xref", "processed", "player x external id", ("source", "source_key"), "one player under several names", T.StructType([
        _text("player_id", "player"), _text("source", "origin"), _text("source_key", "key there"), _text("valid_from", "from", null=True),
        _text("valid_to", "until", null=True), _text("confidence", "how sure")]), True),
    TableSpec("player_meta", "processed", "player", ("player_id",), "about players", T.StructType([
        _text("player_id", "player"), _text("display_name", "name to show"), _text("birth_date", "born", null=True),
        _text("birth_date_source", "origin of that", null=True), _text("debut_date", "first event", null=True), _text("region", "region", null=True)]), True),
]
TABLES: dict[str, TableSpec] = {t.name: t for t in _DECLARED}

PROCESSED = [t.name for t in TABLES.values() if t.layer == "processed" and not t.planned]


def label_only(table: str | None = None) -> set[str]:
    """Columns known only during or after what they describe, by the fields' own marks."""
    return {f.name for t in TABLES.values() if table in (None, t.name) for f in t.schema.fields if f.metadata.get("label_only")}


def assert_no_label_features(columns: Sequence[str], table: str | None = None) -> None:
    """Refuse feature columns that a table marks as label-only."""
    if late := sorted(label_only(table) & set(columns)):
        raise ValueError(f"label-only columns among the features: {late}")


# ------------------------------------------------------------------------------------------------------- coercion
def parse_bool(c: Column, kind: T.DataType) -> Column:
    """1 / 0 / true / false in any case, trimmed; anything else is null."""
    if isinstance(kind, T.BooleanType):
        return c
    if not isinstance(kind, T.StringType):
        return F.when(c == 1, True).when(c == 0, False)
    token = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(token.isin("1", "true"), True).when(token.isin("0", "false"), False)


NUMBER = r"(?i)^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity)\s*$"


def parse_float(c: Column, kind: T.DataType | None = None) -> Column:
    """Number or null; NaN counts as null, and so does a text with a type suffix, which a cast alone would read."""
    n = c.try_cast("double")
    if isinstance(kind, T.StringType):
        n = F.when(c.rlike(NUMBER), n)
    return F.when(~F.isnan(n), n)


def parse_int(c: Column, kind: T.DataType) -> Column:
    """Nearest long with ties to even, or null."""
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return c.cast("long")
    return F.bround(parse_float(c, kind), 0).try_cast("long")


def coerce(df: DataFrame, table: str) -> DataFrame:
    """Cast declared columns to their types, one projection; values that do not parse become null, other columns stay."""
    declared = {f.name: f for f in TABLES[table].schema.fields}

    def typed(field: T.StructField) -> Column:
        c, spec = F.col(f"`{field.name}`"), declared.get(field.name)
        if spec is None:
            return c
        if isinstance(spec.dataType, T.BooleanType):
            c = parse_bool(c, field.dataType)
        elif isinstance(spec.dataType, T.LongType):
            c = parse_int(c, field.dataType)
        elif isinstance(spec.dataType, T.DoubleType):
            c = parse_float(c, field.dataType)
        else:
            c = c.cast("string")
        return c.alias(field.name, metadata=spec.metadata)

    return df.select(*[typed(f) for f in df.schema.fields])


# ----------------------------------------------------------------------------------------------------- validation
REPORT = "table string, column string, check string, n long"


def _same_kind(a: T.DataType, b: T.DataType) -> bool:
    groups = [(T.LongType, T.IntegerType, T.ShortType, T.ByteType), (T.DoubleType, T.FloatType), (T.StringType,), (T.BooleanType,)]
    return any(isinstance(a, g) and isinstance(b, g) for g in groups)


def validate(df: DataFrame, table: str) -> DataFrame:
    """Problems as rows (table, column, check, n): missing, undeclared, nulls, type, duplicate_keys. None if valid.

    One aggregation over the data for all column checks, one more for the key.
    """
    spec = TABLES[table]
    here = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in spec.names if c not in here]
    fixed = [(c, "missing") for c in missing] + [(c, "undeclared") for c in here if c not in spec.names]
    checks: list[tuple[str, str, Column]] = [(c, kind, F.lit(1).cast("long")) for c, kind in fixed]
    for f in spec.schema.fields:
        if f.name not in here:
            continue
        c = F.col(f.name)
        if not f.nullable:
            checks.append((f.name, "nulls", F.count_if(c.isNull())))
        if not _same_kind(here[f.name], f.dataType):
            # A column of the wrong type is excused if the table has rows but the column no values.
            checks.append((f.name, "type", F.when((F.count("*") == 0) | (F.count(c) > 0), 1).otherwise(0).cast("long")))
    empty = df.sparkSession.createDataFrame([], REPORT)
    reports = [empty]
    if checks:
        row = df.agg(*[n.alias(f"n{i}") for i, (_, _, n) in enumerate(checks)])
        reports.append(row.select(F.inline(F.array(*[
            F.struct(F.lit(table).alias("table"), F.lit(c).alias("column"), F.lit(kind).alias("check"), F.col(f"n{i}").alias("n"))
            for i, (c, kind, _) in enumerate(checks)]))))
    if spec.key and not missing:
        extra = df.groupBy(*spec.key).count().where(F.col("count") > 1).agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
        reports.append(extra.select(F.lit(table).alias("table"), F.lit(",".join(spec.key)).alias("column"),
                                    F.lit("duplicate_keys").alias("check"), "n"))
    return reduce(lambda a, b: a.unionByName(b), reports).where(F.col("n") > 0)


def validate_all(tables: dict[str, DataFrame]) -> DataFrame:
    """One report over several tables."""
    return reduce(lambda a, b: a.unionByName(b), [validate(df, name) for name, df in tables.items()])


def validation_summary(tables: dict[str, DataFrame], wanted: Sequence[str] = tuple(PROCESSED)) -> DataFrame:
    """Per table of `wanted`: status ok | FAIL | skip (not there), row count, number of problems."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name in wanted:
        if name not in tables:
            rows.append(spark.range(1).select(F.lit(name).alias("table"), F.lit("skip").alias("status"),
                                              F.lit(None).cast("long").alias("rows"), F.lit(None).cast("long").alias("problems")))
            continue
        counts = tables[name].agg(F.count("*").alias("rows"), F.lit(0).cast("long").alias("problems"))
        found = validate(tables[name], name).agg(F.lit(0).cast("long").alias("rows"), F.count("*").alias("problems"))
        both = counts.unionByName(found).agg(F.sum("rows").alias("rows"), F.sum("problems").alias("problems"))
        rows.append(both.select(F.lit(name).alias("table"), F.when(F.col("problems") == 0, "ok").otherwise("FAIL").alias("status"),
                                "rows", "problems"))
    return reduce(lambda a, b: a.unionByName(b), rows)


def require_columns(tables: dict[str, DataFrame]) -> None:
    """Raise if a table lacks declared columns; looks at schemas only."""
    gone = [f"{name}.{c}: missing" for name, df in tables.items() for c in TABLES[name].names if c not in df.columns]
    if gone:
        raise ValueError("schema validation failed:\n  " + "\n  ".join(gone))


def problems(df: DataFrame, table: str) -> list[str]:
    """The report as messages; its length is bounded by the number of columns."""
    return [f"{r['table']}.{r['column']}: {r['check']} ({r['n']})" for r in validate(df, table).collect()]


def require_valid(tables: dict[str, DataFrame]) -> None:
    """Raise with every problem of every table."""
    found = [f"{r['table']}.{r['column']}: {r['check']} ({r['n']})" for r in validate_all(tables).collect()]
    if found:
        raise ValueError("schema validation failed:\n  " + "\n  ".join(sorted(found)))

"""Telemetry tables derived from the driver's parquet (`events`, `orders`), see FIXTURES.md section 2.

Twelve consecutive users form a match; time is hours since 2024-01-01. The SQL is the fixture's own, with the
roster written as a generated array instead of a joined table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from skirmish.operators.ordered import Ordered, by_size, needs_split
from skirmish.plans import fights as fp
from skirmish.session import materialize, tune

_CACHE: dict[tuple[str, str], "Telemetry"] = {}


class Telemetry:
    """The derived tables of one data folder; each property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = tune(spark), sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Telemetry":
        """Shared per session and folder, so measured layout and stored stages are reused across queries."""
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _CACHE:
            _CACHE[key] = cls(spark, sf_dir)
        return _CACHE[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, query: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(query, **tables)

    @cached_property
    def split(self) -> bool:
        """Whether some match holds more rows than one task should take (one pass over `match_id`)."""
        return needs_split([self.ev])

    @cached_property
    def ev(self) -> DataFrame:
        """Typed events, stored once: the JSON is parsed in one pass, later scans prune and filter columns."""
        return materialize(self.sql("""
            select event_id, concat('m', lpad(cast(user_id div 12 as string), 4, '0')) as match_id,
              cast(unix_micros(cast(ts as timestamp)) - 1704067200000000 as double) / 3600000000 as t,
              concat('P', lpad(cast(user_id % 12 as string), 2, '0')) as player,
              concat('P', lpad(cast((user_id + k) % 12 as string), 2, '0')) as other,
              event_type, value, k
            from (select event_id, user_id, event_type, value, ts, cast(get_json_object(props, '$.k') as int) as k
                  from {events}) e0""", events=self.table("events")), "events")

    @cached_property
    def match_ids(self) -> DataFrame:
        return self.ev.select("match_id").distinct()

    @cached_property
    def roster(self) -> DataFrame:
        """Twelve players in every match."""
        return self.sql("""select match_id, p, concat('P', lpad(cast(p as string), 2, '0')) as player_id
            from (select match_id, explode(sequence(0, 11)) as p from {m})""", m=self.match_ids)

    @cached_property
    def damage(self) -> DataFrame:
        return self.sql("""
            select event_id as row_id, match_id, t, player as source, case when event_id % 4 = 3 then null else other end as target,
              case when event_id % 10 = 0 then cast(0 as double) else value end as magnitude,
              cast((event_id * 37) % 2001 as double) as x, cast((event_id * 53) % 2003 as double) as y
            from {ev} where event_type in ('click','view','purchase')""", ev=self.ev)

    @cached_property
    def elims(self) -> DataFrame:
        return self.sql("""
            select event_id as row_id, match_id, cast(floor(t*1000) as bigint) as t_ms, player as eliminator, other as eliminated,
              event_id % 4 <> 0 as knocked from {ev} where event_type = 'error'""", ev=self.ev)

    @cached_property
    def teams(self) -> DataFrame:
        return self.sql("""
            select match_id, cast(0 as double) as t, player_id, cast(p % 4 as bigint) as team_index, cast(-1 as bigint) as row_id
              from {roster}
            union all select match_id, t, player as player_id, cast(k % 4 as bigint), event_id from {ev}
              where event_type = 'signup' and event_id % 20 = 0""", roster=self.roster, ev=self.ev)

    @cached_property
    def positions(self) -> DataFrame:
        return self.sql("""
            select event_id as row_id, match_id, t, player as player_id, cast((event_id * 37) % 2001 as double) as x,
              cast((event_id * 53) % 2003 as double) as y, cast((event_id % 7) * 100 as double) as z,
              event_type = 'error' and k % 2 = 0 as downed, case k % 3 when 0 then true when 1 then false end as in_storm
              from {ev}
            union all select event_id + 1000000000, match_id, t - 0.5, other, cast((event_id * 41) % 2001 as double),
              cast((event_id * 59) % 2003 as double), cast((event_id % 5) * 100 as double), false,
              case k % 3 when 0 then true end from {ev} where event_id % 2 = 0""", ev=self.ev)

    @cached_property
    def poses(self) -> DataFrame:
        """Positions with a view direction in whole degrees."""
        return self.positions.withColumn("yaw", (F.col("row_id") * 73 % 360 - 180).cast("double"))

    @cached_property
    def placed_pieces(self) -> DataFrame:
        """Pieces with a known builder, and where they stand."""
        return self.sql("""
            select event_id as row_id, match_id, player as builder, t as spawn_t,
              case event_id % 4 when 3 then null else t + cast(5 + event_id % 90 as double) end as close_t,
              cast((event_id * 37) % 2001 as double) as x, cast((event_id * 53) % 2003 as double) as y, cast((event_id % 7) * 100 as double) as z
            from {ev} where event_type in ('view','purchase')""", ev=self.ev)

    @cached_property
    def zones(self) -> DataFrame:
        """Four storm phases per match."""
        return self.sql("""
            select match_id, cast(60 + 150 * k + n % 7 * 5 as double) as start_shrink, cast(120 + 150 * k + n % 7 * 5 as double) as finish_shrink,
              cast(2000 as double) / power(2, k) as radius, cast(1000 as double) / power(2, k) as next_radius,
              cast(800 + (n * 31 + k * 170) % 400 as double) as next_x, cast(800 + (n * 57 + k * 230) % 400 as double) as next_y
            from (select match_id, cast(substr(match_id, 2) as int) as n, explode(sequence(0, 3)) as k from {ids}) m""", ids=self.match_ids)

    @cached_property
    def players(self) -> DataFrame:
        return self.sql("""
            select r.match_id, r.player_id, r.p = 11 as is_bot, d.death_time from {roster} r
            left join (select match_id, eliminated, min(t_ms) / cast(1000 as double) as death_time from {elims}
                       where not knocked group by match_id, eliminated) d
              on d.match_id = r.match_id and d.eliminated = r.player_id""", roster=self.roster, elims=self.elims)

    @cached_property
    def weapons(self) -> DataFrame:
        return self.sql("""
            select event_id as row_id, match_id, t, player as player_id,
              case k % 4 when 0 then 'DefaultBuildingTool_C' when 1 then null when 2 then 'B_Shotgun_C' else 'B_Rifle_C' end as weapon_class
            from {ev} where event_type in ('view','click')""", ev=self.ev)

    @cached_property
    def builds(self) -> DataFrame:
        base = self.sql("""
            select event_id, match_id, t as spawn_t,
              concat('PBWA_', case k % 3 when 0 then 'W' when 1 then 'S' else 'M' end, '1_',
                case event_id % 6 when 0 then 'Solid' when 1 then 'ArchwayLarge' when 2 then 'DoorC' when 3 then 'Floor'
                  when 4 then 'StairW' else 'RoofO' end, '_C') as path,
              cast((k % 2) * 512 as double) as x, cast(0 as double) as y, cast(0 as double) as z, cast(0 as double) as yaw,
              k % 2 as cell, case when event_id % 6 < 3 then 0 else event_id % 6 end as family,
              case when event_id % 3 = 0 then null else cast(k % 4 as bigint) end as team_index
            from {ev} where event_type in ('view','purchase')""", ev=self.ev)
        b0 = Ordered(fp.by_match(base, self.split), ["match_id", "cell", "family"], ["spawn_t", "event_id"], self.split).neighbour(
            "nxt", {"t": F.col("spawn_t")}, after=True).rows()
        return self.sql("""
            select event_id as row_id, match_id, spawn_t, path, x, y, z, yaw,
              case event_id % 4 when 3 then null when 2 then nxt.t - 3 else nxt.t - cast(0.05 as double) end as close_t, team_index
              from {b0}
            union all select event_id + 1000000000, match_id, spawn_t - cast(0.1 as double), path, x, y, z, yaw,
              spawn_t - cast(0.02 as double), cast(null as bigint) from {b0} where event_id % 5 = 0""", b0=b0)

    @cached_property
    def matches(self) -> DataFrame:
        return self.sql("""
            select m.match_id, 'P00' as replay_owner,
              cast(floor(cast(o.own_c * (100 + m.n % 5) as double) / 10000) as bigint) as rec_weapon_damage,
              case when m.n % 4 = 0 then null else cast(m.n % 7 as bigint) end as rec_other_damage
            from (select match_id, cast(substr(match_id, 2) as int) as n from {ids}) m
            left join (select match_id, sum(cast(round(magnitude * 100) as bigint)) as own_c from {damage}
              where source = 'P00' and target is not null and target <> source group by match_id) o on o.match_id = m.match_id""",
            ids=self.match_ids, damage=self.damage)

    @cached_property
    def split_matches(self) -> DataFrame:
        return self.sql("""
            select concat('Replay-', date_format(d, 'yyyy.MM.dd'), '-12.00.00') as match_id,
              case when day(d) % 2 = 0 then null else concat(date_format(d, 'yyyy-MM-dd'), 'T12:00:00Z') end as utc_start
            from (select distinct o_orderdate as d from {orders}) q""", orders=self.table("orders"))

    # ------------------------------------------------------------------------------- stages shared by several queries
    @cached_property
    def hits(self) -> DataFrame:
        """Engagement rows with their fight, stored once."""
        return materialize(fp.group_fights(self.damage, self.teams, split=self.split), "hits")

    def build_sides(self) -> DataFrame:
        """fight_sides from the raw tables, nothing reused; only large matches take the split plan."""
        def build(t: dict[str, DataFrame], split: bool) -> dict[str, DataFrame]:
            return {"sides": fp.build_fight_sides(t["damage"], t["teams"], t["elims"], t["players"], t["matches"], t["positions"], split=split)}

        tables = {n: getattr(self, n) for n in ("damage", "teams", "elims", "players", "matches", "positions")}
        return by_size(build, tables, ["damage", "positions"])["sides"] if self.split else build(tables, False)["sides"]

    @cached_property
    def sides(self) -> DataFrame:
        return materialize(fp.build_fight_sides(
            self.damage, self.teams, self.elims, self.players, self.matches, self.positions, hits=self.hits, split=self.split),
            "fight_sides")

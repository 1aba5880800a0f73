"""The same queries in DuckDB SQL over the driver's tables, for value checks on small data."""

from __future__ import annotations

from skirmish.catalog import planned_sql
from skirmish.functions.columns import KNOWN_SHAPES

# Tables derived from `events` and `orders`, in dependency order. FIXTURES.md section 2.
BASE = {
    "ev": """select event_id, concat('m', lpad(cast(user_id // 12 as varchar),4,'0')) as match_id,
        cast(epoch_us(ts) - 1704067200000000 as double) / 3600000000 as t,
        concat('P', lpad(cast(user_id % 12 as varchar),2,'0')) as player,
        concat('P', lpad(cast((user_id + k) % 12 as varchar),2,'0')) as other,
        event_type, value, k from (select event_id, user_id, event_type, value, ts, cast(json_extract(props,'$.k') as int) as k from events) e0""",
    "ids": "select distinct match_id from ev",
    "roster": "select m.match_id, r.p, concat('P',lpad(cast(r.p as varchar),2,'0')) player_id from ids m cross join (select cast(range as int) p from range(12)) r",
    "damage": """select event_id as row_id, match_id, t, player as source, case when event_id % 4 = 3 then null else other end as target,
        case when event_id % 10 = 0 then cast(0 as double) else value end as magnitude,
        cast((event_id * 37) % 2001 as double) as x, cast((event_id * 53) % 2003 as double) as y
        from ev where event_type in ('click','view','purchase')""",
    "elims": """select event_id as row_id, match_id, cast(floor(t*1000) as bigint) as t_ms, player as eliminator, other as eliminated,
        event_id % 4 <> 0 as knocked, cast(floor(t*1000) as bigint) / 1000.0::double as t from ev where event_type = 'error'""",
    "teams": """select match_id, cast(0 as double) as t, player_id, cast(p % 4 as bigint) as team_index, cast(-1 as bigint) as row_id from roster
        union all select match_id, t, player as player_id, cast(k % 4 as bigint), event_id from ev where event_type='signup' and event_id % 20 = 0""",
    "positions": """select event_id as row_id, match_id, t, player as player_id, cast((event_id * 37) % 2001 as double) as x, cast((event_id * 53) % 2003 as double) as y,
        cast((event_id % 7) * 100 as double) as z, event_type = 'error' and k % 2 = 0 as downed,
        case k % 3 when 0 then true when 1 then false end as in_storm from ev
        union all select event_id + 1000000000, match_id, t - 0.5, other, cast((event_id * 41) % 2001 as double), cast((event_id * 59) % 2003 as double),
        cast((event_id % 5) * 100 as double), false, case k % 3 when 0 then true end from ev where event_id % 2 = 0""",
    "players": """select r.match_id, r.player_id, r.p = 11 as is_bot, d.death_time from roster r
        left join (select match_id, eliminated, min(t_ms) / cast(1000 as double) as death_time from elims where not knocked group by match_id, eliminated) d
        on d.match_id=r.match_id and d.eliminated=r.player_id""",
    "weapons": """select event_id as row_id, match_id, t, player as player_id,
        case k % 4 when 0 then 'DefaultBuildingTool_C' when 1 then null when 2 then 'B_Shotgun_C' else 'B_Rifle_C' end as weapon_class
        from ev where event_type in ('view','click')""",
    "builds": """select * from (with b0 as (select event_id, match_id, t as spawn_t,
            concat('PBWA_', case k % 3 when 0 then 'W' when 1 then 'S' else 'M' end, '1_',
              case event_id % 6 when 0 then 'Solid' when 1 then 'ArchwayLarge' when 2 then 'DoorC' when 3 then 'Floor' when 4 then 'StairW' else 'RoofO' end, '_C') as path,
            cast((k % 2) * 512 as double) as x, cast(0 as double) as y, cast(0 as double) as z, cast(0 as double) as yaw,
            lead(t) over (partition by match_id, k % 2, case when event_id % 6 < 3 then 0 else event_id % 6 end order by t, event_id) as nt,
            case when event_id % 3 = 0 then null else cast(k % 4 as bigint) end as team_index
          from ev where event_type in ('view','purchase'))
        select event_id as row_id, match_id, spawn_t, path, x, y, z, yaw,
          case event_id % 4 when 3 then null when 2 then nt - 3 else nt - cast(0.05 as double) end as close_t, team_index from b0
        union all select event_id + 1000000000, match_id, spawn_t - cast(0.1 as double), path, x, y, z, yaw, spawn_t - cast(0.02 as double), cast(null as bigint)
        from b0 where event_id % 5 = 0) bb""",
    "matches": """select m.match_id, 'P00' as replay_owner,
        cast(floor(cast(o.own_c * (100 + m.n % 5) as double) / 10000) as bigint) as rec_weapon_damage,
        case when m.n % 4 = 0 then null else cast(m.n % 7 as bigint) end as rec_other_damage
        from (select match_id, cast(substr(match_id, 2) as int) as n from ids) m
        left join (select match_id, sum(cast(round(magnitude * 100) as bigint)) as own_c from damage
          where source = 'P00' and target is not null and target <> source group by match_id) o on o.match_id = m.match_id""",
    "split_matches": """select concat('Replay-', strftime(d,'%Y.%m.%d'), '-12.00.00') as match_id,
        case when day(d) % 2 = 0 then null else concat(strftime(d,'%Y-%m-%d'), 'T12:00:00Z') end as utc_start
        from (select distinct o_orderdate as d from orders) q""",
    "starts": """select match_id, coalesce(epoch_us(try_cast(utc_start as timestamptz)),
        epoch_us(try_strptime(nullif(regexp_extract(match_id, '(\\d{4}\\.\\d{2}\\.\\d{2}-\\d{2}\\.\\d{2}\\.\\d{2})', 1), ''), '%Y.%m.%d-%H.%M.%S'))) as start_us
        from split_matches""",
    "ranked_starts": "select match_id, start_us, row_number() over (order by start_us nulls last, match_id) - 1 as rank, count(*) over () as n from starts",
    "dated": "select event_id, cast(ts as date) as date from events",
    "dates": """select date, n_test, coalesce(sum(n_test) over (order by date rows between unbounded preceding and 1 preceding), 0)::bigint as n_train
        from (select date, count(*) as n_test from dated group by date) q""",
    # engagement, segments
    "hits0": """select d.*, a.team_index as source_team, b.team_index as target_team from
        (select * from damage) d asof left join teams a on d.match_id = a.match_id and d.source = a.player_id and d.t >= a.t
        asof left join teams b on d.match_id = b.match_id and d.target = b.player_id and d.t >= b.t""",
    "eng": """select *, least(source_team, target_team) as team_a, greatest(source_team, target_team) as team_b from hits0
        where target is not null and source <> target and magnitude > 0 and source_team <> target_team""",
    "gaps": "select *, t - lag(t) over (partition by match_id, team_a, team_b order by t, row_id) as gap from eng",
    # outcomes
    "team_size": "select match_id, not bool_or(many) as solo from (select match_id, team_index, count(distinct player_id) > 1 as many from teams group by all) q group by match_id",
    "knock1": "select match_id, eliminated, min(t) as first_knock from elims where knocked group by match_id, eliminated",
    "placed": """select e.*, a.team_index as victim_team, b.team_index as killer_team, f.first_knock, s.solo,
          e.eliminator = 'P00' or e.eliminated = 'P00' as recorder
        from (select * from elims) e
        asof left join teams a on e.match_id = a.match_id and e.eliminated = a.player_id and e.t >= a.t
        asof left join teams b on e.match_id = b.match_id and e.eliminator = b.player_id and e.t >= b.t
        left join knock1 f on f.match_id = e.match_id and f.eliminated = e.eliminated left join team_size s on s.match_id = e.match_id""",
    "events_k": """select match_id, t, eliminator, eliminated, victim_team, killer_team from placed where victim_team <> killer_team
        and (knocked or (coalesce(first_knock > t, true) and solo))""",
    "events_d": """select match_id, t, eliminator, eliminated, victim_team, killer_team from placed where victim_team <> killer_team
        and (knocked or coalesce(first_knock > t, true))""",
    "downs": """select e.match_id, e.eliminated as victim, e.t, p.t - e.t as "offset" from (select * from elims where knocked) e
        asof join (select match_id, player_id, t from positions where downed) p on upper(e.eliminated) = p.player_id and e.match_id = p.match_id and e.t - 5.0::double <= p.t
        where p.t - e.t < 5""",
}


def fights_ctes(gap: float = 10, tol: float = 1, s: str = "") -> dict[str, str]:
    """Segments, components and fights under one parameter setting; `s` is a name suffix."""
    return {
        f"seg_rows{s}": f"""select *, sum(case when gap is null or gap > {gap} then 1 else 0 end) over (partition by match_id, team_a, team_b order by t, row_id) as sg from gaps""",
        f"seg{s}": f"""select *, row_number() over (order by match_id, team_a, team_b, sg) as id from
            (select match_id, team_a, team_b, sg, min(t) as seg_start, max(t) as seg_end, count(*) as n_hits from seg_rows{s} group by match_id, team_a, team_b, sg)""",
        f"edge{s}": f"""select p.id as i, q.id as j from seg{s} p join seg{s} q on p.match_id = q.match_id
            and (p.team_a in (q.team_a, q.team_b) or p.team_b in (q.team_a, q.team_b))
            and greatest(p.seg_start, q.seg_start) - least(p.seg_end, q.seg_end) <= {tol}""",
        f"reach{s}": f"select id as i, id as j from seg{s} union select r.i, e.j from reach{s} r join edge{s} e on r.j = e.i",
        f"comp{s}": f"select i, min(j) as c from reach{s} group by i",
        f"fight{s}": f"""select c, match_id, t0, t_end, row_number() over (partition by match_id order by t0, low) - 1 as n from
            (select c, min(match_id) as match_id, min(seg_start) as t0, max(seg_end) as t_end, min(team_a) as low from comp{s} join seg{s} on i = id group by c)""",
        f"segf{s}": f"select g.*, f.n, f.t0, f.t_end, concat(f.match_id, ':', f.n) as fight_id from seg{s} g join comp{s} on i = id join fight{s} f using (c)".replace("g.*, f.n", "g.*, f.c as c, f.n"),
        f"hits{s}": f"select r.*, f.n, f.t0, f.t_end, f.fight_id from seg_rows{s} r join segf{s} f using (match_id, team_a, team_b, sg)",
        f"skel{s}": f"""select distinct match_id, n, fight_id, t0, t_end, unnest([team_a, team_b]) as team from segf{s}""",
    }


SIDES = {
    "dirs": """select match_id, n, fight_id, t, source_team as team, target_team as opp, source as player_id, magnitude as dealt, 0::double as taken from hits
        union all select match_id, n, fight_id, t, target_team, source_team, target, 0::double, magnitude from hits""",
    "side": """select match_id, n, fight_id, team, count(*) as events, count(*) filter (dealt > 0) as hits_dealt, count(*) filter (taken > 0) as hits_taken,
        sum(dealt) as dealt, sum(taken) as taken, array_to_string(list_sort(list_distinct(list(player_id))), ';') as players from dirs group by all""",
    "opp1": """select match_id, n, team, opp from (select match_id, n, team, opp, row_number() over (partition by match_id, n, team order by sum(dealt + taken) desc, opp) as r
        from dirs group by match_id, n, team, opp) q where r = 1""",
    "flevel": """select match_id, n, count(*) as n_teams, count(*) filter (dealt > 0) >= 2 as mutual,
        coalesce(list_sort(list(dealt), 'desc')[2], 0) / case when sum(dealt) > 0 then sum(dealt) else 1 end as minority_damage_share from side group by match_id, n""",
    "fflags": """select d.match_id, d.n, bool_or(d.player_id = 'P00') as recorder_involved, bool_or(coalesce(p.is_bot, false) or d.player_id like 'BOT!_%' escape '!') as has_bots
        from dirs d left join players p on p.match_id = d.match_id and p.player_id = d.player_id group by d.match_id, d.n""",
    "hdist": """select h.match_id, h.row_id, case when h.t - a.t <= 2 and h.t - b.t <= 2 then
          sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) / 100 end as dist
        from (select row_id, match_id, t, source, target from damage where target is not null and source <> target and magnitude > 0) h
        asof left join positions a on h.match_id = a.match_id and h.source = a.player_id and h.t >= a.t
        asof left join positions b on h.match_id = b.match_id and h.target = b.player_id and h.t >= b.t""",
    "fdist": """select match_id, n, median(dist) as dist_median_m, max(dist) as dist_max_m from hits join hdist using (match_id, row_id)
        where dist is not null group by match_id, n""",
}


def outcome_ctes(events: str = "events_k", grace: float = 3, tie: float = 1, s: str = "", skel: str = "skel") -> dict[str, str]:
    return {
        f"inside{s}": f"""select v.match_id, v.n, v.fight_id, e.t, e.eliminator, e.eliminated, e.victim_team, e.killer_team from {events} e
            join {skel} v on v.match_id = e.match_id and v.team = e.victim_team and e.t >= v.t0 and e.t <= v.t_end + {grace}
            join {skel} k on k.match_id = v.match_id and k.n = v.n and k.team = e.killer_team""",
        f"loss{s}": f"select match_id, n, victim_team as team, min(t) as loss_t from inside{s} group by all",
        f"win{s}": f"select match_id, n, killer_team as team, min(t) as win_t from inside{s} group by all",
        f"firsts{s}": f"""select s.match_id, s.n, s.fight_id, s.team, loss_t, win_t,
            coalesce(loss_t <= min(loss_t) over (partition by s.match_id, s.n) + {tie}, false) as tied from {skel} s
            left join loss{s} l on l.match_id = s.match_id and l.n = s.n and l.team = s.team
            left join win{s} w on w.match_id = s.match_id and w.n = s.n and w.team = s.team""",
        f"outc{s}": f"""select match_id, n, fight_id, team, case when tied and count(*) filter (tied) over (partition by match_id, n) >= 2 then 'tie'
            when loss_t is not null and (win_t is null or loss_t <= win_t) then 'loss' when win_t is not null then 'win' else 'disengage' end as outcome from firsts{s}""",
    }


SIDES2 = {
    "fs": """select s.fight_id, s.match_id, s.n, s.team as team_index, o.opp as opp_team_index, f.t0, f.t_end, s.players, u.outcome, l.n_teams > 2 as multi_team,
        s.events as n_damage_events, s.hits_dealt, s.hits_taken, s.dealt as damage_dealt, s.taken as damage_taken, g.recorder_involved, g.has_bots, l.mutual,
        l.minority_damage_share, case when l.mutual and l.minority_damage_share >= 0.1::double then 'fight'
          when bool_or(u.outcome <> 'disengage') over (partition by s.match_id, s.n) then 'pick' else 'poke' end as engagement_type,
        bool_or(u.outcome <> 'disengage') over (partition by s.match_id, s.n) as decisive,
        d.dist_median_m, d.dist_max_m, 'v2-gap10-tol1-grace3-poke10-conv20' as seg_version
        from side s join opp1 o on o.match_id = s.match_id and o.n = s.n and o.team = s.team
        join fight f on f.match_id = s.match_id and f.n = s.n
        join outc u on u.match_id = s.match_id and u.n = s.n and u.team = s.team
        join flevel l on l.match_id = s.match_id and l.n = s.n join fflags g on g.match_id = s.match_id and g.n = s.n
        left join fdist d on d.match_id = s.match_id and d.n = s.n""",
    "fights1": "select * from fs qualify row_number() over (partition by fight_id order by team_index) = 1",
    # pokes
    "flows": "select match_id, n, fight_id, source_team as s, target_team as g, sum(magnitude) as dealt, list_sort(list_distinct(list(target))) as targets from hits group by all",
    "poker": "select match_id, n, fight_id, s from (select match_id, n, fight_id, s, row_number() over (partition by fight_id order by sum(dealt) desc, s) as r from flows group by match_id, n, fight_id, s) q where r = 1",
    "pair": """select w.*, f.t0, f.t_end from (select p.match_id, p.n, p.fight_id, p.s as poker_team, fl.g as target_team, fl.dealt - coalesce(b.dealt, 0) as net_damage,
          array_to_string(fl.targets, ';') as target_players, row_number() over (partition by p.fight_id order by fl.dealt desc, fl.g) as r
        from poker p join flows fl on fl.fight_id = p.fight_id and fl.s = p.s left join flows b on b.fight_id = p.fight_id and b.s = fl.g and b.g = p.s) w
        join fight f on f.match_id = w.match_id and f.n = w.n where r = 1""",
    "pokes1": "select * from pair where fight_id in (select fight_id from fs where engagement_type = 'poke')",
    "tgt": "select *, unnest(string_split(target_players, ';')) as player from pokes1",
    "storm": """select d.match_id, d.player_id, d.death_time, p.in_storm from (select * from players where death_time is not null) d
        asof left join (select * from positions where in_storm is not null) p on p.match_id = d.match_id and p.player_id = d.player_id and d.death_time >= p.t""",
    "shit": """select d.row_id, d.match_id, d.t, d.magnitude, d.x, d.y, a.team_index as team from (select * from damage where target is null and source is not null and magnitude > 0) d
        asof left join teams a on d.match_id = a.match_id and d.source = a.player_id and d.t >= a.t""",
}


def conversion_ctes(convert: float = 20, s: str = "") -> dict[str, str]:
    return {
        f"convfirst{s}": f"""select * from (select g.match_id, g.fight_id, g.poker_team, g.t_end, e.t, e.eliminator, e.eliminated,
              row_number() over (partition by g.fight_id order by e.t, e.eliminated, e.eliminator) as r
            from tgt g join elims e on e.match_id = g.match_id and e.eliminated = g.player and e.t > g.t_end + 3 and e.t <= g.t_end + {convert}) q where r = 1""",
        f"conv{s}": f"""select c.fight_id, case when c.eliminator = c.eliminated or a.team_index is null then 'environment' when a.team_index = c.poker_team then 'poker' else 'third_party' end as converted_by,
            case when not (c.eliminator = c.eliminated or a.team_index is null) then a.team_index end as converter_team, c.t - c.t_end as t_convert
            from convfirst{s} c asof left join teams a on a.match_id = c.match_id and a.player_id = c.eliminator and c.t >= a.t""",
        f"stormy{s}": f"""select distinct g.fight_id from tgt g join storm d on d.match_id = g.match_id and d.player_id = g.player
            and d.in_storm and d.death_time >= g.t0 and d.death_time <= g.t_end + {convert}""",
    }


def structure_cte(pairs: str, name: str) -> dict[str, str]:
    return {
        f"look_{name}": f"""select fight_id, row_id, match_id, t, magnitude, x, y, unnest(string_split(target_players, ';')) as player from
            (select p.fight_id, h.row_id, h.match_id, h.t, h.magnitude, h.x, h.y, p.target_players from shit h join {pairs} p on p.match_id = h.match_id and p.poker_team = h.team and h.t >= p.t0 and h.t <= p.t_end) q""",
        name: f"""select fight_id, sum(magnitude) as structure_damage, count(*) as structure_hits from (select distinct l.fight_id, l.row_id, l.magnitude
            from look_{name} l asof left join positions p on p.match_id = l.match_id and p.player_id = l.player and l.t >= p.t
            where l.t - p.t <= 2 and sqrt((p.x-l.x)*(p.x-l.x) + (p.y-l.y)*(p.y-l.y)) <= 1024) q group by fight_id""",
    }


PIECES = {
    "shaped": """select *, case when regexp_matches(path, '^PBWA_([A-Z])(\\d)_(.+)_C$') then regexp_extract(path, '^PBWA_([A-Z])(\\d)_(.+)_C$', 3) end as shape,
        case regexp_extract(path, '^PBWA_([A-Z])(\\d)_(.+)_C$', 1) when 'W' then 'wood' when 'S' then 'brick' when 'M' then 'metal' end as material from builds""",
    "classed": """select *, case when shape is null then null when shape = 'Solid' then 'wall' when shape = 'Floor' then 'floor' when shape = 'StairW' then 'stair' when shape = 'RoofC' then 'cone'
        when lower(shape) like 'stair%' then 'stair' when lower(shape) like 'roof%' then 'cone' when lower(shape) like 'floor%' or lower(shape) like 'balcony%' then 'floor' else 'wall' end as kind,
        coalesce(shape not in ('Solid', 'Floor', 'StairW', 'RoofC'), true) as edited from shaped""",
    "pred": """select *, coalesce(abs(lead(spawn_t) over w - close_t) <= 0.2::double, false) as predicted, lag(spawn_t) over w as prev_spawn from classed
        window w as (partition by match_id, path, x, y, z, yaw order by spawn_t, row_id)""",
    "pred2": "select *, lag(predicted) over (partition by match_id, path, x, y, z, yaw order by spawn_t, row_id) as after_predicted from pred",
    "parsed": """select row_id, match_id, case when after_predicted then prev_spawn else spawn_t end as spawn_t, path, x, y, z, yaw, close_t, team_index, material, shape, kind, edited
        from pred2 where not predicted""",
    "prevs": """select *, lag(shape) over w as prev_shape, lag(close_t) over w as prev_close_t from parsed window w as (partition by match_id, x, y, z, kind order by spawn_t, row_id)""",
    "edits": """select *, rep and edited as is_edit, rep and not edited as is_reset from
        (select *, coalesce(prev_shape <> shape and abs(spawn_t - prev_close_t) <= 1.5::double, false) as rep from prevs) q""",
    "cand": """select e.row_id, e.match_id, e.spawn_t, e.x, e.y, e.z, e.team_index, not (e.is_edit or e.is_reset) as fresh, p.player_id
        from edits e join (select distinct match_id, player_id from positions) p on p.match_id = e.match_id""",
    "cand2": """select c.*, coalesce(sqrt((p.x-c.x)*(p.x-c.x) + (p.y-c.y)*(p.y-c.y) + (p.z-c.z)*(p.z-c.z)), 'infinity'::double) as dist,
        coalesce(g.team_index = c.team_index, false) as on_team, coalesce(contains(w.weapon_class, 'BuildingTool'), false) as tool
        from cand c asof left join positions p on p.match_id = c.match_id and p.player_id = c.player_id and c.spawn_t >= p.t
        asof left join teams g on g.match_id = c.match_id and g.player_id = c.player_id and c.spawn_t >= g.t
        asof left join weapons w on w.match_id = c.match_id and w.player_id = c.player_id and c.spawn_t >= w.t""",
    "cand3": "select *, bool_or(on_team) over (partition by row_id) as known, count(*) filter (on_team) over (partition by row_id) as n_team from cand2",
    "best": """select *, fresh and tool as used from cand3 qualify row_number() over (partition by row_id
        order by known and not on_team, fresh and not tool, least(dist, 100000), player_id) = 1""",
    "built": """select e.*, case when b.known or b.dist <= 800 then b.player_id end as builder, coalesce(b.dist, 'infinity'::double) as builder_dist,
        case when b.known then case when b.n_team = 1 then 'team' when b.used then 'team+tool' else 'team+nearest' end
             when b.dist <= 800 then case when b.used then 'tool' else 'nearest' end end as builder_source
        from edits e left join best b on b.row_id = e.row_id""",
}

ALL: dict[str, str] = {**BASE, **fights_ctes(), **fights_ctes(5, 1, "5"), **fights_ctes(100, 1, "100"), **SIDES, **outcome_ctes(),
                       **outcome_ctes("events_d", s="_d"), **SIDES2, **conversion_ctes(), **structure_cte("pokes1", "pressure"),
                       **structure_cte("pair", "pressure_all"), **PIECES}


def _words(sql: str) -> set[str]:
    import re
    return set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", sql))


def with_ctes(sql: str, extra: dict[str, str] | None = None) -> str:
    """`sql` preceded by the definitions it needs."""
    defs = {**ALL, **planned_sql.DEFS, **(extra or {})}
    needed: set[str] = set()
    todo = [w for w in _words(sql) if w in defs]
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += [w for w in _words(defs[name]) if w in defs and w != name]
    body = ",\n".join(f"{n} as {'' if n.startswith('reach') else 'materialized '}({defs[n]})" for n in defs if n in needed)
    return f"with recursive {body}\n{sql}" if needed else sql


# Range steps of the 48-cell grid: every setting has its own chain of segments, components and outcomes.
def sweep_sql() -> tuple[str, dict[str, str]]:
    extra: dict[str, str] = {}
    cells = []
    for gap in (5, 10, 15, 20):
        for tol in (0, 1, 2, 3):
            s = f"_{gap}_{tol}"
            extra.update(fights_ctes(gap, tol, s))
            for grace in (1, 3, 5):
                g = f"{s}_{grace}"
                extra.update(outcome_ctes("events_k", grace, 1, g, f"skel{s}"))
                extra[f"cell{g}"] = f"""select {gap}::double as gap, {tol}::double as tol, {grace}::double as grace, a.*, b.*, c.*, d.* from
                    (select count(*) as fights, avg((k > 2)::int) as multi from (select n, match_id, count(*) as k from skel{s} group by all) q) a,
                    (select avg((outcome = 'win')::int) as win, avg((outcome = 'loss')::int) as loss, avg((outcome = 'tie')::int) as tie,
                       avg((outcome = 'disengage')::int) as disengage, count(*) filter (outcome in ('win', 'loss')) // 2 as labelled_2team
                     from (select outcome, count(*) over (partition by match_id, n) as k from outc{g}) q where k <= 2) b,
                    (select quantile_cont(t_end - t0, 0.5) as dur_p50, quantile_cont(t_end - t0, 0.9) as dur_p90, max(t_end - t0) as dur_max from fight{s}) c,
                    (select avg(i::int) as in_fight, avg(v::int) as coverage from (select coalesce(bool_or(x.n is not null), false) as i, coalesce(bool_or(o.outcome <> 'disengage'), false) as v
                       from rknocks r left join inside_kn{g} x on x.row_id = r.row_id left join outc{g} o on o.match_id = x.match_id and o.n = x.n and o.team = r.victim_team group by r.row_id) q) d"""
                extra[f"inside_kn{g}"] = f"""select e.row_id, v.match_id, v.n from rknocks e join skel{s} v on v.match_id = e.match_id and v.team = e.victim_team
                    and e.t >= v.t0 and e.t <= v.t_end + {grace} join skel{s} k on k.match_id = v.match_id and k.n = v.n and k.team = e.killer_team"""
                cells.append(f"cell{g}")
    order = {k: extra[k] for k in extra if not k.startswith("cell")}
    order.update({k: extra[k] for k in extra if k.startswith("cell")})
    body = " union all ".join(f"select * from {c}" for c in cells)
    cols = "gap, tol, grace, fights, round(multi, 6) as multi, round(win, 6) as win, round(loss, 6) as loss, round(tie, 6) as tie, round(disengage, 6) as disengage, labelled_2team, " \
           "round(dur_p50, 6) as dur_p50, round(dur_p90, 6) as dur_p90, round(dur_max, 6) as dur_max, round(in_fight, 6) as in_fight, round(coverage, 6) as coverage"
    return f"select {cols} from ({body}) q", order


ALL["rknocks"] = "select * from placed where knocked and recorder and victim_team <> killer_team"
ALL["cover"] = """select r.row_id, r.match_id, r.t, r.eliminator, r.eliminated, coalesce(bool_or(v.n is not null), false) as in_fight,
    coalesce(bool_or(o.outcome <> 'disengage'), false) as covered from rknocks r
    left join (select v.match_id, v.n, v.team, v.t0, v.t_end, k.team as k from skel v join skel k on k.match_id = v.match_id and k.n = v.n) v
      on v.match_id = r.match_id and v.team = r.victim_team and v.k = r.killer_team and r.t >= v.t0 and r.t <= v.t_end + 3
    left join outc o on o.match_id = v.match_id and o.n = v.n and o.team = r.victim_team group by all"""
ALL["recd"] = """select m.match_id, m.game::double as game, coalesce(d.parsed, 0) as parsed from
    (select match_id, case when coalesce(rec_weapon_damage, rec_other_damage) is not null then coalesce(rec_weapon_damage, 0) + coalesce(rec_other_damage, 0) end as game from matches) m
    left join (select match_id, sum(magnitude) as parsed from damage where target is not null and target <> source and source = 'P00' group by match_id) d using (match_id) where game > 0"""
ALL["files"] = """select concat(lpad(cast(doc_id as varchar), 8, '0'), '.replay') as replay_file, sha256(text) as sha256, n_chars as size_bytes, doc_id, text from documents"""
ALL["rawelims"] = """select row_id, match_id, case row_id % 5 when 0 then 'bad' when 1 then concat(cast(t_ms as varchar), '.5') else cast(t_ms as varchar) end as t_ms, eliminator, eliminated,
    case row_id % 7 when 0 then 'TRUE ' when 1 then '0' when 2 then 'yes' when 3 then '' when 4 then ' False' else '1' end as knocked from elims"""
ALL["flag"] = """select row_id, case when lower(trim(knocked)) in ('1', 'true') then true when lower(trim(knocked)) in ('0', 'false') then false end as flag from rawelims"""
ALL["sdmg"] = """select e.*, e.t - d.t as since from (select * from placed) e asof left join (select match_id, target, t from damage where target is not null) d
    on d.match_id = e.match_id and d.target = e.eliminated and e.t >= d.t"""
ALL["botteam"] = """select t.match_id, t.team_index, bool_or(p.is_bot) as any_bot, bool_and(p.is_bot) as all_bot, count(*) filter (p.is_bot) as b, count(*) as k
    from teams t left join players p on p.match_id = t.match_id and p.player_id = t.player_id group by t.match_id, t.team_index"""
ALL["inseg"] = """select p.*, least(victim_team, killer_team) as team_a, greatest(victim_team, killer_team) as team_b, exists (select 1 from seg g where g.match_id = p.match_id
    and g.team_a = least(p.victim_team, p.killer_team) and g.team_b = greatest(p.victim_team, p.killer_team) and p.t >= g.seg_start and p.t <= g.seg_end + 3) as in_seg
    from placed p where victim_team <> killer_team"""
ALL["links"] = """select p.match_id, p.team_a, p.team_b, p.seg_start, q.team_a as o_team_a, q.team_b as o_team_b, q.seg_start as o_seg_start,
    greatest(p.seg_start, q.seg_start) - least(p.seg_end, q.seg_end) as lag from seg p join seg q on p.match_id = q.match_id
    and (p.team_a in (q.team_a, q.team_b) or p.team_b in (q.team_a, q.team_b)) and (p.team_a <> q.team_a or p.team_b <> q.team_b)"""
ALL["chev"] = "select *, cast(k % 8 as bigint) as channel, cast(k % 6 as bigint) as guid from ev"

_HASH = "('0x' || substr(sha256({}), 1, 12))::bigint / pow(16, 12)"
_PID = "case when p = 0 then concat('BOT_', match_id) else concat(match_id, '-', player_id) end"
_OWNER = """select i.match_id, coalesce(f.player_id, h.player_id, p.player_id) as replay_owner from ids i
    left join (select match_id, min(player_id) as player_id from players where {flagged} group by match_id) f on f.match_id = i.match_id
    left join (select match_id, player_id from (select match_id, player_id, row_number() over (partition by match_id order by count(*) desc, min(t), player_id) as r from weapons
      group by match_id, player_id) q where r = 1) h on h.match_id = i.match_id
    left join (select match_id, player_id from (select match_id, player_id, row_number() over (partition by match_id order by count(*) desc, min(t), player_id) as r from positions
      group by match_id, player_id) q where r = 1) p on p.match_id = i.match_id"""
_FS_COLS = """fight_id, match_id, team_index, opp_team_index, t0, t_end, players, outcome, multi_team, n_damage_events, hits_dealt, hits_taken,
    round(damage_dealt, 6) as damage_dealt, round(damage_taken, 6) as damage_taken, recorder_involved, has_bots, mutual,
    round(minority_damage_share, 6) as minority_damage_share, engagement_type, round(dist_median_m, 6) as dist_median_m, round(dist_max_m, 6) as dist_max_m, seg_version"""
_L1 = """select 'damage_corr' as gate, case when count(*) >= 5 then round(corr(parsed, game), 6) end as value, count(*) as n from recd
    union all select 'damage_ratio', case when count(*) >= 5 then round(median(parsed / game), 6) end, count(*) from recd"""
_L2 = "select 'position_resolution' as gate, round(avg((player_id is not null)::int), 6) as value, count(*) as n from positions"
_L3 = "select 'clock_offset_s' as gate, round(median(\"offset\"), 6) as value, count(*) as n from downs"
_L4 = "select 'recorder_knock_coverage' as gate, round(avg(covered::int), 6) as value, count(*) as n from cover"
_L5 = "select distinct shape from shaped where shape is not null and shape not in ({})".format(", ".join(f"'{s}'" for s in KNOWN_SHAPES))
_L6 = "select concat(match_id, '.replay') as replay_file from split_matches"

SQL: dict[str, str] = {
    "a1_load_table": "select match_id, t, source, target, magnitude, x, y from damage",
    "a2_finished_matches": "select match_id from matches where rec_other_damage is not null",
    "a4_projection": "select event_id, user_id, event_type from events",
    "a5_pushed_filter": "select event_id, user_id, value from events where event_type = 'purchase'",
    "a6_parquet_sink": "select match_id, player_id, t, team_index from teams",
    "a7_manifest_csv": "select replay_file, sha256, size_bytes, 'local_demos' as source, cast(null as varchar) as notes from files",
    "a8_ledger": """select replay_file, sha256(concat(text, '!')) as sha256, size_bytes, 'backfilled' as action, replay_file as original_file,
          'backfilled: present before manifest existed' as notes from files where doc_id % 7 = 1
        union all select case when act and doc_id % 7 in (0, 1) then concat(replace(replay_file, '.replay', ''), '-', substr(sha256, 1, 8), '.replay') else replay_file end, sha256, size_bytes,
          case when act then 'copied' else 'duplicate' end, replay_file, 'batch' from
          (select *, sha256 not in (select sha256 from files where doc_id % 7 = 0) and sha256 not in (select sha256(concat(text, '!')) from files where doc_id % 7 = 1)
             and row_number() over (partition by sha256 order by replay_file) = 1 as act from files) q""",
    "a9_pending": "select doc_id, lang from documents where doc_id not in (select doc_id from labels)",
    "a10_good_rows": "select row_id, t_ms, eliminated from elims where row_id % 9 <> 0",
    "a10_rejected_lines": "select concat(row_id, ',x,', eliminated) as line from elims where row_id % 9 = 0",
    "b2_coerce": "select row_id, match_id, cast(round_even(try_cast(t_ms as double), 0) as bigint) as t_ms, eliminator, eliminated, flag as knocked, '7' as gun_type from rawelims join flag using (row_id)",
    "b3_parse_bool": "select row_id, flag from flag",
    "b4_validate": """select * from (select 'elims' as "table", 't_ms' as "column", 'nulls' as "check", count(*) as n from rawelims where row_id % 5 = 0
        union all select 'elims', 'knocked', 'nulls', count(*) from flag where flag is null union all select 'elims', 'gun_type', 'missing', 1
        union all select 'elims', 'bogus', 'undeclared', 1 union all select 'elims', 'row_id', 'undeclared', 1) q""",
    "b4_duplicate_keys": """select 'fight_sides' as "table", 'fight_id,team_index' as "column", 'duplicate_keys' as "check", count(*) as n from fs where has_bots""",
    "b5_validation_summary": """select 'teams' as "table", 'ok' as status, count(*) as "rows", 0::bigint as problems from teams union all select 'fight_sides', 'ok', count(*), 0 from fs
        union all select 'elims', 'FAIL', count(*), 3 from elims union all select 'matches', 'FAIL', count(*), 21 from matches union all select 'pokes', 'skip', null, null""",
    "b7_seg_version": "select 'v2-gap10-tol1-grace3-poke10-conv20' as seg_version",
    "b8_segmentation_mismatch": "select distinct fight_id from fs where engagement_type = 'poke' and fight_id not in (select fight_id from segf100)",
    "c1_engagement_filter": "select row_id, match_id, source, target, magnitude from damage where target is not null and source <> target and magnitude > 0",
    "c2_opposing_pairs": "select row_id, match_id, source_team, target_team, team_a, team_b from eng",
    "c3_elims_table": """select match_id, cast(round_even((t_ms / 1000.0::double + 0.0005::double) * 1000, 0) as bigint) as t_ms, eliminator, eliminated,
        case when row_id % 3 <> 0 then knocked else false end as knocked, '7' as gun_type from elims""",
    "c4_known_players": "select row_id, match_id, target from damage where target is not null",
    "c5_structure_hits": "select row_id, match_id, source, magnitude, x, y from damage where target is null and source is not null and magnitude > 0",
    "c6_recorder_involved": "select match_id, t, eliminator, eliminated, knocked from elims where eliminator = 'P00' or eliminated = 'P00'",
    "c7_downed_rows": "select row_id, match_id, player_id from positions where downed",
    "d1_team_at": "select row_id, match_id, source_team, target_team from hits0",
    "d2_hit_distances": "select match_id, row_id as hit, round(dist, 6) as dist from hdist",
    "d3_candidate_states": """select e.row_id, e.match_id, count(*) as candidates, count(*) filter (tool) as holders from
        (select p.row_id, p.match_id, p.spawn_t, q.player_id from parsed p join (select distinct match_id, player_id from positions) q using (match_id) where p.team_index is null) c
        asof left join weapons w on w.match_id = c.match_id and w.player_id = c.player_id and c.spawn_t >= w.t
        join lateral (select c.row_id, c.match_id, coalesce(contains(w.weapon_class, 'BuildingTool'), false) as tool) e on true group by e.row_id, e.match_id""",
    "d4_last_known_flag": "select match_id, player_id, death_time, in_storm from storm",
    "d5_since_damage": "select row_id, match_id, round(since, 6) as since from sdmg",
    "d6_downed_after": "select match_id, victim, round(t, 6) as t, round(\"offset\", 6) as \"offset\" from downs",
    "d7_events_in_fights": "select fight_id, t, eliminator, eliminated, victim_team, killer_team from inside",
    "d8_knock_coverage": "select match_id, t, eliminator, eliminated, in_fight, covered from cover",
    "d9_target_events": "select g.fight_id, e.row_id, e.eliminated from tgt g join elims e on e.match_id = g.match_id and e.eliminated = g.player and e.t >= g.t0 and e.t <= g.t_end + 20",
    "d10_structure_pressure": "select fight_id, round(structure_damage, 6) as structure_damage, structure_hits from pressure_all",
    "d11_hits_of_fights": "select fight_id, match_id, t, source, target, magnitude from hits",
    "d12_left_labels": "select p.fight_id, c.converted_by is not null as converted, c.converted_by from pokes1 p left join conv c using (fight_id)",
    "d13_owner_lookup": "select row_id, match_id, source = 'P00' as by_recorder from damage",
    "d14_decided_fights": "select fight_id, count(*) as hits from hits where fight_id in (select fight_id from outc where outcome <> 'disengage') group by fight_id",
    "d15_unlabelled_documents": "select doc_id from documents where doc_id not in (select doc_id from labels)",
    "d16_link_counts": """select s.match_id, s.team_a, s.team_b, s.seg_start, count(*) filter (l.lag <= 10) as links, round(greatest(min(l.lag), case when min(l.lag) is not null then 0 end), 6) as lag from seg s
        left join links l using (match_id, team_a, team_b, seg_start) group by s.match_id, s.team_a, s.team_b, s.seg_start""",
    "d16_segment_links": "select * replace (round(lag, 6) as lag) from links where lag <= 10",
    "d17_interpolated": """select row_id, match_id, round(case when bt is null then fx when ft is null or ft = bt then bx else bx + (fx - bx) * ((t - bt) / (ft - bt)) end, 6) as x,
        round(case when bt is null then fy when ft is null or ft = bt then "by" else "by" + (fy - "by") * ((t - bt) / (ft - bt)) end, 6) as y from
        (select e.row_id, e.match_id, e.t, b.t as bt, b.x as bx, b.y as "by", f.t as ft, f.x as fx, f.y as fy from (select * from elims) e
         asof left join positions b on b.match_id = e.match_id and b.player_id = e.eliminated and e.t >= b.t
         asof left join positions f on f.match_id = e.match_id and f.player_id = e.eliminated and e.t <= f.t) q""",
    "d18_tracks": """select s.match_id, s.fight_id, s.team_index, s.player_id, p.t, p.x, p.y from (select *, unnest(string_split(players, ';')) as player_id from fs) s
        join positions p on p.match_id = s.match_id and p.player_id = s.player_id and p.t >= s.t0 - 5 and p.t <= s.t_end + 5""",
    "e1_sides": "select match_id, n, team, events, hits_dealt, hits_taken, round(dealt, 6) as dealt, round(taken, 6) as taken, players from side",
    "e2_primary_opponent": "select * from opp1",
    "e3_fight_span": "select match_id, n, min(t) as t0, max(t) as t_end, count(distinct team) as n_teams from dirs group by match_id, n",
    "e4_minority_share": "select s.match_id, s.n, s.team, l.mutual, round(l.minority_damage_share, 6) as minority_damage_share from side s join flevel l on l.match_id = s.match_id and l.n = s.n",
    "e5_fight_distances": "select match_id, n, round(dist_median_m, 6) as dist_median_m, round(dist_max_m, 6) as dist_max_m from fdist",
    "e6_solo_matches": "select * from team_size",
    "e7_first_knocks": "select * from knock1",
    "e8_fight_flags": "select * from fflags",
    "e9_decisive": "select fight_id, match_id, team_index, decisive from fs",
    "e10_poke_pairs": "select fight_id, poker_team, target_team, t0, t_end, round(net_damage, 6) as net_damage, target_players from pair",
    "e11_damage_vs_stats": _L1,
    "e12_non_null_share": "select round(avg((target is not null)::int), 6) as share from damage",
    "e13_median_offset": "select round(median(\"offset\"), 6) as median, count(*) as n_values from downs",
    "e14_gap_quantiles": """select round(quantile_cont(gap, 0.5), 6) as p50, round(quantile_cont(gap, 0.75), 6) as p75, round(quantile_cont(gap, 0.9), 6) as p90, round(quantile_cont(gap, 0.95), 6) as p95,
        round(quantile_cont(gap, 0.99), 6) as p99, count(gap) as n_values from gaps where gap is not null""",
    "e15_outcome_shares": "select outcome, count(*) as n, round(count(*) / (select count(*) from outc), 6) as share from outc group by outcome",
    "e16_bot_teams": "select match_id, team_index, any_bot, all_bot from botteam",
    "e17_match_owner": _OWNER.format(flagged="is_bot"), "e17_most_frequent_owner": _OWNER.format(flagged="false"),
    "e18_class_counts": "select path, count(*) as spawns from builds group by path",
    "e19_fold_pieces": """select match_id, cast(k % 10 as bigint) as piece, cast(null as bigint) as owner_persistent_id,
        arg_max(cast(k % 4 as bigint), (t, event_id)) filter (event_id % 3 <> 0) as team_index, arg_max(100 + event_id % 50, (t, event_id)) filter (event_id % 5 = 0) as max_health,
        arg_max(k % 2 = 0, (t, event_id)) filter (event_id % 4 = 0) as player_placed, min(cast(floor(value) as bigint)) as min_health from ev group by match_id, k % 10""",
    "e20_split_fights": """select fight_id, parts from (select h.fight_id, count(distinct a.n) as parts from hits h join hits5 a on a.row_id = h.row_id group by h.fight_id) q where parts >= 2""",
    "f1_gap_segments": "select match_id, team_a, team_b, seg_start, seg_end, n_hits from seg",
    "f2_parse_pieces": "select row_id, match_id, spawn_t, close_t, material, shape, kind, edited, team_index from parsed",
    "f3_detect_edits": "select row_id, match_id, prev_shape, prev_close_t, is_edit, is_reset from edits",
    "f4_fight_numbers": "select match_id, n, t0 from fight",
    "f5_first_conversion": "select fight_id, round(t_convert, 6) as t_convert from conv",
    "f6_best_candidates": "select row_id, builder from built",
    "f7_hit_gaps": "select match_id, team_a, team_b, t, round(gap, 6) as gap from gaps where gap is not null",
    "f8_held_items": """select row_id, match_id, t, player_id, weapon_class from (select *, lag(weapon_class) over w as b, row_number() over w as r from weapons
        window w as (partition by match_id, player_id order by t, row_id)) q where r = 1 or b is distinct from weapon_class""",
    "f9_start_rank": "select match_id, rank from ranked_starts",
    "f10_history_count": "select date, n_train from dates",
    "g1_components": "select match_id, team_a, team_b, seg_start, seg_end, n, t0, t_end from segf",
    "g2_group_fights": "select match_id, t, source, target, magnitude, fight_id from hits",
    "h1_engagement": "select match_id, t, source, target, magnitude, source_team, target_team, team_a, team_b from eng",
    "h2_outcome_events": "select * from events_k",
    "h2_outcome_events_direct": "select * from events_d",
    "h3_outcomes": "select fight_id, team, outcome from outc_d",
    "h4_engagement_types": "select distinct fight_id, engagement_type from fs",
    "h5_fight_sides": f"select {_FS_COLS} from fs",
    "h6_conversion": "select fight_id, converted_by, converter_team, round(t_convert, 6) as t_convert from conv",
    "h7_storm_death": "select fight_id from stormy",
    "h8_structure_labels": "select fight_id, round(structure_damage, 6) as structure_damage, structure_hits from pressure",
    "h9_pokes": """select p.fight_id, p.match_id, p.poker_team, p.target_team, p.t0, p.t_end, round(p.net_damage, 6) as net_damage, p.target_players, c.converted_by is not null as converted,
        c.converted_by, c.converter_team, round(c.t_convert, 6) as t_convert, p.fight_id in (select fight_id from stormy) as storm_death,
        round(coalesce(s.structure_damage, 0), 6) as structure_damage, coalesce(s.structure_hits, 0) as structure_hits, 'v2-gap10-tol1-grace3-poke10-conv20' as seg_version
        from pokes1 p left join conv c on c.fight_id = p.fight_id left join pressure s on s.fight_id = p.fight_id""",
    "h10_classify": "select row_id, material, shape, kind, edited from classed",
    "h11_builders": "select row_id, builder, round(builder_dist, 6) as builder_dist, builder_source from built",
    "h12_pieces": """select row_id, match_id, spawn_t, path, x, y, z, yaw, close_t, team_index, material, shape, kind, edited, prev_shape, prev_close_t, is_edit, is_reset,
        builder, round(builder_dist, 6) as builder_dist, builder_source from built""",
    "i1_regex_extract": "select row_id, regexp_extract(path, '^PBWA_([A-Z])(\\d)_(.+)_C$', 1) as letter, shape from shaped",
    "i2_name_time": "select match_id, epoch_us(strptime(substr(match_id, 8), '%Y.%m.%d-%H.%M.%S')) as start_us from split_matches",
    "i3_lookup": "select row_id, material from shaped",
    "i4_string_tests": "select row_id, lower(shape) like 'stair%' as stair, contains(shape, 'Large') as large, upper(shape) as upper_shape from shaped",
    "i5_member_lists": "select fight_id, array_to_string(list_sort(list(distinct player_id)), ';') as members from dirs group by fight_id",
    "i6_id_suffix": "select fight_id, team_index, n from fs",
    "i7_distance": "select row_id, round(sqrt(x*x + y*y + z*z) / 100, 6) as metres, round(sqrt(x*x + y*y), 6) as flat from positions",
    "i8_unit_hash": f"select match_id, player_id, {_HASH.format(chr(39) + 'fnf-holdout-v1:' + chr(39) + ' || match_id || ' + chr(39) + '-' + chr(39) + ' || player_id')} as u from roster",
    "i9_iso_time": "select match_id, case when utc_start is not null and day(cast(substr(utc_start, 1, 10) as date)) % 3 <> 0 then epoch_us(cast(utc_start as timestamptz)) end as start_us from split_matches",
    "i10_half_even": "select event_id, cast(round_even(cast(k * 5 as double) / 10, 0) as bigint) as half_even from ev",
    "i11_content_hash": "select doc_id, sha256(text) as sha256 from documents",
    "j1_sorted_hits": "select match_id, t, source, target from hits order by all",
    "j2_sampled_fights": "select fight_id from (select distinct fight_id from fs where recorder_involved) q order by sha256(concat('0:', fight_id)), fight_id limit 12",
    "j3_union_all": """select match_id, eliminated as player_id, t, null::double as death_t from elims where knocked
        union all select match_id, player_id, null, death_time from players where death_time is not null""",
    "j4_except": "select match_id, shape from shaped except select match_id, shape from shaped where team_index is null",
    "j5_first_per_key": "select match_id, fight_id, t0, t_end, multi_team from fights1",
    "k1_held_out": f"""select pid as player_id, not starts_with(pid, 'BOT_') and {_HASH.format("'fnf-holdout-v1:' || upper(pid)")} < 0.2::double as held_out from (select {_PID} as pid from roster) q""",
    "k2_match_start": "select match_id, start_us from starts",
    "k3_chronological_split": """select match_id, case when rank < n - cast(round_even(n * 0.15::double, 0) as bigint) * 2 then 'train'
        when rank < n - cast(round_even(n * 0.15::double, 0) as bigint) then 'val' else 'test' end as split from ranked_starts""",
    "k4_folds": f"""select match_id, cast(floor({_HASH.format("'fnf-folds-v1:' || match_id")} * 5) as bigint) as fold from split_matches""",
    "k5_rolling_origins": "select date as origin, n_train, n_test from dates where n_train >= 10",
    "k5_rolling_membership": """select d.event_id, d.date, case when s.n_train >= 10 then d.date end as test_origin, (select min(x.date) from dates x where x.date > d.date and x.n_train >= 10) as train_from
        from dated d join dates s on s.date = d.date""",
    "l1_damage_gate": f"select *, coalesce(case gate when 'damage_corr' then value >= 0.9 else value between 0.9 and 1.1 end, false) as ok from ({_L1}) q", "l2_position_gate": _L2, "l3_clock_gate": _L3, "l4_coverage_gate": _L4, "l5_unknown_shapes": _L5, "l6_unexported": _L6,
    "l7_quality_report": f"""select *, coalesce(case gate when 'damage_corr' then value >= 0.9 when 'damage_ratio' then value between 0.9 and 1.1 when 'position_resolution' then value >= 0.99
          when 'clock_offset_s' then abs(value) <= 0.05 when 'recorder_knock_coverage' then value >= 0.9 when 'unknown_build_shapes' then value = 0 else true end, false) as ok from
        ({_L1} union all {_L2} union all {_L3} union all {_L4} union all select 'unknown_build_shapes', 0::double, 0
         union all select 'unexported_replays', count(*)::double, count(*) from ({_L6}) q) z""",
    "m2_type_sweep": """select share, round(100 * avg((kind = 'fight')::int), 6) as fight_pct, round(100 * avg((kind = 'pick')::int), 6) as pick_pct, round(100 * avg((kind = 'poke')::int), 6) as poke_pct,
        round(100 * avg((kind = 'pick')::int) filter (decisive), 6) as decided_pick_pct, round(100 * avg((kind = 'poke')::int) filter (not multi_team), 6) as two_team_poke_pct from
        (select s.share, f.decisive, f.multi_team, case when f.mutual and f.minority_damage_share >= s.share then 'fight' when f.decisive then 'pick' else 'poke' end as kind
         from fights1 f cross join (select unnest([0.0::double, 0.05::double, 0.1::double, 0.15::double, 0.2::double, 0.3::double]) as share) s) q group by share""",
    "m2_type_summary": """select engagement_type, count(*) as fights, round(100 * avg((not multi_team)::int), 6) as two_team_pct, round(median(hits_dealt + hits_taken) / 2, 6) as hits_per_side_median,
        round(median(dist_median_m), 6) as dist_median_m from fights1 group by engagement_type""",
    "m4_damage_facts": """select metric, round(value, 6) as value from (
          select 'rows' as metric, count(*)::double as value from damage union all select 'target_null', avg((target is null)::int) from damage
          union all select 'mag0', avg((magnitude = 0)::int) from damage union all select 'self_hits', count(*) filter (source = target) / count(*) from damage
          union all select 'engagement_rows', count(*) from h union all select 'team_resolved', avg((source_team is not null and target_team is not null)::int) from h
          union all select 'friendly', count(*) filter (source_team = target_team) / count(*) filter (source_team is not null and target_team is not null) from h) q""",
    "m4_segments_by_gap": " union all ".join(
        f"select {g}::double as gap, count(*) filter (gap is null or gap > {g}) as segments, count(*) filter (gap is null) as pairs from gaps" for g in (5, 10, 15, 20)),
    "m5_since_damage_report": " union all ".join(
        f"""select '{name}' as knock_group, count(*) as knocks, round(avg((since is null)::int), 6) as no_damage, round(median(since), 6) as p50, round(quantile_cont(since, 0.9), 6) as p90
        from sdmg where knocked and {cond}""" for name, cond in (("recorder", "recorder"), ("all", "true"))),
    "m6_third_party_links": """select w.link_window, count(*) as segments, count(*) filter (l.lag <= w.link_window) as linked, round(count(*) filter (l.lag <= w.link_window) / count(*), 6) as share
        from (select unnest([0.0::double, 5.0::double, 10.0::double, 20.0::double, 30.0::double]) as link_window) w cross join seg s
        left join (select match_id, team_a, team_b, seg_start, min(lag) as lag from links group by all) l using (match_id, team_a, team_b, seg_start) group by w.link_window""",
    "m8_knocks_in_segments": " union all ".join(
        f"""select '{name}' as knock_group, count(*) as knocks, count(*) filter (in_seg) as inside, count(*) filter (not in_seg) as misses,
        count(*) filter (not in_seg and (match_id, team_a, team_b) in (select (match_id, team_a, team_b) from seg)) as misses_elsewhere from inseg where knocked and {cond}"""
        for name, cond in (("recorder", "recorder"), ("all", "true"))),
    "m9_direct_elims": """select 'elims' as metric, count(*)::double as value from placed where not knocked union all select 'direct', count(*) from placed where not knocked and coalesce(first_knock > t, true)
        union all select 'opposing', count(*) from inseg where not knocked and coalesce(first_knock > t, true)
        union all select 'inside', count(*) from inseg where not knocked and coalesce(first_knock > t, true) and in_seg""",
    "m9_bot_shares": """select metric, round(value, 6) as value from (select 'bot_rows' as metric, sum(b) / sum(k) as value from botteam union all select 'teams_any_bot', avg(any_bot::int) from botteam
        union all select 'teams_all_bot', avg(all_bot::int) from botteam
        union all select 'segments_any_bot', avg((coalesce(a.any_bot, false) or coalesce(b.any_bot, false))::int) from seg s left join botteam a on a.match_id = s.match_id and a.team_index = s.team_a
          left join botteam b on b.match_id = s.match_id and b.team_index = s.team_b
        union all select 'segments_all_bot', avg((coalesce(a.all_bot, false) or coalesce(b.all_bot, false))::int) from seg s left join botteam a on a.match_id = s.match_id and a.team_index = s.team_a
          left join botteam b on b.match_id = s.match_id and b.team_index = s.team_b) q""",
    "n1_resolve_players": """select r.row_id, r.match_id, r.channel, coalesce(b.player_id, o.player_id) as player_id from (select event_id as row_id, match_id, t, channel from chev where event_type = 'click') r
        asof left join (select match_id, t, channel, case when event_type = 'view' then guid end as guid from chev where event_type in ('signup', 'view')) l on l.match_id = r.match_id and l.channel = r.channel and r.t >= l.t
        asof left join (select match_id, t, guid, channel from chev where event_type = 'signup') p on p.match_id = r.match_id and p.guid = l.guid and r.t >= p.t
        asof left join (select match_id, t, channel, case when event_type = 'purchase' then player end as player_id from chev where event_type in ('signup', 'purchase')) b on b.match_id = r.match_id and b.channel = p.channel and r.t >= b.t
        asof left join (select match_id, t, channel, case when event_type = 'purchase' then player end as player_id from chev where event_type in ('signup', 'purchase')) o on o.match_id = r.match_id and o.channel = r.channel and r.t >= o.t""",
    "n2_open_close": """select event_id as row_id, match_id, channel, t as spawn_t, case when ne = 'error' then nt end as close_t, case when ne = 'error' then case when nk % 2 = 0 then 'Destroyed' else 'Dormancy' end end as close_reason
        from (select *, lead(event_type) over w as ne, lead(t) over w as nt, lead(k) over w as nk from chev where event_type in ('signup', 'error') window w as (partition by match_id, channel order by t, event_id)) q where event_type = 'signup'""",
}


def _m3() -> tuple[str, dict[str, str]]:
    extra: dict[str, str] = {}
    parts = []
    for c in (10, 20, 30, 45):
        extra.update(conversion_ctes(c, f"_w{c}"))
        parts.append(f"""select {c}::double as conv, count(*) as pokes, round(100 * avg((v.converted_by is not null)::int), 6) as converted_pct,
            round(100 * count(*) filter (v.converted_by = 'poker') / count(*), 6) as poker_pct, round(100 * count(*) filter (v.converted_by = 'third_party') / count(*), 6) as third_party_pct,
            round(100 * count(*) filter (v.converted_by = 'environment') / count(*), 6) as environment_pct, count(*) filter (p.fight_id in (select fight_id from stormy_w{c})) as storm_death,
            count(*) filter (p.fight_id in (select fight_id from pressure)) as structure_pokes from pokes1 p left join conv_w{c} v on v.fight_id = p.fight_id""")
    return " union all ".join(parts), extra


def _m7() -> tuple[str, dict[str, str]]:
    extra: dict[str, str] = {}
    parts = []
    for w in (0, 5, 10):
        s = f"_m{w}"
        extra.update(fights_ctes(10, w, s))
        parts.append(f"""select {w}::double as tol, count(*) as fights, round(avg((k > 2)::int), 6) as multi, max(k)::double as teams_max, round(max(dur), 6) as dur_max,
            round(avg((dur >= 60)::int), 6) as long_share, round(quantile_cont(k, 0.5), 6) as teams_p50, round(quantile_cont(k, 0.9), 6) as teams_p90,
            round(quantile_cont(dur, 0.5), 6) as dur_p50, round(quantile_cont(dur, 0.9), 6) as dur_p90
            from (select match_id, n, count(*)::double as k, max(t_end) - max(t0) as dur from skel{s} group by match_id, n) q""")
    return " union all ".join(parts), extra


def oracle_sql() -> dict[str, str]:
    """Full SQL text per query."""
    h = {"h": "select * from hits0 where target is not null and source <> target and magnitude > 0"}
    out = {name: with_ctes(sql) for name, sql in planned_sql.SQL.items()}
    out |= {name: with_ctes(sql, h if name == "m4_damage_facts" else None) for name, sql in SQL.items()}
    for name, (sql, extra) in {"m1_segmentation_sweep": sweep_sql(), "m3_convert_sweep": _m3(), "m7_merge_windows": _m7()}.items():
        out[name] = with_ctes(sql, extra)
    return out

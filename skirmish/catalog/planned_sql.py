"""DuckDB SQL of the queries in `planned`: definitions they share, and one statement per query."""

from __future__ import annotations

import math
from itertools import accumulate


def _entry(x: str, y: str, vx: str, vy: str, r: str, vr: str) -> tuple[str, str, str]:
    return f"(({vx})^2 + ({vy})^2 - ({vr})^2)", f"(2 * (({x}) * ({vx}) + ({y}) * ({vy}) - ({r}) * ({vr})))", f"(({x})^2 + ({y})^2 - ({r})^2)"


def _slab(a: str, half: int, pick: str, within: str, outside: str) -> str:
    """Where the line enters or leaves the slab of a piece's box on one axis."""
    low, high, step = f"p.{a} - {half} - s.{a}", f"p.{a} + {half} - s.{a}", f"(s.{a}2 - s.{a})"
    return f"case when {step} = 0 then case when {low} <= 0 and {high} >= 0 then {within} else {outside} end else {pick}(({low}) / {step}, ({high}) / {step}) end"


#: Running sums of the Poisson(1) terms.
_STEPS = list(accumulate(math.exp(-1) / math.factorial(i) for i in range(12)))
_FOLLOW = "rows between 1 following and unbounded following"
_TRACK = {c: f"({c} + v{c} * (low - t))" for c in "xy"}
_DONE = "least(1, greatest(0, (t0 - start_shrink) / (finish_shrink - start_shrink)))"

DEFS = {
    "poses": "select *, (row_id * 73 % 360 - 180)::double as yaw from positions",
    "placed_pieces": """select event_id as row_id, match_id, player as builder, t as spawn_t, case event_id % 4 when 3 then null else t + (5 + event_id % 90)::double end as close_t,
        ((event_id * 37) % 2001)::double as x, ((event_id * 53) % 2003)::double as y, ((event_id % 7) * 100)::double as z from ev where event_type in ('view','purchase')""",
    "zones": """select match_id, (60 + 150 * k + n % 7 * 5)::double as start_shrink, (120 + 150 * k + n % 7 * 5)::double as finish_shrink, 2000.0::double / 2 ** k as radius,
        1000.0::double / 2 ** k as next_radius, (800 + (n * 31 + k * 170) % 400)::double as next_x, (800 + (n * 57 + k * 230) % 400)::double as next_y
        from (select match_id, cast(substr(match_id, 2) as int) as n, unnest([0, 1, 2, 3]) as k from ids)""",
    # response times
    "pair_times": """select match_id, least(source, target) as p, greatest(source, target) as q, t, bool_or(source < target) as pq, bool_or(source > target) as qp from eng group by all""",
    "pair_next": f"""select *, lag(t) over w as prev, min(case when qp then t end) over (w {_FOLLOW}) as nqp, min(case when pq then t end) over (w {_FOLLOW}) as npq
        from pair_times window w as (partition by match_id, p, q order by t)""",
    "waits": """select match_id, t, p as attacker, q as victim, nqp as fire_t from pair_next where pq and (prev is null or t - prev >= 2)
        union all select match_id, t, q, p, npq from pair_next where qp and (prev is null or t - prev >= 2)""",
    "wait_next": "select *, lead(t) over (partition by match_id, victim order by t) as next_t from (select distinct match_id, victim, t from waits)",
    "wait_built": """select w.match_id, w.victim, w.t, any_value(w.next_t) as next_t, min(p.spawn_t) as build_t from wait_next w
        left join placed_pieces p on p.match_id = w.match_id and p.builder = w.victim and p.spawn_t > w.t group by w.match_id, w.victim, w.t""",
    "wait_all": "select w.*, b.next_t, b.build_t from waits w join wait_built b using (match_id, victim, t)",
    "moments": """select match_id, attacker, victim, t, t as mt from wait_all
        union select w.match_id, attacker, victim, w.t, p.t from wait_all w join poses p on p.match_id = w.match_id and p.player_id in (w.victim, w.attacker)
          and p.t between w.t and w.t + 10 and (w.next_t is null or p.t < w.next_t)""",
    "looks": """select m.match_id, m.attacker, m.victim, m.t, m.mt, v.yaw, a.x - v.x as dx, a.y - v.y as dy from moments m
        asof join poses v on v.match_id = m.match_id and v.player_id = m.victim and m.mt >= v.t
        asof join poses a on a.match_id = m.match_id and a.player_id = m.attacker and m.mt >= a.t where m.mt - v.t <= 2 and m.mt - a.t <= 2""",
    "turned": """select match_id, attacker, victim, t, min(mt) as turn_t from looks where (dx <> 0 or dy <> 0)
        and least((((yaw - degrees(atan2(dy, dx))) % 360) + 360) % 360, 360 - (((yaw - degrees(atan2(dy, dx))) % 360) + 360) % 360) <= 30.000000001 group by all""",
    "responses": """select match_id, attacker, victim, t, case when fire_t - t <= 10 then fire_t - t end as fire_s,
        case when (next_t is null or build_t <= next_t) and build_t - t <= 10 then build_t - t end as build_s, turn_t - t as turn_s
        from wait_all left join turned using (match_id, attacker, victim, t)""",
    "response_rows": """select victim as player_id, unnest(['fire', 'build', 'turn']) as response, unnest([fire_s, build_s, turn_s]) as latency from responses""",
    # zones
    "phases": """select match_id, (row_number() over w - 1)::int as phase, coalesce(lag(finish_shrink) over w, 0) as opens, coalesce(lead(finish_shrink) over w, finish_shrink + 60) as closes,
        start_shrink, finish_shrink, coalesce(lag(next_x) over w, next_x) as zx, coalesce(lag(next_y) over w, next_y) as zy, radius, next_x, next_y, next_radius
        from zones window w as (partition by match_id order by start_shrink)""",
    "track_points": "select match_id, player_id, t, p.x as x, p.y as y from (select match_id, player_id, t, max({'x': x, 'y': y}) as p from positions group by all)",
    "track_steps": "select *, lead(t) over w as nt, lead(x) over w as nx, lead(y) over w as ny from track_points window w as (partition by match_id, player_id order by t)",
    "track_lines": """select match_id, player_id, t, case when nt - t <= 10 then nt else t end as t_to, x, y, case when nt - t <= 10 then (nx - x) / (nt - t) else 0 end as vx,
        case when nt - t <= 10 then (ny - y) / (nt - t) else 0 end as vy from track_steps""",
    "in_next": "select s.*, z.*, greatest(t, opens) as low, least(t_to, closes) as high from track_lines s join phases z using (match_id) where t_to >= opens and t <= closes",
    "next_abc": "select *, {} as qa, {} as qb, {} as qc from in_next".format(*_entry(f"{_TRACK['x']} - next_x", f"{_TRACK['y']} - next_y", "vx", "vy", "next_radius", "0")),
    "entries": """select match_id, phase, player_id, min(case when low + s <= high then low + s end) as entry_t from (select *, case when qc <= 0 then 0
          when qa > 0 and qb * qb >= 4 * qa * qc and qb < 0 then (-qb - sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) end as s from next_abc) group by all""",
    "in_shrink": """select s.*, z.*, greatest(t, start_shrink) as low, least(t_to, finish_shrink) as high, (next_x - zx) / (finish_shrink - start_shrink) as wx,
        (next_y - zy) / (finish_shrink - start_shrink) as wy, (next_radius - radius) / (finish_shrink - start_shrink) as wr
        from track_lines s join phases z using (match_id) where t_to >= start_shrink and t <= finish_shrink""",
    "shrink_abc": "select *, {} as qa, {} as qb, {} as qc from in_shrink".format(*_entry(
        f"{_TRACK['x']} - (zx + wx * (low - start_shrink))", f"{_TRACK['y']} - (zy + wy * (low - start_shrink))", "vx - wx", "vy - wy", "radius + wr * (low - start_shrink)", "wr")),
    "catches": """select match_id, phase, player_id, min(case when low + s <= high then low + s end) as caught_t from (select *, case when qc > 0 then 0
          when qb * qb < 4 * qa * qc then null when qa > 0 then (-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa)
          when qa < 0 and qb > 0 then (-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) when qa = 0 and qb > 0 then -qc / qb end as s from shrink_abc) group by all""",
    "crossings": "select match_id, phase, player_id, entry_t, caught_t from entries left join catches using (match_id, phase, player_id)",
    "rotations": """select c.match_id, c.phase, a.team_index, z.start_shrink, z.finish_shrink, count(*) as players, count(entry_t) as entered, count(caught_t) as caught,
        case when count(entry_t) = count(*) then max(entry_t) end as entry_t from crossings c join phases z on z.match_id = c.match_id and z.phase = c.phase
        asof join teams a on a.match_id = c.match_id and a.player_id = c.player_id and z.start_shrink >= a.t group by all""",
    "side_zones": """select s.*, z.* exclude (match_id) from (select s.match_id, s.fight_id, s.team_index, s.t0, case when s.t0 - p.t <= 2 then p.x end as x, case when s.t0 - p.t <= 2 then p.y end as y
          from (select match_id, fight_id, team_index, t0, unnest(string_split(players, ';')) as player_id from fs) s
          asof left join positions p on p.match_id = s.match_id and p.player_id = s.player_id and s.t0 >= p.t) s
        asof left join phases z on z.match_id = s.match_id and s.t0 <= z.finish_shrink""",
    # cover
    "team_pieces": """select p.*, coalesce(a.team_index, -1) as team_index from placed_pieces p asof left join teams a on a.match_id = p.match_id and a.player_id = p.builder and p.spawn_t >= a.t
        where p.close_t is null or p.close_t > p.spawn_t""",
    "side_mean": """select s.match_id, s.fight_id, s.team_index, s.opp_team_index, s.t0, avg(case when s.t0 - p.t <= 2 then p.x end) as x, avg(case when s.t0 - p.t <= 2 then p.y end) as y,
          avg(case when s.t0 - p.t <= 2 then p.z end) as z
        from (select match_id, fight_id, team_index, opp_team_index, t0, unnest(string_split(players, ';')) as player_id from fs) s
        asof left join positions p on p.match_id = s.match_id and p.player_id = s.player_id and s.t0 >= p.t group by s.match_id, s.fight_id, s.team_index, s.opp_team_index, s.t0""",
    "side_lines": """select a.*, b.x as x2, b.y as y2, b.z as z2 from side_mean a left join side_mean b on b.fight_id = a.fight_id and b.team_index = a.opp_team_index""",
    "near_pieces": """select s.fight_id, s.team_index, count(*) filter (p.team_index = s.team_index) as own, count(*) filter (p.team_index <> s.team_index) as other from side_lines s
        join team_pieces p on p.match_id = s.match_id and p.spawn_t <= s.t0 and (p.close_t is null or p.close_t > s.t0)
        where (p.x - s.x) ^ 2 + (p.y - s.y) ^ 2 + (p.z - s.z) ^ 2 <= 300.0 ^ 2 group by s.fight_id, s.team_index""",
    "line_pieces": """select s.fight_id, s.team_index, count(*) as n from side_lines s join team_pieces p on p.match_id = s.match_id and p.spawn_t <= s.t0 and (p.close_t is null or p.close_t > s.t0)
        where s.x is not null and s.x2 is not null and greatest(0, {}) <= least(1, {}) group by s.fight_id, s.team_index""".format(
        ", ".join(_slab(a, h, "least", "0", "2") for a, h in zip("xyz", (256, 256, 192))), ", ".join(_slab(a, h, "greatest", "1", "1") for a, h in zip("xyz", (256, 256, 192)))),
    # credits and shrinkage
    "expectations": """select s.*, len(string_split(s.players, ';')) / (len(string_split(s.players, ';')) + len(string_split(o.players, ';'))) as expected from fs s
        join fs o on o.fight_id = s.fight_id and o.team_index = s.opp_team_index""",
    "dealt_by": "select fight_id, source_team as team_index, source as player_id, sum(magnitude) as dealt from hits group by all",
    "dealt_side": "select fight_id, team_index, sum(dealt) as total from dealt_by group by all",
    "credits": """select r.match_id, r.fight_id, r.team_index, r.t0, r.player_id, coalesce(d.dealt, 0) as dealt,
          residual * case when total > 0 then coalesce(d.dealt, 0)::double / total else 1.0::double / n_members end as credit
        from (select *, (outcome = 'win')::int - expected as residual, unnest(string_split(players, ';')) as player_id, len(string_split(players, ';')) as n_members from expectations
              where outcome in ('win', 'loss')) r
        left join dealt_by d on d.fight_id = r.fight_id and d.team_index = r.team_index and d.player_id = r.player_id
        left join dealt_side a on a.fight_id = r.fight_id and a.team_index = r.team_index""",
    "halves": """select player_id, count(*) filter (h = 0) as n0, coalesce(sum(credit) filter (h = 0), 0) as s0, count(*) filter (h = 1) as n1, coalesce(sum(credit) filter (h = 1), 0) as s1
        from (select *, (row_number() over (partition by player_id order by match_id, t0, fight_id, team_index) - 1) % 2 as h from credits) group by player_id""",
    "shrunk": """select k, s0 / (n0 + k) as a, s1 / (n1 + k) as b from halves, (select unnest([0, 1, 2, 5, 10, 20, 50, 100])::double as k) where n0 > 0 and n1 > 0""",
    "k_grid": "select k, count(*) as players, case when stddev_pop(a) > 1e-12 and stddev_pop(b) > 1e-12 then corr(a, b) end as r from shrunk group by k",
    "k_best": "select k, coalesce(r >= 0.5, false) as ok from k_grid order by round(r, 9) desc nulls last, k limit 1",
    "match_days": "select match_id, cast(substr(match_id, 2) as int) * 3 % 200 as day from ids",
    "event_days": "select distinct (day // 10 + 1) * 10 as event_day from match_days",
    # forecasts
    "forecasts": """select match_id, fight_id, team_index, hits_dealt, hits_taken, expected, case outcome when 'win' then 1 when 'loss' then 0 end as won,
        case outcome when 'win' then 2 when 'tie' then 1 else 0 end as gain from expectations""",
    "decided_by": "select match_id, sum(coalesce(won, 0)) as num, count(won) as den from forecasts group by match_id",
    "poisson_steps": "select unnest([{}]) as step".format(", ".join(repr(s) for s in _STEPS)),
    "draws": """select rep, num, den, (select count(*) from poisson_steps where u >= step) as w from (select *,
        ('0x' || substr(sha256('bootstrap-v1:' || rep || ':' || match_id), 1, 12))::bigint::double / 281474976710656.0::double as u from decided_by, (select unnest(range(200)) as rep))""",
    "ratios": "select rep, sum(w * num)::double / nullif(sum(w * den), 0) as ratio from draws group by rep",
    "discounts": "select i, coalesce((select sum(1 / log2(j + 1)) from (select unnest(range(1, 26)) as j) where j <= i), 0) as d from (select unnest(range(26)) as i)",
    **{f"dcg_{name}": f"""select match_id, k, sum(n) as n, sum(g / n * (b.d - a.d)) as v from
        (select *, sum(n) over (partition by match_id order by x desc) - n as before from (select match_id, {col} as x, count(*) as n, sum(gain)::double as g from forecasts group by all)) q
        cross join (select unnest([10, 25]) as k) join discounts a on a.i = least(before, k) join discounts b on b.i = least(before + n, k) group by all"""
       for name, col in (("got", "hits_dealt"), ("best", "gain"))},
    # panes
    "pane_values": """select victim as player_id, day, build_s, case when build_s <= 1e-6 then -2147483648 else ceil(ln(build_s) / {0} - 1e-9)::int end as bucket
        from responses join match_days using (match_id) where build_s is not null""".format(repr(math.log(1.01 / 0.99))),
    "pane_windows": """select player_id, event_day as end_day, bucket, count(*) as n from pane_values join event_days on day < event_day and day >= event_day - 30 group by all""",
    "pane_upto": """select *, sum(n) over (partition by player_id, end_day order by bucket) as upto, sum(n) over (partition by player_id, end_day) as total from pane_windows""",
    "pane_found": """select player_id, end_day, total::bigint as n_values, {} from pane_upto group by player_id, end_day, total""".format(", ".join(
        f"max(case when upto - n <= floor({q} * (total - 1)) and floor({q} * (total - 1)) < upto then case when bucket = -2147483648 then 0 else 2.0::double / {1.01 / 0.99 + 1!r} * power({1.01 / 0.99!r}, bucket) end end) as p{int(q * 100)}"
        for q in (0.25, 0.5, 0.75))),
    # results
    "event_results": """select r.match_id as event_id, m.day, 'list' as source, 'N' || ((p + m.day // 40) % 12) as source_key, r.player_id as who, 'T' || (p % 4) as team_key,
        (case when n % 5 = 0 and p % 4 = 3 then 1 + n % 4 else 1 + (p % 4 + n) % 4 end)::bigint as placement, 4::bigint as field_size, (n + p) % 4 <> 0 as seen
        from (select *, cast(substr(match_id, 2) as int) as n from roster) r join match_days m using (match_id)""",
    "name_days": """select source, source_key, day, case when min(who) = max(who) then min(who) end as player_id from event_results where seen group by all""",
    "name_changes": """select * from (select *, lag(player_id) over w as before, row_number() over w as place from name_days window w as (partition by source, source_key order by day))
        where place = 1 or player_id is distinct from before""",
    "names": "select source, source_key, player_id, day as valid_from, lead(day) over (partition by source, source_key order by day) as valid_to from name_changes",
    "resolved": """select e.event_id, e.day, e.source, e.source_key, e.team_key, n.player_id from event_results e
        left join names n on n.source = e.source and n.source_key = e.source_key and e.day >= n.valid_from and (n.valid_to is null or e.day < n.valid_to)""",
    "team_places": "select event_id, team_key, min(placement) as placement, max(placement) as high, max(field_size) as field_size from event_results group by all",
}

SQL = {
    "p7_pane_quantiles": "select player_id, end_day, n_values, round(p25, 6) as p25, round(p50, 6) as p50, round(p75, 6) as p75 from pane_found",
    "p7_trend": "select player_id, count(*) as windows, round(regr_slope(p50, end_day), 6) as slope from pane_found group by player_id having count(*) >= 2",
    "p8_name_ranges": "select * from names",
    "p8_resolved_results": "select event_id, source_key, day, team_key, player_id from resolved",
    "p8_placement_gate": """select event_id, count(*) as teams, max(field_size) as field_size, max(field_size) - count(distinct placement) as missing, count(*) - count(distinct placement) as repeated,
        count(*) filter (placement not between 1 and field_size) as out_of_range, count(*) filter (placement <> high) as divided,
        count(distinct placement) = max(field_size) and count(*) = max(field_size) and count(*) filter (placement <> high) = 0 as ok from team_places group by event_id""",
    "p8_resolved_gate": "select count(*) as n, round(count(player_id) / count(*), 6) as share, count(player_id) / count(*) >= 0.95 as ok from resolved",
    "p8_player_careers": """select player_id, min(day) as debut_day, max(day) as last_day, count(distinct event_id) as events, arg_max(source_key, (day, source_key)) as display_name
        from resolved where player_id is not null group by player_id""",
    "p4_player_credits": "select fight_id, team_index, player_id, round(dealt, 6) as dealt, round(credit, 6) as credit from credits",
    "p4_shrinkage": "select k, players, round(r, 6) as r from k_grid",
    "p4_values_before": """select event_day, player_id, count(*) as n, round(sum(credit) / (count(*) + any_value(k)), 6) as value, any_value(ok) as ok from credits join match_days using (match_id)
        join event_days on day < event_day and day >= event_day - 90, k_best group by event_day, player_id""",
    "p5_bootstrap": """select (select count(*) from decided_by) as events, round((select sum(num) / sum(den) from decided_by), 6) as estimate, round(quantile_cont(ratio, 0.025), 6) as low,
        round(quantile_cont(ratio, 0.975), 6) as high, count(ratio) as replicates from ratios""",
    "p6_auc": """select sum(won)::bigint as positives, sum(1 - won)::bigint as negatives, round((sum(r) filter (won = 1) - sum(won) * (sum(won) + 1) / 2) / (sum(won) * sum(1 - won)), 6) as auc
        from (select *, rank() over (order by expected) + (count(*) over (partition by expected) - 1) / 2 as r from forecasts where won is not null)""",
    "p6_auc_by_match": """select match_id, sum(won)::bigint as positives, sum(1 - won)::bigint as negatives,
        round((sum(r) filter (won = 1) - sum(won) * (sum(won) + 1) / 2) / nullif(sum(won) * sum(1 - won), 0), 6) as auc
        from (select *, rank() over (partition by match_id order by hits_dealt) + (count(*) over (partition by match_id, hits_dealt) - 1) / 2 as r from forecasts where won is not null)
        group by match_id""",
    "p6_spearman": """select count(*) as n, round(corr(a, b), 6) as rho from (select rank() over (order by hits_dealt) + (count(*) over (partition by hits_dealt) - 1) / 2 as a,
        rank() over (order by hits_taken) + (count(*) over (partition by hits_taken) - 1) / 2 as b from forecasts)""",
    "p6_ndcg": """select match_id, g.n::bigint as rows, case when b.v > 0 then round(g.v / b.v, 6) end as ndcg, k from dcg_got g join dcg_best b using (match_id, k)""",
    "p6_reliability_bins": """select least(floor(expected * 10), 9)::int as bin, count(*) as n, round(avg(expected), 6) as mean_p, round(avg(won), 6) as rate,
        round(avg(won) - avg(expected), 6) as gap from forecasts where won is not null group by 1""",
    "p3_cover_at_start": """select fight_id, team_index, case when x is not null then coalesce(own, 0) end as own_near, case when x is not null then coalesce(other, 0) end as other_near,
        case when x is not null and x2 is not null then coalesce(n, 0) end as "between" from side_lines left join near_pieces using (fight_id, team_index)
        left join line_pieces using (fight_id, team_index)""",
    "p1_hit_responses": "select match_id, attacker, victim, t, round(fire_s, 6) as fire_s, round(build_s, 6) as build_s, round(turn_s, 6) as turn_s from responses",
    "p1_response_quantiles": """select player_id, response, count(*) as waits, count(latency) as answered, round(quantile_cont(latency, 0.25), 6) as p25,
        round(quantile_cont(latency, 0.5), 6) as p50, round(quantile_cont(latency, 0.75), 6) as p75, round(quantile_cont(latency, 0.75) - quantile_cont(latency, 0.25), 6) as iqr
        from response_rows group by player_id, response""",
    "p2_zone_crossings": "select match_id, phase, player_id, round(entry_t, 6) as entry_t, round(caught_t, 6) as caught_t from crossings",
    "p2_rotation_timing": """select match_id, phase, team_index, players, entered, caught, round(entry_t, 6) as entry_t, round(start_shrink - entry_t, 6) as lead_s,
        case when entry_t < start_shrink then 'early' when entry_t <= finish_shrink then 'on_time' else 'late' end as timing from rotations""",
    "p2_fight_zone_context": f"""select fight_id, team_index, phase, round(start_shrink - t0, 6) as to_shrink_s, count(x) as placed,
        round(avg(sqrt((x - (zx + (next_x - zx) * {_DONE})) ^ 2 + (y - (zy + (next_y - zy) * {_DONE})) ^ 2) - (radius + (next_radius - radius) * {_DONE})), 6) as edge_now,
        round(avg(sqrt((x - next_x) ^ 2 + (y - next_y) ^ 2) - next_radius), 6) as edge_next from side_zones group by fight_id, team_index, phase, start_shrink, t0""",
}

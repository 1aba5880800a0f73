"""Pokes on random matches against plain loops."""

from collections import defaultdict

import pytest
from frames import random_tables

from skirmish.plans import fights as fp, pokes as pk
from skirmish.schema import TABLES
from test_fights import plain_fights, team_of

ARGS = ("damage", "teams", "elims", "players", "positions")


@pytest.fixture(scope="module")
def tables():
    return random_tables(matches=9, seed=3, hits=25)


def built(spark, tables, split=False, convert_s=20.0):
    t = tables.frames(spark)
    sides = fp.build_fight_sides(t["damage"], t["teams"], t["elims"], t["players"], t["matches"], poke_convert_s=convert_s, split=False)
    return sides, pk.build_pokes(*[t[n] for n in ARGS], sides, convert_s=convert_s, split=split)


@pytest.fixture(scope="module")
def rows(spark, tables):
    sides, pokes = built(spark, tables)
    return sides.collect(), pokes.collect()


def test_pokes_are_the_fights_of_that_type(rows):
    sides, pokes = rows
    typed = {r["fight_id"] for r in sides if r["engagement_type"] == "poke"}
    assert {r["fight_id"] for r in pokes} == typed and len(pokes) == len(typed) > 10
    assert list(pokes[0].asDict()) == TABLES["pokes"].names


def test_poker_target_and_damage(tables, rows):
    for r in rows[1]:
        hits = plain_fights(tables, r["match_id"])[int(r["fight_id"].split(":")[1])]
        dealt = defaultdict(float)
        for h in hits:
            dealt[h[4:]] += h[3]
        a, b = r["poker_team"], r["target_team"]
        assert dealt[a, b] >= dealt[b, a] and r["net_damage"] == dealt[a, b] - dealt[b, a]
        assert {h[2] for h in hits if h[4:] == (a, b)} <= set(r["target_players"].split(";")) <= {h[2] for h in hits if h[5] == b}
        assert (r["t0"], r["t_end"]) == (min(h[0] for h in hits), max(h[0] for h in hits))


@pytest.mark.parametrize("window", [20.0, 45.0])
def test_conversion_is_the_first_fall_of_a_target_after_the_grace(spark, tables, window):
    pokes = built(spark, tables, convert_s=window)[1].collect()
    for r in pokes:
        low, high = r["t_end"] + fp.GRACE_S, r["t_end"] + window
        falls = [(e[1] / 1000, e[3], e[2]) for e in tables.of("elims", r["match_id"]) if e[3] in r["target_players"].split(";") and low < e[1] / 1000 <= high]
        assert r["converted"] == bool(falls), r
        if falls:
            t = min(f[0] for f in falls)
            ways = set()
            for at, victim, killer in falls:
                if at == t:
                    team = team_of(tables, r["match_id"], killer, at) if killer and killer != victim else None
                    ways.add(("environment", None) if team is None else ("poker", team) if team == r["poker_team"] else ("third_party", team))
            assert r["t_convert"] == pytest.approx(t - r["t_end"]) and (r["converted_by"], r["converter_team"]) in ways, (r, ways)
    assert 0 < sum(r["converted"] for r in pokes) < len(pokes)


def test_storm_deaths_need_the_last_known_flag(tables, rows):
    for r in rows[1]:
        died = False
        for _, p, _, death in tables.of("players", r["match_id"]):
            if p in r["target_players"].split(";") and death is not None and r["t_end"] < death <= r["t_end"] + 20.0:
                known = [(t, flag) for _, q, t, _, _, _, flag in tables.of("positions", r["match_id"]) if q == p and t <= death and flag is not None]
                died |= bool(known) and max(known)[1]
        assert r["storm_death"] == died, r


def test_structure_hits_lie_near_a_target(tables, rows):
    """Each counted hit has no target, comes from the poking team during the poke, and all such hits bound the count."""
    for r in rows[1]:
        could = [d for d in tables.of("damage", r["match_id"]) if d[3] is None and d[4] > 0 and r["t0"] <= d[1] <= r["t_end"]
                 and team_of(tables, r["match_id"], d[2], d[1]) == r["poker_team"]]
        assert 0 <= r["structure_hits"] <= len(could) and r["structure_damage"] <= sum(d[4] for d in could)
        assert (r["structure_hits"] == 0) == (r["structure_damage"] == 0.0)


def test_both_plans_give_the_same_pokes(spark, tables):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(str, built(spark, tables, split=True)[1].collect())) == sorted(map(str, built(spark, tables)[1].collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_sides_of_other_settings_are_refused(spark, tables):
    t = tables.frames(spark)
    with pytest.raises(ValueError, match="segmentation"):
        pk.build_pokes(*[t[n] for n in ARGS], built(spark, tables)[0], gap_s=77.0, split=False).count()

"""Pieces on random builds against plain loops; builder attribution against all candidates."""

import random

import pytest

from skirmish.plans import pieces as pc

BUILD = "match_id string, spawn_t double, path string, x double, y double, z double, yaw double, close_t double, team_index long"
SHAPES = ("Solid", "Floor", "DoorC", "Windows", "StairW", "RoofO", "ArchwayLarge")


def wall(shape="Solid"):
    return f"PBWA_W1_{shape}_C"


def builds(spark, rows):
    return spark.createDataFrame([(m, float(t), p, float(x), 0.0, 0.0, 0.0, c if c is None else float(c), k) for m, t, p, x, c, k in rows], BUILD)


def random_builds(seed, n=240):
    """Pieces in a few slots, closing a moment before or after the next one appears."""
    r = random.Random(seed)
    rows = []
    for m in ("p", "q"):
        for slot in range(12):
            t = r.uniform(1, 20)
            for _ in range(n // 24):
                stay = r.choice([0.5, 2.0, 4.0])
                rows.append((m, round(t, 3), wall(r.choice(SHAPES)), 512 * slot, round(t + stay, 3), r.choice([None, 1, 2])))
                t += stay + r.choice([0.0, 0.05, 0.4, 0.9, 1.1, 3.0])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_edits_follow_a_piece_of_the_same_place_and_kind(spark, seed):
    rows = random_builds(seed)
    empty = lambda schema: spark.createDataFrame([], schema)
    out = pc.build_pieces(builds(spark, rows), empty("match_id string, t double, player_id string, x double, y double, z double"),
                          empty("match_id string, t double, player_id string, team_index long"),
                          empty("match_id string, t double, player_id string, weapon_class string"), split=False).collect()
    slots = {}
    for r in out:
        slots.setdefault((r["match_id"], r["x"], r["kind"]), []).append(r)
    edits = 0
    for same in slots.values():
        same.sort(key=lambda r: r["spawn_t"])
        for before, r in zip([None, *same], same):
            if r["is_edit"] or r["is_reset"]:
                edits += 1
                assert before is not None and r["prev_shape"] == before["shape"] != r["shape"] and r["prev_close_t"] == before["close_t"]
                assert r["prev_close_t"] <= r["spawn_t"] + 1.0 and not (r["is_edit"] and r["is_reset"])
            if r["is_reset"]:
                assert before["edited"] and not r["edited"]
            assert r["builder"] is None and r["builder_dist"] == float("inf")
    assert edits > 10 and {r["kind"] for r in out} == {"wall", "floor", "stair", "cone"}


def test_what_is_no_building_piece_stays_without_kind(spark):
    got = {r["path"]: (r["material"], r["shape"], r["kind"]) for r in pc.classify(builds(spark, [("m", 1, "Tree_C", 0, None, None), ("m", 2, "PBWA_S1_Solid_C", 0, None, 4)])).collect()}
    assert got["Tree_C"] == (None, None, None) and got["PBWA_S1_Solid_C"] == ("brick", "Solid", "wall")


def test_attribution_equals_brute_force_with_one_large_match(spark, split):
    rnd = random.Random(3)
    m = lambda: "hot" if rnd.random() < 0.7 else rnd.choice(["a", "b"])
    players = [f"p{i}" for i in range(7)]
    pos = [(m(), round(rnd.uniform(0, 50), 2), rnd.choice(players), rnd.uniform(0, 2000)) for _ in range(400)]
    pos += [("hot", 25.0, "p1", float(i)) for i in range(150)]  # a burst at one instant
    tms = [(k, 0.0, p, i % 3) for k in ("hot", "a", "b") for i, p in enumerate(players)]
    wps = [(m(), round(rnd.uniform(0, 50), 2), rnd.choice(players), rnd.choice(["DefaultBuildingTool_C", None, "Gun"])) for _ in range(120)]
    bl = [(m(), round(rnd.uniform(0, 50), 2), wall(), rnd.uniform(0, 2000), None, rnd.choice([None, 0, 1, 5])) for _ in range(150)]
    P = spark.createDataFrame(pos, "match_id string, t double, player_id string, x double").selectExpr("*", "0.0D as y", "0.0D as z")
    T = spark.createDataFrame(tms, "match_id string, t double, player_id string, team_index long")
    Wp = spark.createDataFrame(wps, "match_id string, t double, player_id string, weapon_class string")
    pieces = builds(spark, bl).selectExpr("*", "false as is_edit", "false as is_reset")
    got = pc.attribute_builders(pieces, P, T, Wp, split=split).collect()
    assert len(got) == len(bl)
    for r in got:
        k, t = r["match_id"], r["spawn_t"]
        best, n_team = None, 0
        seen = {p for mm, _, p, _ in pos if mm == k}
        cands = []
        for p in seen:
            at = max(((tt, x) for mm, tt, q, x in pos if mm == k and q == p and tt <= t), default=None)
            dist = abs(at[1] - r["x"]) if at else float("inf")
            held = max(((tt, w is not None and "BuildingTool" in w) for mm, tt, q, w in wps if mm == k and q == p and tt <= t), default=(0, False))[1]
            on = next(tm for mm, _, q, tm in tms if mm == k and q == p) == r["team_index"]
            cands.append((on, held, dist, p))
        n_team = sum(c[0] for c in cands)
        best = min((c for c in cands if c[0] or not n_team), key=lambda c: (not c[1], min(c[2], 1e5), c[3]))
        named = n_team > 0 or best[2] <= 800
        assert r["builder"] == (best[3] if named else None) and r["builder_dist"] == pytest.approx(best[2])


def test_predicted_spawns_hand_on_their_time_once(spark):
    """A chain of predictions: each row inherits from the one before it only, and exactly 0.2 s still counts."""
    rows = [("m", 1.0, wall(), 0, 1.5, 1), ("m", 1.7, wall(), 0, 2.0, 1), ("m", 2.125, wall(), 0, 9.0, 1), ("m", 9.25, wall(), 0, None, 1), ("m", 1.6, wall(), 512, 2.0, 1)]
    got = sorted((r["x"], r["spawn_t"], r["close_t"]) for r in pc.parse_pieces(builds(spark, rows)).collect())
    assert got == [(0.0, 1.7, 9.0), (0.0, 9.25, None), (512.0, 1.6, 2.0)]
    apart = [("m", 1.0, wall(), 0, 1.5, 1), ("m", 1.75, wall(), 0, None, 1), ("m", 1.6, wall("Floor"), 0, None, 1)]
    assert pc.parse_pieces(builds(spark, apart)).count() == 3

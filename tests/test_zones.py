"""Zone crossings against finely sampled tracks, exact cases on the edge, and a match in range blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skirmish.plans import zones

ZONES = "match_id string, start_shrink double, finish_shrink double, radius double, next_radius double, next_x double, next_y double"
TRACK = "match_id string, player_id string, t double, x double, y double"


def phases_of(rows, late=60.0):
    rows, out = sorted(rows, key=lambda z: z[1]), []
    for i, (m, start, finish, radius, nr, nx, ny) in enumerate(rows):
        px, py = (rows[i - 1][5], rows[i - 1][6]) if i else (nx, ny)
        out.append(dict(phase=i, opens=rows[i - 1][2] if i else 0.0, closes=rows[i + 1][2] if i + 1 < len(rows) else finish + late,
                        start=start, finish=finish, x=px, y=py, r=radius, nx=nx, ny=ny, nr=nr))
    return out


def sampled(track, phase, step=0.002, max_step=10.0):
    """(entry, caught) by looking at the track every `step` seconds."""
    entry = caught = None
    track = sorted(track)
    for i, (t, x, y) in enumerate(track):
        near = i + 1 < len(track) and track[i + 1][0] - t <= max_step
        t_to = track[i + 1][0] if near else t
        n = max(1, math.ceil((t_to - t) / step))
        for k in range(n + 1):
            at = t + (t_to - t) * k / n
            share = (at - t) / (t_to - t) if t_to > t else 0
            px, py = (x + (track[i + 1][1] - x) * share, y + (track[i + 1][2] - y) * share) if near else (x, y)
            if phase["opens"] <= at <= phase["closes"] and entry is None and math.hypot(px - phase["nx"], py - phase["ny"]) <= phase["nr"]:
                entry = at
            if phase["start"] <= at <= phase["finish"] and caught is None:
                u = (at - phase["start"]) / (phase["finish"] - phase["start"])
                zx, zy = phase["x"] + (phase["nx"] - phase["x"]) * u, phase["y"] + (phase["ny"] - phase["y"]) * u
                if math.hypot(px - zx, py - zy) > phase["r"] + (phase["nr"] - phase["r"]) * u:
                    caught = at
    return entry, caught


def close(a, b, tol=0.01):
    return a is b is None or a is not None and b is not None and abs(a - b) <= tol


@pytest.mark.parametrize("split", [False, True])
def test_crossings_equal_sampled_tracks(spark, split):
    r = random.Random(4)
    rows, tracks = [], {}
    for m in ("a", "b"):
        rows += [(m, 20.0 + 40 * k, 35.0 + 40 * k, 60.0 / 2 ** k, 30.0 / 2 ** k, r.uniform(-20, 20), r.uniform(-20, 20)) for k in range(3)]
        for p in ("p", "q", "s"):
            t, track = r.uniform(0, 5), []
            while t < 150:
                track.append((t, r.uniform(-70, 70), r.uniform(-70, 70)))
                t += r.choice([0.5, 2.0, 6.0, 14.0])
            tracks[m, p] = track
    positions = spark.createDataFrame([(m, p, *x) for (m, p), track in tracks.items() for x in track] + [("a", None, 1.0, 0.0, 0.0), ("a", "p", 30.0, None, 0.0)], TRACK)
    found = zones.zone_crossings(positions, zones.zone_phases(spark.createDataFrame(rows, ZONES)), split=split)
    got = {(x["match_id"], x["player_id"], x["phase"]): (x["entry_t"], x["caught_t"]) for x in found.collect()}
    for (m, p), track in tracks.items():
        for phase in phases_of([z for z in rows if z[0] == m]):
            entry, caught = sampled(track, phase)
            mine = got.get((m, p, phase["phase"]), (None, None))
            assert close(mine[0], entry) and close(mine[1], caught), (m, p, phase, mine, entry, caught)


def roots(spark, fn, cases):
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in cases], "a double, b double, c double")
    return [r[0] for r in df.select(fn(F.col("a"), F.col("b"), F.col("c"))).collect()]


def test_roots_of_every_kind(spark):
    cases = [(1, -5, 6), (1, 5, 6), (-1, 1, 6), (0, -2, 4), (0, 2, 4), (1, 0, 1), (1, -2, 1), (0, 0, 3), (2, 3, -1), (-1, -1, -1), (-1, 3, -2), (0, 1, -4), (0, 0, -1), (0, 0, 0)]
    inside = roots(spark, zones.first_inside, cases)
    assert inside == [2.0, None, 3.0, 2.0, None, None, 1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    outside = roots(spark, zones.first_outside, [(1, -1, -6), (1, 1, -6), (-1, 3, -2), (-1, 1, -1), (0, 2, -4), (0, -2, -4), (0, 0, -4), (1, 1, 2), (0, 0, 0), (1, 0, 0), (-1, 0, -1)])
    assert outside == [3.0, 2.0, 1.0, None, 2.0, None, None, 0.0, None, 0.0, None]


def test_timing_of_teams(spark):
    phases = zones.zone_phases(spark.createDataFrame([("m", 10.0, 20.0, 100.0, 10.0, 0.0, 0.0)], ZONES))
    walk = lambda p, arrive: [("m", p, 0.0, 50.0, 0.0), ("m", p, arrive, 10.0, 0.0)]  # noqa: E731 (on the edge at `arrive`)
    rows = walk("a", 5.0) + walk("b", 8.0) + walk("c", 10.0) + [("m", "d", t, 50.0, 0.0) for t in (0.0, 9.0, 18.0)] + [("m", "e", 0.0, 1.0, 0.0), ("m", "f", 3.0, 0.0, 0.0)]
    teams = spark.createDataFrame([("m", 0.0, p, k) for p, k in zip("abcde", (1, 1, 2, 3, 3))], "match_id string, t double, player_id string, team_index long")
    found = zones.zone_crossings(spark.createDataFrame(rows, TRACK), phases)
    got = {r["team_index"]: r for r in zones.rotation_timing(found, phases, teams).collect()}
    assert set(got) == {1, 2, 3}  # f has no team
    assert (got[1]["timing"], got[1]["entry_t"], got[1]["lead_s"]) == ("early", 8.0, 2.0)
    assert (got[2]["timing"], got[2]["entry_t"]) == ("on_time", 10.0)
    assert (got[3]["timing"], got[3]["entered"], got[3]["players"], got[3]["entry_t"]) == ("late", 1, 2, None) and got[3]["caught"] == 1


def test_edges_at_the_start_of_a_fight(spark):
    phases = zones.zone_phases(spark.createDataFrame([("m", 10.0, 20.0, 100.0, 50.0, 0.0, 0.0), ("m", 30.0, 40.0, 50.0, 10.0, 20.0, 0.0)], ZONES))
    sides = spark.createDataFrame([("m", f"m:{i}", 1, t, "p;q") for i, t in enumerate((5.0, 15.0, 35.0, 41.0))], "match_id string, fight_id string, team_index long, t0 double, players string")
    positions = spark.createDataFrame([("m", "p", t - 1, 60.0, 0.0) for t in (5.0, 15.0, 35.0, 41.0)] + [("m", "q", 1.0, 0.0, 0.0)], TRACK)
    got = {r["fight_id"]: r for r in zones.fight_zone_context(sides, positions, phases).collect()}
    assert [got[f"m:{i}"]["edge_now"] for i in range(3)] == [-40.0, -15.0, 20.0] and [got[f"m:{i}"]["edge_next"] for i in range(3)] == [10.0, 10.0, 30.0]
    assert [got[f"m:{i}"]["to_shrink_s"] for i in range(3)] == [5.0, -5.0, -5.0] and [got[f"m:{i}"]["phase"] for i in range(3)] == [0, 0, 1]
    assert got["m:3"]["phase"] is None and got["m:3"]["edge_now"] is None and got["m:3"]["placed"] == 1
    assert zones.fight_zone_context(sides.limit(0), positions, phases).count() == 0

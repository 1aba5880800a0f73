"""The place index against brute force: rebuilt spots, crowded cubes, lines of every direction, range blocks."""

import random

import pytest
from pyspark.sql import functions as F

from skirmish.plans import cover

PIECES = "match_id string, spawn_t double, close_t double, x double, y double, z double, team_index long"
HALF = (40.0, 40.0, 30.0)


def made_pieces(seed=1):
    r = random.Random(seed)
    rows = []
    for m in ("a", "b"):
        for _ in range(150):
            t = r.randrange(200) / 2
            rows.append((m, t, r.choice([None, t + r.randrange(0, 60) / 2]), r.uniform(-1500, 1500), r.uniform(-1500, 1500), r.uniform(0, 600), r.choice([1, 2, None])))
    for _ in range(400):  # one crowded cube
        t = r.randrange(200) / 2
        rows.append(("a", t, t + 5, r.uniform(0, 200), r.uniform(0, 200), r.uniform(0, 100), 1))
    for _ in range(500):  # one spot, built on again and again
        t = r.randrange(400) / 4
        rows.append(("a", t, t + r.choice([0.0, 0.5, 3.0]), 100.0, 100.0, 50.0, 2))
    return [*rows, ("a", 1.0, None, None, 0.0, 0.0, 1)]


def standing(p, m, t):
    return p[0] == m and p[3] is not None and p[1] <= t and (p[2] is None or p[2] > t) and (p[2] is None or p[2] > p[1])


def meets(a, b, centre, half):
    """Whether the line touches the box: what is left of it after clipping to one axis after the other."""
    low, high = 0.0, 1.0
    for p, q, c, h in zip(a, b, centre, half):
        for sign in (1, -1):
            gap, rate = sign * (p - c) - h, sign * (q - p)  # outside where gap + rate * s > 0
            if rate == 0:
                if gap > 0:
                    return False
            elif rate > 0:
                high = min(high, -gap / rate)
            else:
                low = max(low, -gap / rate)
    return low <= high


@pytest.mark.parametrize("split,dense", [(False, 64), (True, 8)])
def test_counts_equal_brute_force(spark, split, dense):
    pieces = made_pieces()
    r = random.Random(7)
    spot = lambda: (r.choice([100.0, r.uniform(-1500, 1500)]), r.choice([100.0, r.uniform(-1500, 1500)]), r.choice([50.0, r.uniform(0, 600)]))
    asked = [(i, r.choice("ab"), r.randrange(220) / 2, *spot(), *(spot())) for i in range(60)]
    asked += [(100 + i, "a", 50.0, 100.0, 100.0, 50.0, *e) for i, e in enumerate([(100.0, 100.0, 50.0), (140.0, 100.0, 50.0), (100.0, -900.0, 50.0), (-1400.0, 1400.0, 600.0)])]
    asked.append((200, "a", 50.0, None, 0.0, 0.0, 0.0, 0.0, 0.0))
    queries = spark.createDataFrame(asked, "q long, match_id string, t double, x double, y double, z double, x2 double, y2 double, z2 double")
    steps = cover.standing_steps(spark.createDataFrame(pieces, PIECES), split)
    index = cover.PlaceIndex(steps, dense)
    assert len(index.cells) == 3 and index.cells[0].where("dense").count() >= 1
    near = {(x["q"], x["piece_team"]): x["pieces"] for x in cover.pieces_near(queries, steps, index, ["q"], "t", 300.0, split).collect()}
    between = {(x["q"], x["piece_team"]): x["pieces"] for x in cover.pieces_between(queries, steps, index, ["q"], "t", HALF, split).collect()}
    want_near, want_between = {}, {}
    for q, m, t, *at in asked:
        for p in pieces if at[0] is not None else ():
            if standing(p, m, t):
                key = (q, -1 if p[6] is None else p[6])
                if sum((a - b) ** 2 for a, b in zip(at[:3], p[3:6])) <= 300.0 ** 2:
                    want_near[key] = want_near.get(key, 0) + 1
                if meets(at[:3], at[3:], p[3:6], HALF):
                    want_between[key] = want_between.get(key, 0) + 1
    assert near == want_near and between == want_between and len(want_between) > 20


def test_a_crowded_cube_is_not_compared_whole(spark):
    """Queries at its edge meet the places close by, not all of the cube."""
    rows = [("m", 0.0, None, float(x), float(y), float(z), 1) for x in range(0, 512, 16) for y in range(0, 512, 16) for z in (0, 256)]
    steps = cover.standing_steps(spark.createDataFrame(rows, PIECES))
    index = cover.PlaceIndex(steps, 32)
    points = spark.createDataFrame([("m", 1, 1.0, 0.0, 0.0, 0.0)], "match_id string, q long, t double, x double, y double, z double")
    at, met = [F.col(a) for a in "xyz"], []
    test = cover.in_reach(at, 20.0)
    index.pairs(points, cover.cubes_of([a - 20 for a in at], [a + 20 for a in at]), lambda low, high: met.append(1) or test(low, high))
    assert len(met) == 3  # once per level below the first, and the exact one
    assert index.leaves[0].count() == 0 and index.leaves[1].count() + index.leaves[2].count() == len(rows)
    assert cover.pieces_near(points, steps, index, ["q"], "t", 20.0).collect()[0]["pieces"] == 3


def test_sides_of_fights(spark):
    sides = spark.createDataFrame([("m", "m:0", 1, 2, 10.0, "p;q"), ("m", "m:0", 2, 1, 10.0, "s"), ("m", "m:1", 1, 3, 50.0, "p")],
                                  "match_id string, fight_id string, team_index long, opp_team_index long, t0 double, players string")
    positions = spark.createDataFrame([("m", "p", 9.0, 0.0, 0.0, 0.0), ("m", "q", 9.5, 20.0, 0.0, 0.0), ("m", "q", 10.5, 999.0, 0.0, 0.0), ("m", "s", 9.0, 1000.0, 0.0, 0.0)],
                                      "match_id string, player_id string, t double, x double, y double, z double")
    pieces = spark.createDataFrame([("m", 1.0, None, 30.0, 0.0, 0.0, 1), ("m", 1.0, 10.0, 30.0, 0.0, 0.0, 1), ("m", 10.0, None, 500.0, 30.0, 0.0, 2), ("m", 11.0, None, 400.0, 0.0, 0.0, 2),
                                    ("m", 1.0, None, 990.0, 90.0, 0.0, None)], PIECES)
    got = {(r["fight_id"], r["team_index"]): tuple(r)[3:] for r in cover.cover_at_start(sides, positions, pieces, 100.0, HALF).collect()}
    assert got == {("m:0", 1): (1, 0, 2), ("m:0", 2): (0, 1, 2), ("m:1", 1): (None, None, None)}
    assert cover.cover_at_start(sides, positions, pieces.limit(0)).where("own_near + other_near + between = 0").count() == 2

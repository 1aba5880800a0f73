"""Response times against a plain walk over each match, with ties, overlapping waits and a match in range blocks."""

import math
import random

import pytest

from skirmish.plans import latency

EPS = 1e-9


def made(seed, match="m", n=160, players=4):
    """Times on a grid of half seconds, so that equal times and exact windows occur."""
    r = random.Random(seed)
    half = lambda high: r.randrange(high * 2) / 2
    ids = [f"p{i}" for i in range(players)]
    eng = [(match, half(200), *r.sample(ids, 2), 5.0) for _ in range(n)]
    pieces = [(match, r.choice([*ids, None]), half(200)) for _ in range(n // 2)]
    seen = {(r.choice(ids), half(200)) for _ in range(n * 3)}
    poses = [(match, p, t, float(r.randrange(5)), float(r.randrange(5)), r.choice([None, float(r.randrange(-400, 400, 5))])) for p, t in sorted(seen)]
    return eng, pieces, poses


def frames(spark, eng, pieces, poses):
    return (spark.createDataFrame(eng, "match_id string, t double, source string, target string, magnitude double"),
            spark.createDataFrame(pieces, "match_id string, builder string, spawn_t double"),
            spark.createDataFrame(poses, "match_id string, player_id string, t double, x double, y double, yaw double"))


def plain(eng, pieces, poses, quiet=2.0, window=10.0, facing=30.0, age=2.0):
    out = []
    for match in sorted({e[0] for e in eng}):
        hits = sorted({(t, a, v) for m, t, a, v, _ in eng if m == match})
        waits = [(t, a, v) for t, a, v in hits if not any({a, v} == {b, w} and 0 < t - u < quiet for u, b, w in hits)]
        for t, a, v in waits:
            following = [u for u, _, w in waits if w == v and u > t]
            end = min(following, default=math.inf)
            fire = min((u for u, b, w in hits if (b, w) == (v, a) and u > t), default=None)
            build = min((u for m, b, u in pieces if m == match and b == v and u > t), default=None)
            mine = {p: sorted(x for x in poses if x[0] == match and x[1] == p) for p in (a, v)}
            state = lambda p, at: max((x for x in mine[p] if x[2] <= at), key=lambda x: x[2], default=None)
            turn = None
            for at in sorted({t} | {x[2] for p in (a, v) for x in mine[p] if t <= x[2] <= t + window and x[2] < end}):
                sv, sa = state(v, at), state(a, at)
                if sv is None or sa is None or at - sv[2] > age or at - sa[2] > age or sv[5] is None or sv[3:5] == sa[3:5]:
                    continue
                off = abs((sv[5] - math.degrees(math.atan2(sa[4] - sv[4], sa[3] - sv[3])) + 180) % 360 - 180)
                if off <= facing + EPS:
                    turn = at - t
                    break
            ok = lambda u, stop=math.inf: u - t if u is not None and u - t <= window and u <= stop else None
            out.append((match, a, v, t, ok(fire), ok(build, end), turn))
    return sorted(out)


@pytest.mark.parametrize("split", [False, True])
def test_equals_a_plain_walk(spark, split):
    tables = [sum(parts, []) for parts in zip(made(1, "a"), made(2, "b", players=2), made(3, "hot", n=700, players=5))]
    got = latency.hit_responses(*frames(spark, *tables), split=split).collect()
    want = plain(*tables)
    assert sorted(tuple(r) for r in got) == want
    assert all(any(w[i] is not None for w in want) and any(w[i] is None for w in want) for i in (4, 5, 6))


def test_a_piece_answers_the_latest_wait_only(spark):
    eng = [("m", 1.0, "a", "v", 5.0), ("m", 2.0, "b", "v", 5.0), ("m", 2.5, "b", "v", 5.0), ("m", 20.0, "a", "v", 5.0), ("m", 31.0, "v", "a", 5.0)]
    got = {(r["attacker"], r["t"]): tuple(r)[4:] for r in latency.hit_responses(*frames(spark, eng, [("m", "v", 4.0), ("m", "v", 20.0)], [])).collect()}
    # 2.5 is no wait (not quiet), the piece at 20.0 is not after the wait at 20.0 and too late for 2.0, fire at 31.0 is beyond the window
    assert got[("a", 1.0)] == (None, None, None) and got[("b", 2.0)] == (None, 2.0, None) and got[("a", 20.0)] == (None, None, None)
    assert set(got) == {("a", 1.0), ("b", 2.0), ("a", 20.0), ("v", 31.0)}


def test_angles_wrap(spark):
    poses = [("m", "a", 0.0, 0.0, 0.0, None), ("m", "v", 0.0, 10.0, 0.0, 100.0), ("m", "v", 1.5, 10.0, 0.0, -160.0 - 720)]
    row, = latency.hit_responses(*frames(spark, [("m", 1.0, "a", "v", 5.0)], [], poses)).collect()
    assert row["turn_s"] == 0.5  # looking along -160 degrees is 20 off the direction of 180


def test_quantiles_and_empty_tables(spark):
    tables = made(4)
    rows = latency.response_quantiles(latency.hit_responses(*frames(spark, *tables))).collect()
    want = plain(*tables)
    for r in rows:
        values = sorted(w[4 + ["fire", "build", "turn"].index(r["response"])] for w in want if w[2] == r["player_id"] and w[4 + ["fire", "build", "turn"].index(r["response"])] is not None)
        assert r["answered"] == len(values) and r["waits"] == sum(w[2] == r["player_id"] for w in want)
        if values:
            middle = (len(values) - 1) / 2
            assert abs(r["p50"] - (values[math.floor(middle)] + values[math.ceil(middle)]) / 2) < 1e-9
    assert latency.response_quantiles(latency.hit_responses(*frames(spark, [], [], []))).count() == 0

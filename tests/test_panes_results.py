"""Panes against exact percentiles within their error, and names, places and careers against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skirmish.operators.quantiles import percentiles
from skirmish.plans import panes, results


@pytest.mark.parametrize("split", [False, True])
def test_windows_are_within_the_error_of_exact_percentiles(spark, split):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.randrange(100), r.choice([0.0, r.lognormvariate(0, 1.5), r.uniform(0.2, 9), 0.25])) for _ in range(3000)]
    rows += [("hot", 50, r.expovariate(1)) for _ in range(4000)] + [("a", 5, None), ("a", 5, -1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "player string, day int, x double")
    ends = spark.createDataFrame([(d,) for d in (0, 30, 31, 60, 90, 101, 300)], "end_day int")
    stored = panes.daily_panes(df, ["player"], "day", "x")
    qs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = {(x["player"], x["end_day"]): x for x in panes.pane_quantiles(panes.window_panes(stored, ends, ["player"]), ["player", "end_day"], qs, split=split).collect()}
    for end in (0, 30, 31, 60, 90, 101, 300):
        for p in ("a", "b", "hot"):
            values = sorted(x for q, d, x in rows if q == p and d is not None and x is not None and x >= 0 and end - 30 <= d < end)
            assert ((p, end) in got) == bool(values)
            for name, q in qs.items() if values else ():
                exact = values[math.floor(q * (len(values) - 1))]
                assert abs(got[p, end][name] - exact) <= panes.ACCURACY * exact + 1e-6, (p, end, name)
    # the exact operator interpolates between two neighbours: the sketch lies within the error of what they span
    exact = {x["player"]: x["p50"] for x in percentiles(df.where("day >= 30 and day < 60 and x >= 0"), ["player"], "x", {"p50": 0.5}).collect()}
    assert all(abs(got[p, 60]["p50"] - exact[p]) <= 0.02 * exact[p] + 0.05 for p in exact)


def test_panes_of_later_days_are_added(spark):
    df = spark.createDataFrame([("a", d, float(d + 1)) for d in range(20)], "player string, day int, x double")
    first, rest = (panes.daily_panes(df.where(c), ["player"], "day", "x") for c in ("day < 7", "day >= 7"))
    ends = spark.createDataFrame([(20,)], "end_day int")
    one = panes.window_panes(first.unionByName(rest), ends, ["player"]).orderBy("bucket").collect()
    assert one == panes.window_panes(panes.daily_panes(df, ["player"], "day", "x"), ends, ["player"]).orderBy("bucket").collect()


def test_trend_is_a_slope_per_day(spark):
    rows = [("up", 10, 1.0), ("up", 20, 3.0), ("up", 30, 5.0), ("one", 10, 4.0), ("none", 10, None)]
    got = panes.trend(spark.createDataFrame(rows, "player string, end_day int, p50 double"), ["player"]).collect()
    assert [(r["player"], r["windows"], round(r["slope"], 9)) for r in got] == [("up", 3, 0.2)]


SEEN = "source string, source_key string, player_id string, day int"


@pytest.mark.parametrize("split", [False, True])
def test_names_move_between_players(spark, split):
    rows = [("s", "Ace", "p1", 1), ("s", "Ace", "p1", 4), ("s", "Ace", "p2", 6), ("s", "Ace", "p3", 8), ("s", "Ace", "p2", 8), ("s", "Ace", "p2", 9), ("s", "ace", "p9", 2), ("t", "Ace", "p4", 3), ("s", "Ace", None, 5)]
    ranges = results.name_ranges(spark.createDataFrame(rows, SEEN), split)
    got = sorted((r["source"], r["source_key"], r["player_id"], r["valid_from"], r["valid_to"]) for r in ranges.collect() if r["player_id"])
    assert got == [("s", "Ace", "p1", 1, 6), ("s", "Ace", "p2", 6, 8), ("s", "Ace", "p2", 9, None), ("s", "ace", "p9", 2, None), ("t", "Ace", "p4", 3, None)]
    asked = [("s", "Ace", d) for d in (0, 1, 5, 6, 8, 9, 50)] + [("s", "ACE", 5), ("t", "Ace", 2), (None, "Ace", 5)]
    found = results.resolve_results(spark.createDataFrame(asked, "source string, source_key string, day int"), ranges, split).collect()
    assert {(r["source"], r["source_key"], r["day"]): r["player_id"] for r in found} == dict(zip(asked, [None, "p1", "p1", "p2", None, "p2", "p2", None, None, None]))


def test_places_run_from_one_to_the_field(spark):
    def event(e, places, size=None):
        return [(e, f"T{i}", p, len(places) if size is None else size) for i, p in enumerate(places) for _ in range(2)]  # two players a team

    rows = event("good", [2, 1, 3]) + event("gap", [1, 2, 4]) + event("twice", [1, 1, 3]) + event("short", [1, 2], 3) + event("null", [1, None, 3])
    rows += [("divided", "T0", 1, 2), ("divided", "T0", 2, 2), ("divided", "T1", 2, 2)]
    got = {r["event_id"]: tuple(r)[1:] for r in results.placement_gate(spark.createDataFrame(rows, "event_id string, team_key string, placement long, field_size long")).collect()}
    # teams, field, missing, repeated, out of range, divided, ok
    assert got["good"] == (3, 3, 0, 0, 0, 0, True) and got["gap"] == (3, 3, 1, 0, 1, 0, False) and got["twice"] == (3, 3, 1, 1, 0, 0, False)
    assert got["short"] == (2, 3, 1, 0, 0, 0, False) and got["null"][2:] == (1, 0, 1, 1, False) and got["divided"][5:] == (1, False)


def test_gate_and_careers(spark):
    rows = [("e1", 5, "Ace", "p"), ("e2", 3, "Old", "p"), ("e3", 9, "New", "p"), ("e3", 9, "Zed", "q"), ("e4", 9, "Lost", None)]
    df = spark.createDataFrame(rows, "event_id string, day int, source_key string, player_id string")
    assert tuple(results.resolved_gate(df).first()) == (5, 0.8, False) and tuple(results.resolved_gate(df, F.col("event_id") != "e4").first()) == (4, 1.0, True)
    got = {r["player_id"]: tuple(r)[1:] for r in results.player_careers(df).collect()}
    assert got == {"p": (3, 9, 3, "New"), "q": (9, 9, 1, "Zed")}
    assert tuple(results.resolved_gate(df.limit(0)).first()) == (0, None, False)

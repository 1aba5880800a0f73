"""Shrinkage, rank metrics and the bootstrap against plain Python, with ties and one giant event."""

import hashlib
import math
import random
from statistics import correlation

import pytest
from pyspark.sql import functions as F

from skirmish.plans import metrics, skill


def test_credits_share_the_residual(spark):
    sides = spark.createDataFrame([("m", "m:0", 1, 0.0, "a;b", "win"), ("m", "m:0", 2, 0.0, "c;d", "loss"), ("m", "m:1", 1, 5.0, "a", "tie")],
                                  "match_id string, fight_id string, team_index long, t0 double, players string, outcome string")
    hits = spark.createDataFrame([("m", "m:0", "a", 1, 30.0), ("m", "m:0", "b", 1, 5.0), ("m", "m:0", "b", 1, 5.0)],
                                 "match_id string, fight_id string, source string, source_team long, magnitude double")
    got = {(r["fight_id"], r["player_id"]): (r["dealt"], r["credit"]) for r in skill.player_credits(skill.side_residuals(sides, F.lit(0.4)), hits).collect()}
    assert set(got) == {("m:0", p) for p in "abcd"}
    assert all(math.isclose(got["m:0", p][1], w) for p, w in (("a", 0.45), ("b", 0.15), ("c", -0.2), ("d", -0.2)))


@pytest.mark.parametrize("split", [False, True])
def test_reliability_equals_plain_halves(spark, split):
    r = random.Random(3)
    level = {f"p{i}": r.gauss(0, 0.3) for i in range(40)}
    rows = [(p, float(t), level[p] + r.gauss(0, 0.4)) for p in level for t in range(r.choice([1, 3, 8, 60]))]
    r.shuffle(rows)
    found = skill.reliability(skill.half_sums(spark.createDataFrame(rows, "player_id string, t0 double, credit double"), ["t0"], split)).collect()
    want = {}
    for k in skill.SHRINK_GRID:
        pairs = []
        for p in level:
            mine = [c for q, t, c in sorted(rows, key=lambda x: x[1]) if q == p]
            if len(mine) > 1:
                pairs.append(tuple(sum(mine[h::2]) / (len(mine[h::2]) + k) for h in (0, 1)))
        want[k] = (len(pairs), correlation(*zip(*pairs)))
    assert {x["k"]: x["players"] for x in found} == {k: n for k, (n, _) in want.items()}
    assert all(math.isclose(x["r"], want[x["k"]][1], rel_tol=1e-9) for x in found)
    best = skill.best_shrinkage(spark.createDataFrame(found)).collect()[0]
    assert best["k"] == max(want, key=lambda k: (round(want[k][1], 9), -k)) and best["ok"] == (best["r"] >= 0.5)


def test_values_read_strictly_before_and_ninety_days(spark):
    credits = spark.createDataFrame([(f"m{d}", "p", float(d)) for d in (0, 9, 10, 11, 99, 100)] + [("m100", "q", 1.0)], "match_id string, player_id string, credit double")
    days = spark.createDataFrame([(f"m{d}", d) for d in (0, 9, 10, 11, 99, 100)], "match_id string, day int")
    k = spark.createDataFrame([(2.0, 5, 0.7, True)], "k double, players long, r double, ok boolean")
    got = {(r["event_day"], r["player_id"]): (r["n"], r["value"], r["ok"]) for r in skill.values_before(credits, days, spark.createDataFrame([(100,), (0,), (10,), (300,)], "event_day int"), k).collect()}
    assert got == {(100, "p"): (3, (10 + 11 + 99) / 5, True), (10, "p"): (2, 9 / 4, True)}


def rows_with_ties(seed=1):
    r = random.Random(seed)
    rows = [(f"e{i % 7}", float(r.randrange(6)), r.randrange(3), r.random() < 0.4) for i in range(300)]
    return rows + [("giant", float(r.choice([2, 2, 2, 5, r.randrange(9)])), r.choice([0, 0, 1, 3]), r.random() < 0.5) for _ in range(900)] + [("none", 1.0, 0, True), ("e1", None, 1, True)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "event string, score double, gain int, won boolean")


def plain_auc(rows):
    pos, neg = [s for _, s, _, w in rows if w and s is not None], [s for _, s, _, w in rows if not w and s is not None]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_auc(spark):
    rows = rows_with_ties()
    label = F.col("won").cast("int")
    one = metrics.auc(frame(spark, rows), "score", label).collect()[0]
    assert math.isclose(one["auc"], plain_auc(rows)) and one["positives"] + one["negatives"] == len(rows) - 1
    by = {r["event"]: r["auc"] for r in metrics.auc(frame(spark, rows), "score", label, ["event"]).collect()}
    for e in by:
        want = plain_auc([r for r in rows if r[0] == e])
        assert by[e] == want is None or math.isclose(by[e], want)
    assert by["none"] is None


def test_spearman(spark):
    rows = [(s, g) for _, s, g, _ in rows_with_ties(2) if s is not None]

    def ranks(values):
        order = sorted(values)
        place = {v: order.index(v) + (order.count(v) + 1) / 2 for v in set(values)}
        return [place[v] for v in values]

    got = metrics.spearman(frame(spark, rows_with_ties(2)), "score", "gain").collect()[0]
    assert got["n"] == len(rows) and math.isclose(got["rho"], correlation(*map(ranks, zip(*rows))), rel_tol=1e-9)
    flat = metrics.spearman(frame(spark, [("e", 1.0, g, True) for g in (1, 2, 3)]), "score", "gain").collect()[0]
    assert (flat["n"], flat["rho"]) == (3, None) and metrics.spearman(frame(spark, []), "score", "gain").collect()[0]["n"] == 0


@pytest.mark.parametrize("k", [1, 10])
def test_ndcg_averages_over_orders_of_ties(spark, k):
    rows = rows_with_ties(4)
    got = {r["event"]: (r["rows"], r["ndcg"]) for r in metrics.ndcg(frame(spark, rows), "event", "score", "gain", k).collect()}
    for e in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == e and r[1] is not None]

        def dcg(key):
            order, total, at = sorted(mine, key=key, reverse=True), 0.0, 0
            while at < len(order):
                tied = [r for r in order if key(r) == key(order[at])]
                mean = sum(r[2] for r in tied) / len(tied)
                total += sum(mean / math.log2(i + 2) for i in range(at, min(at + len(tied), k)))
                at += len(tied)
            return total

        best = dcg(lambda r: r[2])
        assert got[e][0] == len(mine)
        assert got[e][1] is None if best == 0 else math.isclose(got[e][1], dcg(lambda r: r[1]) / best)


def test_reliability_bins(spark):
    df = spark.createDataFrame([(0.0, 0), (0.05, 1), (0.1, 1), (0.95, 1), (1.0, 0), (None, 1), (0.5, None)], "p double, y int")
    got = {r["bin"]: (r["n"], round(r["mean_p"], 6), r["rate"]) for r in metrics.reliability_bins(df, "p", F.col("y")).collect()}
    assert got == {0: (2, 0.025, 0.5), 1: (1, 0.1, 1.0), 9: (2, 0.975, 0.5)}


def test_bootstrap_weighs_events_alike_on_any_partitioning(spark):
    r = random.Random(6)
    rows = [(f"e{i}", r.randrange(5), r.randrange(1, 9)) for i in range(60) for _ in range(4)]
    df = spark.createDataFrame(rows, "event string, num int, den int")
    run = lambda d: metrics.bootstrap(d, "event", F.col("num"), F.col("den"), 50).collect()[0]
    one = run(df.repartition(1))
    assert one == run(df.repartition(7, "num"))
    sums = {}
    for e, a, b in rows:
        x = sums.setdefault(e, [0, 0])
        x[0] += a
        x[1] += b
    ratios = []
    for rep in range(50):
        weights = {}
        for e in sums:
            u = int(hashlib.sha256(f"{metrics.SALT}:{rep}:{e}".encode()).hexdigest()[:12], 16) / 16 ** 12
            n, total = 0, math.exp(-1)
            while u >= total and n < 12:
                n += 1
                total += math.exp(-1) / math.factorial(n)
            weights[e] = n
        ratios.append(sum(w * sums[e][0] for e, w in weights.items()) / sum(w * sums[e][1] for e, w in weights.items()))
    ratios.sort()
    at = lambda q: ratios[math.floor(q * 49)] + (ratios[math.ceil(q * 49)] - ratios[math.floor(q * 49)]) * (q * 49 % 1)
    assert one["events"] == 60 and one["replicates"] == 50
    assert math.isclose(one["low"], at(0.025)) and math.isclose(one["high"], at(0.975)) and one["low"] < one["estimate"] < one["high"]

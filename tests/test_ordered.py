"""Ordered operators against straightforward Python, in both plans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.operators import ordered as od
from skirmish.operators.components import connected_components
from skirmish.operators.intervals import point_in_interval
from skirmish.operators.quantiles import percentiles


def hot_rows(seed, n=400, keys=("a", "b", "c")):
    """Rows where one key holds more than half of everything."""
    rnd = random.Random(seed)
    return [(i, "hot" if rnd.random() < 0.6 else rnd.choice(keys), round(rnd.uniform(0, 100), 2)) for i in range(n)]


def test_needs_split_looks_at_the_largest_key(spark):
    df = spark.createDataFrame(hot_rows(0), "id long, match_id string, t double")
    assert od.needs_split([df], limit=100) and not od.needs_split([df], limit=1000)
    assert od.needs_split([df, df], limit=400)  # counted over all tables together


@pytest.mark.parametrize("forward,max_age", [(False, None), (False, 1.5), (True, None), (True, 0.8)])
def test_asof(spark, split, forward, max_age):
    right = [(k, t, f"p{i}" if i % 7 else None, i) for i, k, t in hot_rows(1)]
    left = [(i, None if i % 29 == 0 else k, t) for i, k, t in hot_rows(2)] + [(1000, "hot", right[0][1]), (1001, "none", 5.0)]
    r = spark.createDataFrame(right, "k string, t double, p string, seq long")
    lf = spark.createDataFrame(left, "id long, who string, at double")
    out = od.asof(lf, r, left_keys=["who"], right_keys=["k"], left_t="at", payload={"got": "p"}, tiebreak=["seq"], max_age=max_age,
                  forward=forward, split=split)
    assert out.columns == ["id", "who", "at", "got"]

    def want(k, at):
        if forward:
            hits = [x for x in right if x[0] == k and x[1] >= at]
            best = min(hits, key=lambda x: (x[1], x[3]), default=None)
            age = best and best[1] - at
        else:
            hits = [x for x in right if x[0] == k and x[1] <= at]
            best = max(hits, key=lambda x: (x[1], x[3]), default=None)
            age = best and at - best[1]
        return best[2] if best and (max_age is None or age <= max_age) else None

    assert {r["id"]: r["got"] for r in out.collect()} == {i: want(k, at) for i, k, at in left}


def test_gap_segments(spark, split):
    rows = hot_rows(3)
    out = od.gap_segments(spark.createDataFrame(rows, "id long, k string, t double"), ["k"], "t", 0.4, split=split)
    want = {}
    for key in {k for _, k, _ in rows}:
        prev = start = None
        for t, i in sorted((t, i) for i, k, t in rows if k == key):
            start = t if prev is None or t - prev > 0.4 else start
            want[i], prev = start, t
    assert {r["id"]: r["seg_start"] for r in out.collect()} == want


def test_islands_equal_pairwise_links(spark, split):
    rnd = random.Random(4)
    rows = [(i, "hot" if i % 3 else "x", s, s + rnd.choice([0, rnd.uniform(0, 1)])) for i, s in enumerate(rnd.uniform(0, 60) for _ in range(200))]
    out = od.interval_islands(spark.createDataFrame(rows, "id long, k string, s double, e double"), ["k"], "s", "e", 0.25, tiebreak=["id"], split=split)
    label = {r["id"]: (r["k"], r["island_start"]) for r in out.collect()}
    parent = {r[0]: r[0] for r in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in rows:
        for b in rows:
            if a[1] == b[1] and max(a[2], b[2]) - min(a[3], b[3]) <= 0.25:
                parent[find(a[0])] = find(b[0])
    for a in rows:
        for b in rows:
            assert (label[a[0]] == label[b[0]]) == (find(a[0]) == find(b[0]))


def test_neighbours_changes_and_pairs(spark, split):
    rows = hot_rows(5, 300)
    df = spark.createDataFrame([(i, k, t, random.Random(i).choice(["x", "y", None])) for i, k, t in rows], "id long, k string, t double, v string")
    kept = {r["id"] for r in od.change_only(df, ["k"], ["t", "id"], "v", split).collect()}
    data = {r["id"]: r for r in df.collect()}
    want, closes = set(), {}
    ev = df.withColumn("ev", F.when(F.col("v") == "x", "open").when(F.col("v") == "y", "close"))
    for key in {k for _, k, _ in rows}:
        seq = sorted((r["t"], r["id"]) for r in data.values() if r["k"] == key)
        for j, (_, i) in enumerate(seq):
            if j == 0 or data[seq[j - 1][1]]["v"] != data[i]["v"]:
                want.add(i)
        known = [i for _, i in seq if data[i]["v"] is not None]
        for j, i in enumerate(known):
            if data[i]["v"] == "x":
                nxt = known[j + 1] if j + 1 < len(known) else None
                closes[i] = data[nxt]["t"] if nxt is not None and data[nxt]["v"] == "y" else None
    assert kept == want
    paired = od.open_close_pairs(ev, ["k"], ["t", "id"], "t", "ev", "v", split=split).collect()
    assert {r["id"]: r["close_t"] for r in paired} == closes


def test_null_keys_group_together_in_both_plans(spark, split):
    rows = [(i, None if i % 2 else "k", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, k string, t double")
    out = od.Ordered(df, ["k"], ["t"], split).running("n", "sum", F.lit(1)).rows().collect()
    assert {r["id"]: r["n"] for r in out} == {i: i // 2 + 1 for i in range(40)}


def test_interpolation_clamps_at_the_ends(spark, split):
    track = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 100.0), ("a", 20.0, 0.0)], "k string, t double, x double")
    left = spark.createDataFrame([(0, "a", -5.0), (1, "a", 2.5), (2, "a", 10.0), (3, "a", 15.0), (4, "a", 99.0), (5, "b", 1.0)], "id long, k string, at double")
    out = od.interpolate(left, track, left_keys=["k"], right_keys=["k"], left_t="at", columns=["x"], split=split)
    assert {r["id"]: r["x"] for r in out.collect()} == {0: 0.0, 1: 25.0, 2: 100.0, 3: 50.0, 4: 0.0, 5: None}


def test_global_rank(spark, split):
    rows = [(i, round(random.Random(i).uniform(0, 5), 1)) for i in range(300)]
    out = od.global_rank(spark.createDataFrame(rows, "id long, v double"), ["v", "id"])
    want = {i: n for n, (_, i) in enumerate(sorted((v, i) for i, v in rows))}
    assert {r["id"]: r["rank"] for r in out.collect()} == want


def test_point_in_interval_is_independent_of_the_width(spark):
    rnd = random.Random(6)
    pts = [(i, "k", rnd.uniform(-50, 50)) for i in range(150)]
    ivs = [(j, "k", s, s + rnd.uniform(-1, 20)) for j, s in enumerate(rnd.uniform(-50, 50) for _ in range(60))]
    p = spark.createDataFrame(pts, "id long, k string, t double")
    v = spark.createDataFrame(ivs, "iv long, k string, lo double, hi double")
    want = sorted((i, j) for i, _, t in pts for j, _, lo, hi in ivs if lo <= t <= hi)
    for width in (0.7, 13.0, 1000.0):
        got = point_in_interval(p, v, keys=["k"], t="t", lo="lo", hi="hi", width=width)
        assert sorted((r["id"], r["iv"]) for r in got.collect()) == want


@pytest.mark.parametrize("exact_ranks", [True, False])
def test_percentiles_match_numpy(spark, split, exact_ranks):
    rnd = random.Random(7)
    rows = [(("hot" if i % 4 else "g"), rnd.choice([None, round(rnd.expovariate(0.2), 1)])) for i in range(400)] + [("one", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = percentiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, split=exact_ranks).collect()
    for r in out:
        vals = [v for g, v in rows if g == r["g"] and v is not None]
        assert [r["p10"], r["p50"], r["p99"]] == pytest.approx([float(np.quantile(vals, q)) for q in (0.1, 0.5, 0.99)]) and r["n_values"] == len(vals)
    whole = percentiles(df, [], "v", {"p50": 0.5}).first()
    assert whole["p50"] == pytest.approx(float(np.median([v for _, v in rows if v is not None])))


@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_union_find(spark, split, seed):
    """Long chains, so that components cross many blocks and need several rounds."""
    rnd = random.Random(seed)
    n = 300
    vertices = [(float(i), rnd.randrange(3)) for i in range(n)]
    edges = [("m", *vertices[i], *vertices[i + 1]) for i in range(n - 1) if rnd.random() < 0.9]
    edges += [("m", *rnd.choice(vertices), *rnd.choice(vertices)) for _ in range(10)]
    edges += [("other", *vertices[i], *vertices[i + 1]) for i in range(0, 20, 2)]
    df = spark.createDataFrame(edges, "match_id string, us double, ut long, vs double, vt long")
    out = connected_components(df, ["match_id"], ("us", "ut"), ("vs", "vt"), ("rs", "rt"), split).collect()
    assert len(out) == len(edges)
    for m in ("m", "other"):
        parent = {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for e in edges:
            if e[0] == m:
                a, b = find(e[1:3]), find(e[3:5])
                parent[max(a, b)] = min(a, b)
        for r in out:
            if r["match_id"] == m:
                assert (r["rs"], r["rt"]) == find((r["us"], r["ut"]))

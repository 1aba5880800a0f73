"""Fights on random matches against plain loops, and what must hold whatever the data."""

import random
from collections import defaultdict

import pytest
from frames import random_tables
from pyspark.sql import functions as F

from skirmish.operators import ordered as od
from skirmish.plans import explore as ex, fights as fp, sweeps as sw
from skirmish.schema import TABLES, assert_no_label_features, label_only

NAMES = ("damage", "teams", "elims", "players", "matches", "positions")


def team_of(tables, match, player, t):
    known = [(at, team) for m, at, p, team in tables.of("teams", match) if p == player and at <= t]
    return max(known)[1] if known else None


def plain_hits(tables, match):
    """(t, source, target, magnitude, source team, target team) of hits between two known teams."""
    for _, t, s, g, d, *_ in tables.of("damage", match):
        if s and g and s != g and d > 0:
            a, b = team_of(tables, match, s, t), team_of(tables, match, g, t)
            if a is not None and b is not None and a != b:
                yield t, s, g, d, a, b


def plain_fights(tables, match, gap=10.0, tol=1.0):
    """Lists of hits, one per fight: segments of a team pair, linked while they share a team and come close."""
    pairs = defaultdict(list)
    for h in sorted(plain_hits(tables, match), key=lambda h: h[0]):
        runs = pairs[frozenset(h[4:])]
        if runs and h[0] - runs[-1][-1][0] <= gap:
            runs[-1].append(h)
        else:
            runs.append([h])
    segments = [(pair, run) for pair, runs in pairs.items() for run in runs]
    fight = list(range(len(segments)))

    def near(x, y):
        (p, a), (q, b) = segments[x], segments[y]
        return p & q and max(a[0][0], b[0][0]) - min(a[-1][0], b[-1][0]) <= tol

    for x in range(len(segments)):
        for y in range(x):
            if fight[x] != fight[y] and near(x, y):
                old, new = fight[x], fight[y]
                fight = [new if f == old else f for f in fight]
    out = defaultdict(list)
    for f, (_, run) in zip(fight, segments):
        out[f] += run
    return sorted(out.values(), key=lambda hits: (min(h[0] for h in hits), min(min(h[4:]) for h in hits)))


@pytest.fixture(scope="module")
def tables():
    return random_tables()


@pytest.fixture(scope="module")
def sides(spark, tables):
    t = tables.frames(spark)
    return fp.build_fight_sides(*[t[n] for n in NAMES], split=False).collect()


@pytest.mark.parametrize("gap,tol", [(10.0, 1.0), (3.0, 0.0), (0.0, 5.0)])
def test_fights_equal_plain_linking(spark, tables, gap, tol):
    t = tables.frames(spark)
    hits = fp.group_fights(t["damage"], t["teams"], gap, tol, split=False)
    got = {r["fight_id"]: (r["n"], r["a"], r["b"]) for r in hits.groupBy("fight_id").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).collect()}
    want = {f"{m[0]}:{i}": (len(f), min(h[0] for h in f), max(h[0] for h in f)) for m in tables.rows["matches"] for i, f in enumerate(plain_fights(tables, m[0], gap, tol))}
    assert got == want and len(got) > 20


def test_sides_add_up_to_their_hits(tables, sides):
    by = {(r["fight_id"], r["team_index"]): r for r in sides}
    for m, owner in tables.rows["matches"]:
        bots = {p for _, p, is_bot, _ in tables.of("players", m) if is_bot}
        for i, hits in enumerate(plain_fights(tables, m)):
            engaged = {p for h in hits for p in h[1:3]}
            total = sum(h[3] for h in hits)
            for team in {x for h in hits for x in h[4:]}:
                r = by.pop((f"{m}:{i}", team))
                dealt, taken = [h for h in hits if h[4] == team], [h for h in hits if h[5] == team]
                assert (r["hits_dealt"], r["hits_taken"], r["damage_dealt"], r["damage_taken"]) == (len(dealt), len(taken), sum(h[3] for h in dealt), sum(h[3] for h in taken))
                assert set(r["players"].split(";")) == {h[1] for h in dealt} | {h[2] for h in taken} and r["n_damage_events"] == len(dealt) + len(taken)
                assert r["has_bots"] == any(p in bots or p.startswith("BOT_") for p in engaged) and r["recorder_involved"] == (owner in engaged)
                against = defaultdict(float)
                for h in dealt + taken:
                    against[h[5] if h[4] == team else h[4]] += h[3]
                assert against[r["opp_team_index"]] == max(against.values()) and r["multi_team"] == (len({x for h in hits for x in h[4:]}) > 2)
                if not r["multi_team"]:
                    weaker = min(r["damage_dealt"], r["damage_taken"])
                    assert r["minority_damage_share"] == pytest.approx(weaker / total) and r["mutual"] == (weaker > 0)
    assert not by


def plain_events(tables, match):
    """(t, killer team, victim team) of knocks, and of eliminations without an earlier knock where teams are of one."""
    members = defaultdict(set)
    for _, _, p, team in tables.of("teams", match):
        members[team].add(p)
    solo = all(len(x) < 2 for x in members.values())
    knocks = [(e[1], e[3]) for e in tables.of("elims", match) if e[4]]
    for _, ms, a, b, knocked in tables.of("elims", match):
        direct = not knocked and not any(v == b and at <= ms for at, v in knocks)
        if a and b and (knocked or solo and direct):
            yield ms / 1000, team_of(tables, match, a, ms / 1000), team_of(tables, match, b, ms / 1000)


def test_outcomes_of_two_teams_follow_their_first_knocks(tables, sides):
    fights, seen = defaultdict(list), set()
    for r in sides:
        fights[r["fight_id"]].append(r)
    for pair in fights.values():
        if len(pair) != 2:
            continue
        a, b = pair
        first = lambda x, y: min((t for t, k, v in plain_events(tables, a["match_id"]) if (k, v) == (x["team_index"], y["team_index"])
                                  and a["t0"] <= t <= a["t_end"] + fp.GRACE_S), default=None)
        mine, theirs = first(a, b), first(b, a)
        if mine is None and theirs is None:
            want = ("disengage", "disengage")
        elif None not in (mine, theirs) and abs(mine - theirs) <= fp.TIE_S:
            want = ("tie", "tie")
        else:
            want = ("win", "loss") if theirs is None or mine is not None and mine < theirs else ("loss", "win")
        assert (a["outcome"], b["outcome"]) == want, (a, b)
        kind = "fight" if a["minority_damage_share"] >= fp.POKE_MINORITY_SHARE else "poke" if want[0] == "disengage" else "pick"
        assert a["engagement_type"] == b["engagement_type"] == kind
        seen |= {want[0], kind}
    assert {"disengage", "poke", "fight"} <= seen


def test_distances_use_fresh_positions_only(tables, sides):
    checked = 0
    for m, _ in tables.rows["matches"]:
        track = defaultdict(list)
        for _, p, t, x, y, z, _ in tables.of("positions", m):
            track[p].append((t, x, y, z))

        def at(p, t):
            near = max((q for q in track[p] if q[0] <= t), default=None)
            return near[1:] if near and t - near[0] <= fp.HIT_POS_MAX_AGE_S else None

        for i, hits in enumerate(plain_fights(tables, m)):
            apart = [sum((u - v) ** 2 for u, v in zip(a, b)) ** 0.5 / 100 for h in hits if (a := at(h[1], h[0])) and (b := at(h[2], h[0]))]
            for r in sides:
                if r["fight_id"] == f"{m}:{i}":
                    assert r["dist_max_m"] == (pytest.approx(max(apart)) if apart else None)
                    checked += 1
    assert checked == len(sides)


def test_both_plans_and_any_row_order_give_the_same_table(spark, tables):
    t = tables.frames(spark)
    plain = sorted(map(str, fp.build_fight_sides(*[t[n] for n in NAMES], split=False).collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = [t[n].orderBy(F.xxhash64(*t[n].columns)) for n in NAMES]
        assert plain == sorted(map(str, fp.build_fight_sides(*mixed, split=True).collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_by_size_divides_the_matches(spark, tables, monkeypatch):
    counts = sorted(len(tables.of("damage", m)) for m, _ in tables.rows["matches"])
    monkeypatch.setattr(od, "HOT_ROWS", counts[len(counts) // 2])
    t, seen = tables.frames(spark), {}

    def build(part, split):
        seen[split] = {r["match_id"] for r in part["damage"].select("match_id").distinct().collect()}
        return {"n": part["damage"].groupBy("match_id").count()}

    got = {r["match_id"]: r["count"] for r in od.by_size(build, t, ["damage"])["n"].collect()}
    assert got == {m: len(tables.of("damage", m)) for m, _ in tables.rows["matches"]}
    assert seen[True] and seen[False] and not seen[True] & seen[False]


def test_fights_before_a_cut_do_not_see_what_follows(spark, tables):
    cut = 60.0
    t = tables.frames(spark)
    early = {**t, "damage": t["damage"].where(F.col("t") <= cut), "elims": t["elims"].where(F.col("t_ms") <= cut * 1000)}
    ended = F.col("t_end") + 15 < cut
    rows = [sorted(map(str, fp.build_fight_sides(*[x[n] for n in NAMES], split=False).where(ended).collect())) for x in (t, early)]
    assert rows[0] == rows[1] and rows[0]


def test_nothing_to_group(spark, tables):
    t = tables.frames(spark)
    none = fp.build_fight_sides(t["damage"].limit(0), *[t[n] for n in NAMES[1:]], split=False)
    assert none.columns == TABLES["fight_sides"].names and none.count() == 0
    with pytest.raises(ValueError):
        fp.group_fights(t["damage"], t["teams"], overlap_tol_s=-0.5, split=False)


def test_reports_without_rows_or_known_teams_do_not_divide_by_zero(spark, tables):
    t = tables.frames(spark)
    facts = lambda d, k: {r["metric"]: r["value"] for r in ex.damage_facts(d, k).collect()}
    assert facts(t["damage"].limit(0), t["teams"])["target_null"] is None
    unresolved = facts(t["damage"], t["teams"].limit(0))
    assert unresolved["team_resolved"] == 0.0 and unresolved["friendly"] is None
    spans = fp.segment_spans(fp.team_pair_segments(fp.engagement_damage(t["damage"], t["teams"])))
    assert {r["metric"]: r["value"] for r in ex.bot_report(t["teams"], t["players"].limit(0), spans).collect()}["bot_rows"] is None
    # three teams in one exchange: no fight of two teams in any cell
    three = spark.createDataFrame([("m", 0.0, "a", "b", 5.0), ("m", 0.5, "b", "c", 5.0), ("m", 0.5, "a", "c", 5.0)], "match_id string, t double, source string, target string, magnitude double")
    roster = spark.createDataFrame([("m", 0.0, p, i) for i, p in enumerate("abc")], "match_id string, t double, player_id string, team_index long")
    cell = sw.segmentation_sweep(three, roster, t["elims"].limit(0), t["matches"].limit(0), gaps=[5.0], tols=[1.0], graces=[1.0], split=False).first()
    assert (cell["fights"], cell["multi"], cell["win"], cell["disengage"]) == (1, 1.0, 0.0, 0.0)


def test_nearest_links_equal_all_pairs(spark, tables):
    t = tables.frames(spark)
    spans = fp.segment_spans(fp.team_pair_segments(fp.engagement_damage(t["damage"], t["teams"]), 3.0)).cache()
    rows = [tuple(r) for r in spans.select("match_id", "team_a", "team_b", "seg_start", "seg_end").collect()]
    for r in ex.third_party_links(spans).collect():
        linked = sum(any(x[0] == y[0] and x[1:3] != y[1:3] and set(x[1:3]) & set(y[1:3]) and max(x[3], y[3]) - min(x[4], y[4]) <= r["link_window"] for y in rows) for x in rows)
        assert (r["segments"], r["linked"]) == (len(rows), linked)


def test_label_columns_are_known_by_their_marks():
    assert {"outcome", "t_end", "mutual"} <= label_only("fight_sides") and "t0" not in label_only()
    assert_no_label_features(["t0", "players", "opp_team_index"])
    with pytest.raises(ValueError, match="damage_taken"):
        assert_no_label_features(["players", "damage_taken"], "fight_sides")


def test_parameter_set_names():
    assert fp.seg_version(gap_s=0.25, overlap_tol_s=2, grace_s=1.5, poke_minority_share=0.3, poke_convert_s=45) == "v2-gap0.25-tol2-grace1.5-poke30-conv45"


@pytest.mark.parametrize("limit", [0, 10**6])
def test_only_positions_near_a_look_up_are_shuffled(spark, monkeypatch, limit):
    """What is kept follows the hits, not the tracks, and distances stay the same with or without it."""
    r = random.Random(4)
    track = [("m", f"p{i % 40}", i / 40, float(r.randrange(999)), 0.0, 0.0) for i in range(20000)]
    positions = spark.createDataFrame(track, "match_id string, player_id string, t double, x double, y double, z double")
    rows = [("m", i, r.choice([10.0, 10.3, 57.125, 400.0, 499.9, 600.0]), f"p{r.randrange(3)}", r.choice(["p1", "p39", None])) for i in range(50)]
    hits = spark.createDataFrame(rows, "match_id string, hit long, t double, source string, target string")
    asked = hits.select("match_id", F.col("source").alias("player_id"), "t").unionByName(hits.select("match_id", F.col("target").alias("player_id"), "t"))
    kept = fp.fresh_positions(positions, asked, 2.0, limit).count()
    assert kept == len(track) if limit == 0 else kept < 150
    monkeypatch.setattr(fp.fresh_positions, "__defaults__", (limit,))
    at = {(p, t): x for _, p, t, x, _, _ in track}
    last = lambda p, t: next((at[p, u] for u in sorted((u for q, u in at if q == p and u <= t), reverse=True)[:1] if t - u <= 2.0), None)
    for row in fp.hit_distances(hits, positions).collect():
        _, _, t, a, b = rows[row["hit"]]
        x, y = last(a, t), last(b, t) if b else None
        assert row["dist"] == (None if x is None or y is None else abs(x - y) / 100)


@pytest.mark.parametrize("split", [False, True])
def test_link_counts_equal_all_pairs(spark, split):
    r = random.Random(8)
    spans = sorted({("m", *sorted(r.sample(range(4), 2)), r.randrange(120) / 2) for _ in range(150)})
    rows = [(*s, s[3] + r.choice([0.0, 0.5, 4.0, 30.0]), 1) for s in spans]
    df = spark.createDataFrame(rows, "match_id string, team_a long, team_b long, seg_start double, seg_end double, n_hits long")
    lag = lambda a, b: max(a[3], b[3]) - min(a[4], b[4])
    for window in (0.0, 5.0):
        got = {(x["team_a"], x["team_b"], x["seg_start"]): (x["links"], x["lag"]) for x in ex.link_counts(df, window, split).collect()}
        for a in rows:
            others = [lag(a, b) for b in rows if b[1:3] != a[1:3] and set(b[1:3]) & set(a[1:3])]
            assert got[a[1:4]] == (sum(x <= window for x in others), max(0.0, min(others)) if others else None)


# ---------------------------------------------------------------------------------------------- boundaries, one by one
HIT = "match_id string, t double, source string, target string, magnitude double, x double, y double"
ELIM = "match_id string, t_ms long, eliminator string, eliminated string, knocked boolean"


def one_match(spark, hits, elims=(), teams=((0.0, "a", 1), (0.0, "a2", 1), (0.0, "b", 2), (0.0, "b2", 2), (0.0, "c", 3)), **kw):
    """fight_sides of a match given by hand, by team."""
    f = {"damage": spark.createDataFrame([("m", *h, 0.0, 0.0) for h in hits], HIT), "elims": spark.createDataFrame([("m", *e) for e in elims], ELIM),
         "teams": spark.createDataFrame([("m", *x) for x in teams], "match_id string, t double, player_id string, team_index long"),
         "players": spark.createDataFrame([("m", p, False, None) for p in "abc"], "match_id string, player_id string, is_bot boolean, death_time double"),
         "matches": spark.createDataFrame([("m", "a")], "match_id string, replay_owner string")}
    rows = fp.build_fight_sides(f["damage"], f["teams"], f["elims"], f["players"], f["matches"], **kw).collect()
    return {(r["fight_id"], r["team_index"]): r for r in rows}


@pytest.mark.parametrize("split", [False, True])
def test_a_step_of_exactly_the_gap_stays_in_one_segment(spark, split):
    hits = [(0.0, "a", "b", 5.0), (10.0, "a", "b", 5.0), (20.0, "b", "a", 5.0), (30.001, "a", "b", 5.0)]
    got = one_match(spark, hits, split=split)
    assert sorted((r["fight_id"], r["t0"], r["t_end"]) for r in got.values() if r["team_index"] == 1) == [("m:0", 0.0, 20.0), ("m:1", 30.001, 30.001)]


def test_overlap_of_exactly_the_tolerance_links(spark):
    linked = one_match(spark, [(0.0, "a", "b", 5.0), (1.0, "a", "c", 5.0)])
    apart = one_match(spark, [(0.0, "a", "b", 5.0), (1.001, "a", "c", 5.0)])
    assert {k[0] for k in linked} == {"m:0"} and {k[0] for k in apart} == {"m:0", "m:1"}


def test_first_falls_within_the_tie_window(spark):
    hits = [(0.0, "a", "b", 5.0), (5.0, "b", "a", 5.0)]
    tie = one_match(spark, hits, [(6000, "a", "b", True), (7000, "b", "a", True)])
    after = one_match(spark, hits, [(6000, "a", "b", True), (7001, "b", "a", True)])
    assert {k[1]: r["outcome"] for k, r in tie.items()} == {1: "tie", 2: "tie"}
    assert {k[1]: r["outcome"] for k, r in after.items()} == {1: "win", 2: "loss"}
    grace = one_match(spark, hits, [(8000, "a", "b", True)])
    late = one_match(spark, hits, [(8001, "a", "b", True)])
    assert grace["m:0", 1]["outcome"] == "win" and late["m:0", 1]["outcome"] == "disengage"


def test_direct_eliminations_count_in_solo_matches_only(spark):
    hits, elims = [(0.0, "a", "b", 5.0), (5.0, "b", "a", 5.0)], [(5000, "a", "b", False)]
    solo = ((0.0, "a", 1), (0.0, "b", 2), (0.0, "c", 3))
    assert one_match(spark, hits, elims, solo)["m:0", 1]["outcome"] == "win"
    assert one_match(spark, hits, elims)["m:0", 1]["outcome"] == "disengage"
    assert one_match(spark, hits, elims, direct_elim_all_modes=True)["m:0", 1]["outcome"] == "win"
    # a knock at the same time makes it no direct one; a later knock does not
    assert one_match(spark, hits, [(5000, "a", "b", False), (5000, "c", "b", True)], solo)["m:0", 1]["outcome"] == "disengage"
    assert one_match(spark, hits, [(5000, "a", "b", False), (9500, "c", "b", True)], solo)["m:0", 1]["outcome"] == "win"


def test_equal_opponents_are_equal_in_any_order_of_rows(spark):
    """0.1 + 0.2 is more than 0.3 in doubles: the totals are equal, so the lowest opponent counts."""
    hits = spark.createDataFrame([("m", 0, 1.0, 7, 2, "a", "c", 0.1), ("m", 0, 2.0, 2, 7, "c", "a", 0.2), ("m", 0, 3.0, 7, 1, "a", "b", 0.3)],
                                 "match_id string, n long, t double, source_team long, target_team long, source string, target string, magnitude double")
    rows = {r["team"]: r["opp"] for r in fp.sum_sides(fp.side_members(hits)).collect()}
    assert rows == {7: 1, 1: 7, 2: 7}
    huge = hits.withColumn("magnitude", F.when(F.col("t") == 2.0, F.lit(float("inf"))).otherwise(F.col("magnitude")))
    assert {r["team"]: r["opp"] for r in fp.sum_sides(fp.side_members(huge)).collect()} == {7: 2, 1: 7, 2: 7}


def test_sides_name_the_opponent_that_sums_of_doubles_name(spark):
    """As in SQL: 0.1 + 0.2 is more than 0.3, whatever the order of the two."""
    teams = [("m", 0.0, p, i) for i, p in ((7, "a"), (1, "b"), (2, "c"))]
    for first, second in ((0.1, 0.2), (0.2, 0.1)):
        damage = spark.createDataFrame([("m", 1.0, "a", "c", first, 1), ("m", 2.0, "c", "a", second, 2), ("m", 3.0, "a", "b", 0.3, 3)],
                                       "match_id string, t double, source string, target string, magnitude double, row_id long")
        sides = fp.build_fight_sides(damage, spark.createDataFrame(teams, "match_id string, t double, player_id string, team_index long"),
                                     spark.createDataFrame([], "match_id string, t_ms long, eliminator string, eliminated string, knocked boolean"),
                                     spark.createDataFrame([], "match_id string, player_id string, is_bot boolean, death_time double"),
                                     spark.createDataFrame([], "match_id string, replay_owner string"))
        assert {r["team_index"]: r["opp_team_index"] for r in sides.collect()} == {7: 2, 1: 7, 2: 7}


def test_larger_data_means_more_tasks_not_larger_ones(spark):
    """Adaptive execution would merge partitions up to 64 MB, about 2 GB of sort memory in one task."""
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
    few = spark.range(4_000_000).select(F.xxhash64("id").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("w"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        assert few.repartition("v").rdd.getNumPartitions() >= 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_the_copies_of_a_sweep_make_more_tasks_not_larger_ones(spark, monkeypatch):
    """Tasks follow the rows of all settings; laid out by shuffled bytes, each took every copy of its matches. Results stay the same."""
    t = random_tables(matches=12, seed=7, hits=30).frames(spark)
    hits = fp.segmented_hits(t["damage"], t["teams"])

    def run():
        sweep = sw.segmentation_sweep(t["damage"], t["teams"], t["elims"], t["matches"], gaps=[5.0, 10.0], tols=[0.0, 2.0], graces=[1.0, 3.0], split=False)
        return [sorted(map(tuple, df.collect())) for df in (sweep, sw.merge_window_report(hits, split=False))]

    want, stored, store = run(), {}, fp.materialize

    def spy(df, label):
        out = store(df, label)
        stored.setdefault(label, []).append(len(out.inputFiles()))
        return out

    for module in (fp, sw):
        monkeypatch.setattr(module, "materialize", spy)
    monkeypatch.setattr(fp, "TASK_ROWS", 20)
    monkeypatch.setattr(sw, "FEW_KNOCKS", 0)  # the sides are laid out for the knocks, too
    assert run() == want and len(want[0]) == 8
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = {k: min(stored[k]) for k in ("sweep-spans", "linked", "sweep-sides", "sweep-outcomes", "merge-windows") if min(stored[k]) <= shuffles}
    assert not few, few

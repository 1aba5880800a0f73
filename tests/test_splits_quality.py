"""Splits, gates, owners, and the end-to-end table build."""

import hashlib

import pytest
from pyspark.sql import functions as F

from skirmish.plans import identity, quality as ql, splits as sp
from skirmish.plans.tables import build_and_write
from skirmish.schema import PROCESSED
from skirmish.session import scratch_path
from skirmish.sources.tables import read_table

from test_schema_sources import write


def test_unit_hash_is_the_documented_number(spark):
    ids = spark.createDataFrame([(f"{i:032X}",) for i in range(5000)], "id string")
    row = ids.select("id", sp.unit_hash("salt", "id").alias("u")).where("id like '%F'").first()
    assert row["u"] == int(hashlib.sha256(f"salt:{row['id']}".encode()).hexdigest()[:12], 16) / 16**12


def test_holdout_share_follows_the_fraction_and_spares_bots(spark):
    ids = spark.range(4000).select(F.md5(F.col("id").cast("string")).alias("id"))
    shares = ids.select(*[F.avg(sp.is_held_out_player("id", frac=f).cast("int")).alias(f"f{i}") for i, f in enumerate((0.05, 0.2, 0.5))],
                        F.bool_and(sp.is_held_out_player("id") == sp.is_held_out_player(F.upper("id"))).alias("same")).first()
    assert shares["same"] and all(abs(shares[f"f{i}"] - f) < 0.03 for i, f in enumerate((0.05, 0.2, 0.5)))
    nested = ids.where(sp.is_held_out_player("id", frac=0.05) & ~sp.is_held_out_player("id", frac=0.2)).count()
    assert nested == 0  # a larger share holds the smaller one
    special = spark.createDataFrame([("BOT_x9",), (None,), ("x9",)], "id string").select(sp.is_held_out_player("id", frac=1.0).alias("h"))
    assert [r["h"] for r in special.collect()] == [False, False, True]


def test_chronological_split_has_no_overlap_in_time(spark):
    m = spark.range(97).selectExpr("concat('r', id) as match_id", "date_format(timestamp_seconds(1700000000 + (id * 7919 % 97) * 3600), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as utc_start")
    rows = sp.chronological_split(m, val_frac=0.1, test_frac=0.25).collect()
    by = {s: sorted(r["start"] for r in rows if r["split"] == s) for s in ("train", "val", "test")}
    assert sum(map(len, by.values())) == 97 and abs(len(by["test"]) - 24) <= 1 and abs(len(by["val"]) - 10) <= 1
    assert by["train"][-1] < by["val"][0] and by["val"][-1] < by["test"][0]


def test_match_start_prefers_utc_and_unknown_goes_last(spark):
    m = spark.createDataFrame([("x-2026.01.01-00.00.00", "2026-05-01T10:00:00Z"), ("x-2026.02.30-00.00.00", None), ("x-2026.03.01-01.02.03", "junk"),
                               ("none", None), ("y", "2025-01-01T00:00:00.1234567Z")], "match_id string, utc_start string")
    got = {r["match_id"]: r["s"] for r in sp.match_start(m).select("match_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("s")).collect()}
    assert got == {"x-2026.01.01-00.00.00": "2026-05-01 10:00:00", "x-2026.02.30-00.00.00": None, "x-2026.03.01-01.02.03": "2026-03-01 01:02:03",
                   "none": None, "y": "2025-01-01 00:00:00"}
    rows = {r["match_id"]: r["split"] for r in sp.chronological_split(m, val_frac=0.2, test_frac=0.4).collect()}
    assert rows["none"] == rows["x-2026.02.30-00.00.00"] == "test" and rows["y"] == "train"


def test_folds_are_even_and_by_match(spark):
    df = spark.range(3000).selectExpr("concat('k', id % 1500) as m").select("m", sp.cross_fit_fold("m").alias("f"))
    assert df.groupBy("m").agg(F.count_distinct("f").alias("n")).where("n > 1").count() == 0
    sizes = [r["count"] for r in df.groupBy("f").count().collect()]
    assert len(sizes) == 5 and min(sizes) > 450


def test_rolling_origins(spark):
    ev = spark.createDataFrame(list(zip("abcdef", ["2026-01-01"] * 2 + ["2026-01-08"] * 2 + ["2026-01-15"] * 2)), "event_id string, date string")
    origins = sp.rolling_origins(ev, 2).orderBy("origin").collect()
    assert [tuple(r) for r in origins] == [("2026-01-08", 2, 2), ("2026-01-15", 4, 2)]
    members = sp.rolling_membership(ev, 2)
    for origin, train, test in (("2026-01-08", "ab", "cd"), ("2026-01-15", "abcd", "ef")):
        rows = sp.events_of_origin(members, F.lit(origin)).collect()
        assert {r["event_id"] for r in rows if r["role"] == "train"} == set(train) and {r["event_id"] for r in rows if r["role"] == "test"} == set(test)


def test_damage_gate(spark):
    n = 6
    damage = spark.createDataFrame([(f"m{i}", "O", "X", 10.0 * i) for i in range(n)] + [("m1", "O", "O", 99.0), ("m1", "O", None, 99.0), ("m1", "Q", "X", 99.0)],
                                   "match_id string, source string, target string, magnitude double")
    matches = spark.createDataFrame([(f"m{i}", "O", 10 * i, None if i % 2 else 0) for i in range(n)] + [("none", "O", None, None), ("idle", "O", 5, None)],
                                    "match_id string, replay_owner string, rec_weapon_damage long, rec_other_damage long")
    got = {r["gate"]: (r["value"], r["n"]) for r in ql.damage_vs_stats(damage, matches).collect()}
    assert got["damage_ratio"] == (1.0, 6) and got["damage_corr"][1] == 6 and 0.9 < got["damage_corr"][0] < 1.0
    few = {r["gate"]: (r["value"], r["n"]) for r in ql.damage_vs_stats(damage, matches.where("match_id < 'm2'")).collect()}
    assert few == {"damage_corr": (None, 2), "damage_ratio": (None, 2)}


def test_clock_offset(spark):
    e = spark.createDataFrame([("m", 10000, "a", True), ("m", 20000, "B", True), ("m", 30000, "c", True), ("m", 40000, "A", False)],
                              "match_id string, t_ms long, eliminated string, knocked boolean")
    p = spark.createDataFrame([("m", 10.02, "A", True), ("m", 4.9, "A", True), ("m", 15.0, "B", True), ("m", 35.0, "C", True), ("m", 9.0, "A", None)],
                              "match_id string, t double, player_id string, downed boolean")
    rows = {r["victim"]: round(r["offset"], 6) for r in ql.downed_offsets(e, p, split=False).collect()}
    assert rows == {"A": 0.02, "B": -5.0}  # exactly five before counts, exactly five after does not
    assert tuple(ql.clock_offset(e, p, split=False).first())[1:] == (pytest.approx(-2.49), 2)
    assert tuple(ql.clock_offset(e, p.where("false"), split=False).first()) == ("clock_offset_s", None, 0)


def test_unknown_shapes_and_unexported(spark):
    cls = spark.createDataFrame([("PBWA_W1_Solid_C",), ("PBWA_M3_Spiral_C",), ("Other",), (None,)], "path string")
    assert [r["shape"] for r in ql.unknown_build_shapes(cls).collect()] == ["Spiral"]
    man = spark.createDataFrame([("a.replay",), ("b.replay",)], "replay_file string")
    assert [r["replay_file"] for r in ql.unexported_replays(man, spark.createDataFrame([("a",)], "match_id string")).collect()] == ["b.replay"]


def test_owner_chain(spark):
    ids = spark.createDataFrame([("f",), ("h",), ("p",), ("n",)], "match_id string")
    players = spark.createDataFrame([("f", "Z", True), ("f", "A", False), ("h", "A", False)], "match_id string, player_id string, is_replay_owner boolean")
    health = spark.createDataFrame([("f", "A", 0.0), ("h", "B", 1.0), ("h", "C", 0.5), ("h", "C", 2.0), ("h", "B", 3.0), ("h", None, 0.0)],
                                   "match_id string, player_id string, t double")
    pos = spark.createDataFrame([("p", "D", 0.0), ("h", "E", 0.0)], "match_id string, player_id string, t double")
    got = {r["match_id"]: r["replay_owner"] for r in identity.match_owners(ids, players, health, pos).collect()}
    assert got == {"f": "Z", "h": "C", "p": "D", "n": None}


def test_channel_reset_hides_the_old_player(spark, split):
    make = spark.createDataFrame
    opens = make([("m", 0.0, 100, 7), ("m", 20.0, 200, 9)], "match_id string, t double, guid long, channel long")
    links = make([("m", 1.0, 3, 100), ("m", 10.0, 3, None), ("m", 21.0, 3, 200)], "match_id string, t double, channel long, state_guid long")
    states = make([("m", 0.5, 7, "A"), ("m", 20.5, 9, "B"), ("m", 0.5, 3, None)], "match_id string, t double, channel long, player_id string")
    reads = make([("m", t, 3) for t in (0.7, 2.0, 10.0, 15.0, 22.0)] + [("m", 5.0, 7)], "match_id string, t double, channel long")
    got = {(r["t"], r["channel"]): r["player_id"] for r in identity.resolve_players(reads, links, states, opens, split).collect()}
    assert got == {(0.7, 3): None, (2.0, 3): "A", (10.0, 3): None, (15.0, 3): None, (22.0, 3): "B", (5.0, 7): "A"}


def test_fold_pieces(spark):
    u = spark.createDataFrame([("m", 1, 0.0, 0, 5, None, 100, True, 90), ("m", 1, 1.0, 1, None, 3, None, None, 40), ("m", 1, 2.0, 2, None, 4, 150, False, 60)],
                              "match_id string, piece long, t double, seq long, owner_persistent_id long, team_index long, max_health long, player_placed boolean, health long")
    assert tuple(identity.fold_pieces(u).first()) == ("m", 1, 5, 4, 150, False, 40)


def test_export_folders_to_processed_tables(spark, tmp_path):
    d = f"{tmp_path}/telemetry/m1"
    write(f"{d}/meta.csv", "branch,replay_owner\nb,A\n")
    write(f"{d}/players.csv", "player_id,is_bot,is_replay_owner\nA,0,0\nB,0,0\n")
    write(f"{d}/teams.csv", "t,player_id,team_index\n0,A,1\n0,B,2\n")
    write(f"{d}/damage.csv", "t,source_channel,source,target,magnitude,x,y,z\n1,1,A,B,30,0,0,0\n2,1,A,B,20,0,0,0\n")
    write(f"{d}/eliminations.csv", "t,eliminated,eliminator,knocked,gun_type\n9.5,B,A,1,3\n")
    write(f"{d}/positions.csv", "t,channel,player_id,x,y,z\n0.5,1,A,0,0,0\n0.5,2,B,300,400,0\n")
    write(f"{d}/builds.csv", "spawn_t,channel,path,x,y,z,yaw,close_t,team_index\n3,5,PBWA_W1_Solid_C,0,0,0,0,,1\n")
    out = scratch_path(spark, "processed")
    # Columns the exporter always writes are missing here, so validation has to stop the write.
    with pytest.raises(ValueError, match="missing"):
        build_and_write(spark, f"{tmp_path}/telemetry", out)


def test_complete_export_is_written(spark, tmp_path):
    from skirmish.schema import TABLES
    d = f"{tmp_path}/telemetry/m1"
    rows = {
        "meta": ("matches", [{"branch": "b", "replay_owner": "A"}]),
        "players": ("players", [{"player_id": p, "is_bot": 0, "is_replay_owner": 0} for p in "AB"]),
        "teams": ("teams", [{"t": 0, "player_id": p, "team_index": k} for p, k in (("A", 1), ("B", 2))]),
        "damage": ("damage", [{"t": t, "source_channel": 1, "source": "A", "target": "B", "magnitude": m} for t, m in ((1, 30), (2, 20))]),
        "eliminations": ("eliminations", [{"t": 9.5, "eliminated": "B", "eliminator": "A", "knocked": 1, "gun_type": 3}]),
        "positions": ("positions", [{"t": 0.5, "channel": 1, "player_id": p, "x": x, "y": 0, "z": 0} for p, x in (("A", 0), ("B", 500))]),
        "builds": ("builds", [{"spawn_t": 3, "channel": 5, "path": "PBWA_W1_Solid_C", "x": 0, "y": 0, "z": 0, "yaw": 0, "team_index": 1}]),
    }
    for name in ("meta", "players", "teams", "damage", "eliminations", "positions", "builds", "health", "weapons", "safezones"):
        table, data = rows.get(name, (name, []))
        cols = [c for c in TABLES[table].names if c != "match_id"]
        write(f"{d}/{name}.csv", "\n".join([",".join(cols)] + [",".join(str(r.get(c, "")) for c in cols) for r in data]) + "\n")
    out = scratch_path(spark, "processed")
    build_and_write(spark, f"{tmp_path}/telemetry", out)
    assert all(read_table(spark, out, name).columns == TABLES[name].names for name in PROCESSED)
    poke = read_table(spark, out, "pokes").first()
    assert (poke["converted_by"], poke["t_convert"], poke["net_damage"]) == ("poker", 7.5, 50.0)
    piece = read_table(spark, out, "pieces").first()
    assert (piece["builder"], piece["builder_source"], piece["builder_dist"]) == ("A", "team", 0.0)

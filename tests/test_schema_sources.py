"""Coercion, validation, CSV folders, manifest, ledger, parquet sink."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F, types as T

from skirmish.catalog.queries import export_csv
from skirmish.schema import PROCESSED, TABLES, coerce, problems, validate, validation_summary
from skirmish.sources import ledger
from skirmish.sources.tables import read_table, write_tables
from skirmish.sources.telemetry import elims_table, finished_matches, load_table, pending, read_tolerant


def test_registry_has_the_declared_tables():
    assert len(TABLES) == 20 and len(TABLES["fight_sides"].names) == 22 and len(TABLES["pokes"].names) == 16
    assert len(TABLES["matches"].names) == 25 and TABLES["players"].key == ("match_id", "player_id")
    assert "events" not in PROCESSED and TABLES["positions"].schema["x"].metadata["unit"] == "uu"
    assert all(f.metadata["comment"] for t in TABLES.values() for f in t.schema.fields) and all(t.notes and t.path and t.status for t in TABLES.values())
    assert TABLES["fight_sides"].schema["outcome"].metadata["label_only"]


def test_coerce_text_columns_and_validate(spark):
    raw = spark.createDataFrame([("m", "1.5", "A", "3"), ("m", "2", "A", "4")], "match_id string, t string, player_id string, team_index string")
    df = coerce(raw, "teams")
    assert [f.dataType for f in df.schema.fields] == [T.StringType(), T.DoubleType(), T.StringType(), T.LongType()]
    assert problems(df, "teams") == [] and df.schema["t"].metadata["unit"] == "s"


def test_coercion_of_every_kind_of_text(spark):
    """Flags, whole and real numbers, one text at a time."""
    cases = {
        "downed": {"true": True, "\tFALSE ": False, "1": True, "0": False, "yes": None, "2": None, "": None},
        "channel": {"6.5": 6, "7.5": 8, "-1.5": -2, "12": 12, "12.0d": None, "1e2": 100, "one": None, "": None},
        "x": {"1.25": 1.25, " 2 ": 2.0, ".5": 0.5, "5.": 5.0, "1.0d": None, "3f": None, "7D": None, "-Infinity": float("-inf"), "nan": None, "1,5": None, "1e-3": 0.001},
    }
    for column, texts in cases.items():
        raw = spark.createDataFrame([(t,) for t in [*texts, None]], f"{column} string").withColumn("extra", F.lit("kept"))
        got = coerce(raw, "positions").collect()
        assert [r[column] for r in got] == [*texts.values(), None], column
        assert all(r["extra"] == "kept" for r in got)


def test_validate_reports_every_kind_of_problem(spark):
    df = spark.createDataFrame([("m", 1.0, None, 1), ("m", 1.0, None, 1)], "match_id string, t double, player_id string, bogus int")
    rows = {(r["column"], r["check"], r["n"]) for r in validate(df, "teams").collect()}
    assert rows == {("team_index", "missing", 1), ("bogus", "undeclared", 1), ("player_id", "nulls", 2)}
    typed = spark.createDataFrame([("p", "x"), ("p", "y"), ("p", "z"), ("q", "1")], "path string, spawns string")
    rows = {(r["column"], r["check"], r["n"]) for r in validate(typed, "actor_classes").collect()}
    assert rows == {("spawns", "type", 1), ("path", "duplicate_keys", 2)}
    empty_column = spark.createDataFrame([("m", 1.0, "P", None)], "match_id string, t double, player_id string, team_index string")
    assert {(r["column"], r["check"]) for r in validate(empty_column, "teams").collect()} == {("team_index", "nulls")}


def test_validation_summary(spark):
    ok = spark.createDataFrame([("m", 1.0, "P", 1)], "match_id string, t double, player_id string, team_index long")
    rows = {tuple(r) for r in validation_summary({"teams": ok, "weapons": ok}, ["teams", "weapons", "pokes"]).collect()}
    assert ("teams", "ok", 1, 0) in rows and ("pokes", "skip", None, None) in rows
    assert next(r for r in rows if r[0] == "weapons")[1] == "FAIL"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_load_table_unions_by_name_and_tags_matches(spark, tmp_path):
    d = str(tmp_path)
    write(f"{d}/m 1/meta.csv", "branch\nb\n")
    write(f"{d}/m 1/teams.csv", "t,player_id,team_index\n1.5,A,3\n2,B,4\n")
    write(f"{d}/m+2/meta.csv", "branch\nb\n")
    write(f"{d}/m+2/teams.csv", "team_index,t,player_id,extra\n5,9,C,e\n")
    write(f"{d}/unfinished/teams.csv", "t,player_id,team_index\n1,Z,1\n")
    write(f"{d}/empty/meta.csv", "branch\nb\n")
    write(f"{d}/empty/teams.csv", "")
    df = load_table(spark, d, "teams")
    rows = {(r["match_id"], r["t"], r["player_id"], r["team_index"], r["extra"]) for r in df.collect()}
    assert rows == {("m 1", 1.5, "A", 3, None), ("m 1", 2.0, "B", 4, None), ("m+2", 9.0, "C", 5, "e")} and df.columns[0] == "match_id"
    assert {r["match_id"] for r in finished_matches(spark, d).collect()} == {"m 1", "m+2", "empty"}
    none = load_table(spark, d, "weapons")
    assert none.count() == 0 and none.columns == TABLES["weapons"].names
    same = load_table(spark, d, "meta")
    assert {(r["match_id"], r["branch"]) for r in same.collect()} == {("m 1", "b"), ("m+2", "b"), ("empty", "b")}


def test_headers_and_quoting_as_the_exporter_writes_them(spark, tmp_path):
    """Line 1 of a file is its header, whatever the other files look like; quoted values may hold anything."""
    d = str(tmp_path)
    texts = {
        "a": 'player_id,name,is_bot,team_index\nA,"x ""q"", y",0,3\nB,"two\nlines",1,4\nC,"ends in \\",0,5\n',
        "b": '"team_index","a name, with comma",extra one,z1,z2,z3,player_id\n6,v,w,1,2,3,D\n',
        "c": "is_bot,player_id\n1,E\nis_bot,player_id\n",
        "d": 'name,player_id\n"",F\n',
    }
    for m, text in texts.items():
        write(f"{d}/{m}/meta.csv", "branch\nb\n")
        write(f"{d}/{m}/players.csv", text)
    rows = {(r["match_id"], r["player_id"]): r for r in load_table(spark, d, "players").collect()}
    assert len(rows) == 7
    assert (rows["a", "A"]["name"], rows["a", "A"]["is_bot"], rows["a", "A"]["team_index"]) == ('x "q", y', False, 3)
    assert rows["a", "B"]["name"] == "two\nlines" and rows["a", "C"]["name"] == "ends in \\" and rows["a", "C"]["team_index"] == 5
    assert (rows["b", "D"]["team_index"], rows["b", "D"]["a name, with comma"], rows["b", "D"]["extra one"], rows["b", "D"]["z3"]) == (6, "v", "w", "3")
    assert rows["c", "E"]["is_bot"] and rows["c", "player_id"]["is_bot"] is None and rows["d", "F"]["name"] is None
    write(f"{d}/e/meta.csv", "branch\nb\n")
    write(f"{d}/e/players.csv", "nothing,known\n1,2\n")
    with pytest.raises(ValueError, match="e/players.csv"):
        load_table(spark, d, "players")


def test_manifest_keeps_quotes(spark, tmp_path):
    rows = [("a.replay", "h", 1, "local_demos", "client", 'said "yes", twice', None, "t", "line\nbreak"), ("b.replay", "i", 2, "local_demos", "client", None, None, "t", None)]
    manifest = coerce(spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'size_bytes' else 'string'}" for c in TABLES["manifest"].names)), "manifest")
    ledger.write_manifest(manifest, f"{tmp_path}/manifest.csv")
    assert sorted(map(str, ledger.load_manifest(spark, f"{tmp_path}/manifest.csv").collect())) == sorted(map(str, manifest.collect()))


def test_scratch_needs_a_shared_folder(spark, tmp_path):
    import types

    from skirmish import session

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value or default

    fake = lambda checkpoint, conf: types.SimpleNamespace(conf=Conf(conf), sparkContext=types.SimpleNamespace(getCheckpointDir=lambda: checkpoint, applicationId="app"))
    assert session.scratch_dir(fake("file:/one", "file:/two")) == "file:/one/app" and session.scratch_dir(fake(None, "file:/two/")) == "file:/two/app"
    with pytest.raises(ValueError, match="share"):
        session.scratch_dir(fake(None, None))
    with session.stages(spark) as folder:
        stored = session.materialize(spark.range(3))
        assert stored.count() == 3 and folder in stored.inputFiles()[0].replace("///", "/")
    with pytest.raises(Exception):
        stored.count()


def test_elims_table_rounds_half_even(spark):
    e = spark.createDataFrame([("m", 0.0005, "a", "b", None, 7), ("m", 0.0015, "a", "b", True, None)],
                              "match_id string, t double, eliminated string, eliminator string, knocked boolean, gun_type long")
    assert [tuple(r) for r in elims_table(e).collect()] == [("m", 0, "b", "a", False, "7"), ("m", 2, "b", "a", True, None)]


def test_pending_and_force(spark):
    src, done = spark.createDataFrame([("a",), ("b",)], "f string"), spark.createDataFrame([("a",), ("a",)], "f string")
    assert [r["f"] for r in pending(src, done, "f").collect()] == ["b"] and pending(src, done, "f", force=True).count() == 2


def test_bad_lines_are_set_aside(spark, tmp_path):
    write(f"{tmp_path}/x.csv", "id,v\n1,2.5\nx,3\n4,oops\n5,6\n")
    good, bad = read_tolerant(spark, f"{tmp_path}/x.csv", "id long, v double", header=True)
    assert sorted(map(tuple, good.collect())) == [(1, 2.5), (5, 6.0)] and sorted(r["line"] for r in bad.collect()) == ["4,oops", "x,3"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_ledger(spark, tmp_path):
    files = {"a.replay": "one", "b.replay": "two", "b2.replay": "two", "c.replay": "three", "d.replay": "four", "e.replay": "five"}
    for name, text in files.items():
        write(f"{tmp_path}/in/{name}", text)
    incoming = ledger.hash_files(spark, f"{tmp_path}/in/*.replay")
    stored = spark.createDataFrame([("a.replay", sha("one"), 3), ("c.replay", sha("other"), 5), ("x.replay", sha("five"), 4)],
                                   "replay_file string, sha256 string, size_bytes long")
    manifest = coerce(spark.createDataFrame(
        [("a.replay", sha("one"), 3, "local_demos", "client", "t")], "replay_file string, sha256 string, size_bytes long, source string, replay_kind string, acquired_at string")
        .selectExpr("*", "cast(null as string) contributor", "cast(null as string) consent_ref", "cast(null as string) notes"), "manifest")
    out = ledger.import_files(incoming, stored, manifest, source="donated", consent="C-1", acquired_at="now")
    got = {(r["original_file"], r["action"]): r["replay_file"] for r in out.collect()}
    assert got == {("c.replay", "backfilled"): "c.replay", ("x.replay", "backfilled"): "x.replay", ("a.replay", "duplicate"): "a.replay",
                   ("b.replay", "copied"): "b.replay", ("b2.replay", "duplicate"): "b2.replay",
                   ("c.replay", "copied"): f"c-{sha('three')[:8]}.replay", ("d.replay", "copied"): "d.replay", ("e.replay", "duplicate"): "e.replay"}
    grown = ledger.extend_manifest(manifest, out)
    assert grown.count() == 6 and problems(grown, "manifest") == []
    ledger.write_manifest(grown, f"{tmp_path}/manifest.csv")
    assert sorted(map(str, ledger.load_manifest(spark, f"{tmp_path}/manifest.csv").collect())) == sorted(map(str, grown.select(*TABLES["manifest"].names).collect()))
    with pytest.raises(ValueError, match="consent"):
        ledger.import_files(incoming, stored, manifest, source="donated")
    with pytest.raises(ValueError, match="unknown"):
        ledger.import_files(incoming, stored, manifest, source="elsewhere")


def test_nothing_is_written_if_any_table_is_invalid(spark, tmp_path):
    good = spark.createDataFrame([("m", "1.0", "P", "1")], "match_id string, t string, player_id string, team_index string")
    bad = good.drop("team_index")
    with pytest.raises(ValueError, match="team_index: missing"):
        write_tables({"actor_classes": spark.createDataFrame([("p", 1)], "path string, spawns long"), "teams": bad}, f"{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out")
    write_tables({"teams": good}, f"{tmp_path}/out")
    assert read_table(spark, f"{tmp_path}/out", "teams", ["t", "team_index"], match_id="m").collect() == [(1.0, 1)]


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("m", 1.0, "P", 1)], "match_id string, t double, player_id string, team_index long").write.parquet(f"{tmp_path}/teams.parquet")
    plan = read_table(spark, str(tmp_path), "teams", ["t"], match_id="m")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(match_id,m)" in plan and "player_id" not in plan


def test_export_spreads_small_files_over_tasks(spark, tmp_path):
    """One tiny row per match is still one file per match, which one task would write one after the other."""
    frame = spark.range(40).select(F.concat(F.lit("m"), "id").alias("match_id"), F.lit("b").alias("branch"))
    export_csv(frame, str(tmp_path / "export"), "meta")
    seen = {p.name.split("-")[1] for p in (tmp_path / "export").rglob("part-*.csv")}
    assert len(seen) > 4 and len(list((tmp_path / "export").iterdir())) >= 40

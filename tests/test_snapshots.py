"""Commits of several tables: all or nothing, whoever dies when."""

import os

import pytest

from skirmish.sources import snapshots
from skirmish.sources.snapshots import Store
from skirmish.sources.tables import read_table, write_tables

TEAMS = "match_id string, t double, player_id string, team_index long"
CLASSES = "path string, spawns long"


def both(spark, n):
    return {"teams": spark.createDataFrame([("m", 1.0, "P", n)], TEAMS), "actor_classes": spark.createDataFrame([("p", n)], CLASSES)}


def seen(spark, out, **kw):
    return read_table(spark, out, "teams", **kw).first()["team_index"], read_table(spark, out, "actor_classes", **kw).first()["spawns"]


def test_readers_see_one_set(spark, tmp_path):
    out = f"{tmp_path}/out"
    write_tables(both(spark, 1), out)
    old = read_table(spark, out, "teams")
    write_tables(both(spark, 2), out)
    assert seen(spark, out) == (2, 2) and seen(spark, out, snapshot=1) == (1, 1)
    assert old.first()["team_index"] == 1  # whoever began to read the old set goes on with it
    write_tables({"teams": both(spark, 3)["teams"]}, out)
    assert seen(spark, out) == (3, 2)


@pytest.mark.parametrize("step", ["_move", "_publish"])
def test_a_failure_between_tables_leaves_the_old_set(spark, tmp_path, monkeypatch, step):
    out = f"{tmp_path}/out"
    write_tables(both(spark, 1), out)

    def dies(self, *args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, step, dies)
        with pytest.raises(RuntimeError, match="lost"):
            write_tables(both(spark, 2), out)
    assert seen(spark, out) == (1, 1) and Store(spark, out).latest() == 1
    write_tables(both(spark, 4), out)
    assert seen(spark, out) == (4, 4)


def test_the_second_of_two_writers_fails(spark, tmp_path):
    out = f"{tmp_path}/out"
    write_tables(both(spark, 1), out)
    store = Store(spark, out)
    both(spark, 5)["teams"].write.parquet(f"{tmp_path}/late/teams.parquet")
    write_tables(both(spark, 2), out)
    with pytest.raises(FileExistsError):
        store.commit(f"{tmp_path}/late", ["teams"], 1)
    assert seen(spark, out) == (2, 2)


def test_old_sets_expire(spark, tmp_path):
    out = f"{tmp_path}/out"
    for n in (1, 2, 3):
        write_tables(both(spark, n), out)
    write_tables({"teams": both(spark, 4)["teams"]}, out)
    store = Store(spark, out)
    assert store.expire(keep=1) == 2  # the first two; the third still holds a table of the newest set
    assert seen(spark, out) == (4, 3) and len(os.listdir(f"{out}/versions")) == 2
    with pytest.raises(Exception):
        store.tables(1)
    assert snapshots.Store(spark, f"{tmp_path}/none").tables() == {}

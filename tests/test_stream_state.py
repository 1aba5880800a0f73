"""Stateful pairing over restarts, and imports that survive a repeated batch."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from skirmish.operators.ordered import open_close_pairs
from skirmish.session import scratch_path
from skirmish.sources.snapshots import Store
from skirmish.streaming.imports import StreamLedger, start_import, stream_files
from skirmish.streaming.pairs import stream_pairs, use_rocksdb

EVENTS = "match_id string, channel long, t double, row_id long, event string, reason string"


def run(spark, source, starts, name, checkpoint, out):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    query = (stream_pairs(stream, starts, "30 seconds", 100.0).writeStream.format("parquet").queryName(name).outputMode("append")
             .option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start())
    query.awaitTermination(240)
    assert query.exception() is None


def test_pairs_over_batches_and_a_restart_equal_the_batch_operator(spark):
    use_rocksdb(spark)
    r = random.Random(5)
    rows, t = [], {"m": 0.0, "n": 0.0}
    for i in range(240):
        m = r.choice("mn")
        t[m] += r.choice([0.0, 0.5, 3.0])
        rows.append((m, r.randrange(4), t[m], i, r.choice(["open", "open", "close"]), r.choice(["Destroyed", "Dormancy", None])))
    batches = [rows[:80], rows[80:160], rows[160:]]
    for a, b in ((0, 1), (1, 2)):  # some arrive one batch late
        late = [x for x in rows[80 * a + 70:80 * b] if r.random() < 0.5]
        batches[a] = [x for x in batches[a] if x not in late]
        batches[b] = batches[b] + late
    for b in batches:
        r.shuffle(b)
    end = [("end", 0, 0.0, 10**6, "open", None)]
    source, out, checkpoint = (scratch_path(spark, n) for n in ("stream", "out", "cp"))
    starts = spark.createDataFrame([("m", 0), ("n", 0), ("end", 10**6)], "match_id string, s long").select("match_id", F.timestamp_seconds("s").alias("started"))
    for k, part in enumerate([*batches, end, end]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 4):  # stop after two batches, then go on from the checkpoint
            run(spark, source, starts, f"pairs{k}", checkpoint, out)
    got = sorted(map(repr, spark.read.parquet(out).where("match_id <> 'end'").select("match_id", "channel", "row_id", "spawn_t", "close_t", "close_reason").collect()))
    batch = open_close_pairs(spark.createDataFrame(rows, EVENTS), ["match_id", "channel"], ["t", "row_id"], "t", "event", "reason")
    # an open that nothing follows is given up after a while: it has no close either way
    want = sorted(map(repr, batch.select("match_id", "channel", "row_id", F.col("t").alias("spawn_t"), "close_t", "close_reason").collect()))
    assert got == want


def save(folder, name, text):
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


@pytest.fixture
def folders(tmp_path):
    os.makedirs(f"{tmp_path}/in")
    return f"{tmp_path}/in", f"{tmp_path}/ledger", f"{tmp_path}/cp"


def take(spark, folders, ledger=None):
    source, target, checkpoint = folders
    start_import(stream_files(spark, source), ledger or StreamLedger(spark, target), checkpoint, lambda n: f"2024-01-0{n + 1}", notes="x").awaitTermination(240)


def listed(spark, folders):
    return sorted((r["replay_file"], r["action"], r["sha256"]) for r in StreamLedger(spark, folders[1]).rows().collect())


def test_batches_know_what_came_before(spark, folders):
    save(folders[0], "a.replay", "one")
    save(folders[0], "b.replay", "two")
    take(spark, folders)
    save(folders[0], "c.replay", "one")
    take(spark, folders)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert listed(spark, folders) == [("a.replay", "copied", sha("one")), ("b.replay", "copied", sha("two")), ("c.replay", "duplicate", sha("one"))]
    assert StreamLedger(spark, folders[1]).batches() == [0, 1]


def test_a_repeated_batch_changes_nothing(spark, folders):
    """The same id again, as after a crash between the commit and the checkpoint."""
    ledger = StreamLedger(spark, folders[1])
    files = spark.createDataFrame([("a.replay", "h1", 3), ("b.replay", "h1", 3)], "replay_file string, sha256 string, size_bytes long")
    assert ledger.commit(files, 0, acquired_at="t") and not ledger.commit(files, 0, acquired_at="later")
    first = listed(spark, folders)
    assert [x[:2] for x in first] == [("a.replay", "copied"), ("b.replay", "duplicate")]
    assert ledger.commit(files, 1, acquired_at="t") and [x[1] for x in listed(spark, folders)].count("copied") == 1


def test_a_crash_before_the_commit_is_made_good(spark, folders, monkeypatch):
    """The driver dies before, or right after, the rename of a batch; the query is started again from its checkpoint."""
    save(folders[0], "a.replay", "one")
    move = Store._move

    def before(self, source, target):
        raise RuntimeError("lost")

    def after(self, source, target):
        move(self, source, target)
        raise RuntimeError("lost")

    for k, dies in enumerate((before, after)):
        save(folders[0], f"new{k}.replay", f"text {k}")
        with monkeypatch.context() as m:
            m.setattr(Store, "_move", dies)
            with pytest.raises(Exception):
                take(spark, folders)
        take(spark, folders)
        names = [x[0] for x in listed(spark, folders)]
        assert len(names) == len(set(names)) == 2 + k

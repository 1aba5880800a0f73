"""Open and close events of a channel paired on a stream, with state per channel.

Events wait in the state of their channel until the watermark has passed them and are then taken in order of time and row id, so
events that arrive out of order within the allowed lateness, closes before their opens included, pair as in the batch operator.
A row is emitted for an open when its close comes, when another open follows (no close), or when `ttl_s` has passed without either
(no close): state of channels that fall silent does not stay. Closes without an open are ignored; events later than the watermark
are dropped by Spark. State and timers are in the checkpoint, so a restarted query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "match_id string, channel long, row_id long, spawn_t double, close_t double, close_reason string"


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers and lists needs the RocksDB store; to be set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Pairing(StatefulProcessor):
    """State of one (match, channel): the open event without a close, and the events the watermark has not passed."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "t double, row_id long, at_ms long")
        self.waiting = handle.getListState("waiting", "t double, row_id long, event string, reason string, at_ms long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        fresh = [(float(r.t), int(r.row_id), r.event, r.reason if isinstance(r.reason, str) else None, int(r.at_ms)) for frame in rows for r in frame.itertuples(index=False)]
        self.waiting.appendList(fresh)
        for at in {r[4] for r in fresh}:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        until, out = timerValues.getCurrentWatermarkInMs(), []  # all that the watermark has passed, whichever timer comes first
        events = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [e for e in events if e[4] <= until]
        open_ = tuple(self.open.get()) if self.open.exists() else None
        for t, row_id, event, reason, at in due:
            if event == "open":
                if open_:
                    out.append((open_[1], open_[0], None, None))
                open_ = (t, row_id, at)
                self.handle.registerTimer(at + self.ttl_ms)
            elif open_:
                out.append((open_[1], open_[0], t, reason))
                open_ = None
        if open_ and open_[2] + self.ttl_ms <= until:
            out.append((open_[1], open_[0], None, None))
            open_ = None
        if due:
            self.waiting.clear()
            if rest := events[len(due):]:
                self.waiting.put(rest)
        self.open.update(open_) if open_ else self.open.clear()
        if out:
            frame = pd.DataFrame(out, columns=["row_id", "spawn_t", "close_t", "close_reason"]).astype({"close_t": "float64", "close_reason": "object"})
            frame.insert(0, "match_id", key[0])
            frame.insert(1, "channel", key[1])
            yield frame

    def close(self) -> None:
        pass


def stream_pairs(events: DataFrame, starts: DataFrame, lateness: str = "1 minute", ttl_s: float = 3600.0) -> DataFrame:
    """(match_id, channel, row_id, spawn_t, close_t, close_reason) from a stream of (match_id, channel, t, row_id, event, reason).

    Event time is the match's start (`starts`: match_id, started timestamp) plus `t`; events of a match without a start, and those
    that neither open nor close, are left out.
    """
    at = F.timestamp_micros(F.unix_micros("started") + F.round(F.col("t") * 1_000_000).cast("long"))
    timed = events.where(F.col("event").isin("open", "close")).join(starts.select("match_id", "started"), "match_id").withColumn("at", at)
    rows = timed.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", lateness).select("match_id", "channel", "t", "row_id", "event", "reason", "at_ms", "at")
    return rows.groupBy("match_id", "channel").transformWithStateInPandas(
        statefulProcessor=Pairing(int(ttl_s * 1000)), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")

"""Team-pair segments on a stream: the gap rule as an event-time session window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skirmish.plans.fights import GAP_S


def stream_segments(hits: DataFrame, starts: DataFrame, gap_s: float = GAP_S, lateness: str = "1 minute") -> DataFrame:
    """Segments (match_id, team_a, team_b, seg_start, seg_end, n_hits) of engagement rows with match seconds `t`.

    Match clocks all begin at 0, so event time is the match's start (`starts`: match_id, started timestamp) plus `t`: one
    watermark then holds for matches that begin one after the other. Hits of a match without a start are left out. A segment
    is emitted once the watermark has passed its last hit by more than the gap; hits exactly the gap apart share a segment,
    as in the batch operator. Sessions are merged incrementally, with partial sessions combined before the shuffle.
    """
    at = F.timestamp_micros(F.unix_micros("started") + F.round(F.col("t") * 1_000_000).cast("long"))
    timed = hits.join(starts.select("match_id", "started"), "match_id").withColumn("at", at).withWatermark("at", lateness)
    sessions = timed.groupBy(F.session_window("at", f"{int(gap_s * 1000)} milliseconds"), "match_id", "team_a", "team_b").agg(
        F.min("t").alias("seg_start"), F.max("t").alias("seg_end"), F.count("*").alias("n_hits"))
    return sessions.drop("session_window")

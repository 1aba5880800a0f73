"""Response times: what a player does after being hit, matched over the merged event streams of both players.

A hit starts a wait if the two players had not exchanged damage for `QUIET_S` before it. Three responses are looked for, each
after the hit and within `WINDOW_S`:

* fire: the victim's next damage to that attacker;
* build: the victim's next piece. The victim's waits follow each other whoever hits, so a piece answers the latest one only:
  a wait that is overtaken by the victim's next one stays without an answer;
* turn: the first moment at which the victim looks towards the attacker within `FACING_DEG`, also only until the victim's next
  wait. Both players' states hold from one update to the next, so that moment is the hit itself or an update of either player.

Everything is running values over streams with one row per time, so equal times never depend on row order, and `split` cuts
a large match into range blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skirmish.operators.intervals import point_in_interval
from skirmish.operators.ordered import Ordered, asof
from skirmish.operators.quantiles import percentiles
from skirmish.plans.fights import HIT_POS_MAX_AGE_S, by_match
from skirmish.session import materialize

# Default parameters.
QUIET_S = 2.0
WINDOW_S = 10.0
FACING_DEG = 30.0

#: Width of the time buckets that updates and waits meet in; results do not depend on it.
BUCKET_S = 10.0
RESPONSES = ("fire_s", "build_s", "turn_s")


def within(value: Column, window_s: float) -> Column:
    return F.when(value <= F.lit(float(window_s)), value)


def wait_starts(eng: DataFrame, quiet_s: float = QUIET_S, split: bool = False) -> DataFrame:
    """(match_id, attacker, victim, t, fire_t): hits after a quiet period of the two players, and the next damage back."""
    p, q = F.least("source", "target"), F.greatest("source", "target")
    times = by_match(eng, split).groupBy("match_id", p.alias("p"), q.alias("q"), "t").agg(
        F.bool_or(F.col("source") < F.col("target")).alias("pq"), F.bool_or(F.col("source") > F.col("target")).alias("qp"))
    scan = Ordered(times, ["match_id", "p", "q"], ["t"], split).running("_prev", "max", F.col("t"), inclusive=False)
    scan.running_all({"_pq": ("min", F.when(F.col("pq"), F.col("t"))), "_qp": ("min", F.when(F.col("qp"), F.col("t")))}, inclusive=False, reverse=True)
    quiet = scan.rows().where(F.col("_prev").isNull() | (F.col("t") - F.col("_prev") >= F.lit(float(quiet_s))))
    hit = lambda on, a, v, back: F.when(F.col(on), F.struct(F.col(a).alias("attacker"), F.col(v).alias("victim"), F.col(back).alias("fire_t")))
    both = F.filter(F.array(hit("pq", "p", "q", "_qp"), hit("qp", "q", "p", "_pq")), lambda s: s.isNotNull())
    return quiet.select("match_id", "t", F.inline(both))


def with_victims_next(starts: DataFrame, pieces: DataFrame, split: bool = False) -> DataFrame:
    """Add `next_t`, the victim's next wait, and `build_t`, the victim's next piece; both after `t`."""
    none = F.lit(None).cast("double")
    stream = starts.select("match_id", F.col("victim").alias("player"), "t", F.col("t").alias("start_t"), none.alias("piece_t")).unionByName(
        by_match(pieces, split).where(F.col("builder").isNotNull()).select("match_id", F.col("builder").alias("player"), F.col("spawn_t").alias("t"), none.alias("start_t"),
                                                         F.col("spawn_t").alias("piece_t")))
    times = stream.groupBy("match_id", "player", "t").agg(F.max("start_t").alias("start_t"), F.max("piece_t").alias("piece_t"))
    scan = Ordered(times, ["match_id", "player"], ["t"], split).running_all(
        {"next_t": ("min", F.col("start_t")), "build_t": ("min", F.col("piece_t"))}, inclusive=False, reverse=True)
    after = scan.rows().where(F.col("start_t").isNotNull()).select("match_id", F.col("player").alias("victim"), "t", "next_t", "build_t")
    return starts.join(after, ["match_id", "victim", "t"])


def first_facing(waits: DataFrame, poses: DataFrame, window_s: float = WINDOW_S, facing_deg: float = FACING_DEG,
                 max_age_s: float = HIT_POS_MAX_AGE_S, split: bool = False) -> DataFrame:
    """(match_id, attacker, victim, t, turn_t): waits whose victim looks towards the attacker, and since when."""
    key = ["match_id", "attacker", "victim", "t"]
    poses = by_match(poses.select("match_id", "player_id", F.col("t").alias("at"), "x", "y", "yaw"), split)
    ends = F.least(F.col("t") + F.lit(float(window_s)), F.coalesce("next_t", F.lit(float("inf"))))
    spans = waits.select(*key, "next_t", ends.alias("_end"))

    def updates(role: str) -> DataFrame:
        moved = poses.select("match_id", F.col("player_id").alias(role), "at")
        met = point_in_interval(moved, spans, keys=["match_id", role], t="at", lo="t", hi="_end", width=BUCKET_S)
        return met.where(F.col("next_t").isNull() | (F.col("at") < F.col("next_t"))).select(*key, "at")

    moments = spans.select(*key, F.col("t").alias("at")).unionByName(updates("victim")).unionByName(updates("attacker")).distinct()
    for role in ("victim", "attacker"):
        moments = asof(moments, poses, left_keys=["match_id", role], right_keys=["match_id", "player_id"], left_t="at", right_t="at",
                       payload={f"{role}_{c}": c for c in ("x", "y", "yaw")}, max_age=max_age_s, split=split)
    dx, dy = F.col("attacker_x") - F.col("victim_x"), F.col("attacker_y") - F.col("victim_y")
    off = F.abs(F.pmod(F.col("victim_yaw") - F.degrees(F.atan2(dy, dx)) + 180, F.lit(360.0)) - 180)
    facing = ((dx != 0) | (dy != 0)) & (off <= F.lit(facing_deg + 1e-9))  # standing in one place gives no direction
    return moments.where(facing).groupBy(*key).agg(F.min("at").alias("turn_t"))


def hit_responses(eng: DataFrame, pieces: DataFrame, poses: DataFrame, quiet_s: float = QUIET_S, window_s: float = WINDOW_S,
                  facing_deg: float = FACING_DEG, max_age_s: float = HIT_POS_MAX_AGE_S, split: bool = False) -> DataFrame:
    """One row per wait: (match_id, attacker, victim, t, fire_s, build_s, turn_s), null where there was no such response.

    `eng` holds player-to-player hits (source, target), `pieces` (builder, spawn_t), `poses` (player_id, t, x, y, yaw).
    """
    waits = materialize(with_victims_next(wait_starts(eng, quiet_s, split), pieces, split), "waits")
    key = ["match_id", "attacker", "victim", "t"]
    rows = waits.join(first_facing(waits, poses, window_s, facing_deg, max_age_s, split), key, "left")
    built = F.when(F.col("next_t").isNull() | (F.col("build_t") <= F.col("next_t")), F.col("build_t") - F.col("t"))
    return rows.select(*key, within(F.col("fire_t") - F.col("t"), window_s).alias("fire_s"), within(built, window_s).alias("build_s"),
                       (F.col("turn_t") - F.col("t")).alias("turn_s"))


def response_quantiles(responses: DataFrame) -> DataFrame:
    """Per player and kind of response: waits, answered ones, median and quartiles of the time taken."""
    long = responses.select(F.col("victim").alias("player_id"), F.inline(F.array(*[
        F.struct(F.lit(c.removesuffix("_s")).alias("response"), F.col(c).alias("latency")) for c in RESPONSES])))
    counts = long.groupBy("player_id", "response").agg(F.count("*").alias("waits"), F.count("latency").alias("answered"))
    taken = percentiles(long, ["player_id", "response"], "latency", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return counts.join(taken.drop("n_values"), ["player_id", "response"], "left").withColumn("iqr", F.col("p75") - F.col("p25"))

"""Deterministic splits: pure functions of ids and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skirmish.functions.columns import iso_time, name_time, unit_hash
from skirmish.operators.ordered import Ordered, global_rank

# Salts and fractions are part of the definition of a split.
HOLDOUT_SALT = "fnf-holdout-v1"
HOLDOUT_FRAC = 0.20
FOLD_SALT = "fnf-folds-v1"
FOLDS = 5
VAL_FRAC = 0.15
TEST_FRAC = 0.15
MIN_TRAIN_EVENTS = 10


def is_held_out_player(player_id: str | Column, frac: float = HOLDOUT_FRAC, salt: str = HOLDOUT_SALT) -> Column:
    """Held-out players: hash of the upper-cased id below `frac`. Null ids and BOT_ ids (as written) never are."""
    c = F.col(player_id) if isinstance(player_id, str) else player_id
    held = ~c.startswith("BOT_") & (unit_hash(salt, F.upper(c)) < F.lit(float(frac)))
    return F.coalesce(held, F.lit(False))


def cross_fit_fold(match_id: str | Column, k: int = FOLDS, salt: str = FOLD_SALT) -> Column:
    return F.floor(unit_hash(salt, match_id) * k).cast("long")


def match_start(matches: DataFrame) -> DataFrame:
    """`match_id, start`: utc_start, else the time in the match's name, else null."""
    return matches.select("match_id", F.coalesce(iso_time("utc_start"), name_time("match_id")).alias("start"))


def chronological_split(matches: DataFrame, val_frac: float = VAL_FRAC, test_frac: float = TEST_FRAC) -> DataFrame:
    """`match_id, start, split`: whole matches, oldest train, newest test; an unknown start counts as newest."""
    ranked = global_rank(match_start(matches), [F.col("start").asc_nulls_last(), F.col("match_id")], "rank")
    n = ranked.count()
    n_test, n_val = round(n * test_frac), round(n * val_frac)
    label = F.when(F.col("rank") < n - n_val - n_test, "train").when(F.col("rank") < n - n_test, "val").otherwise("test")
    return ranked.select("match_id", "start", label.alias("split"))


def _by_date(events: DataFrame, min_train_events: int) -> DataFrame:
    """Per event date: events on it, events strictly before it, whether it is an origin, and the next origin."""
    per_date = events.groupBy("date").agg(F.count("*").alias("n_test")).withColumn("_all", F.lit(0))
    scan = Ordered(per_date, ["_all"], ["date"], split=True).running("_before", "sum", F.col("n_test"), inclusive=False)
    scan.with_column("n_train", F.coalesce("_before", F.lit(0)))
    scan.with_column("is_origin", F.col("n_train") >= min_train_events)
    scan.running("train_from", "min", F.when(F.col("is_origin"), F.col("date")), inclusive=False, reverse=True)
    return scan.rows().drop("_all", "_before")


def rolling_origins(events: DataFrame, min_train_events: int = MIN_TRAIN_EVENTS) -> DataFrame:
    """`origin, n_train, n_test`: each event date with at least `min_train_events` events strictly before it.

    `events` has event_id and date; `rolling_membership` says which events belong to which origin.
    """
    return _by_date(events, min_train_events).where("is_origin").select(F.col("date").alias("origin"), "n_train", "n_test")


def rolling_membership(events: DataFrame, min_train_events: int = MIN_TRAIN_EVENTS) -> DataFrame:
    """`event_id, date, test_origin, train_from`: an event is tested at `test_origin` and trains every origin from
    `train_from` on (null: none). The full lists, one row per event instead of one per (origin, event)."""
    dates = _by_date(events, min_train_events)
    return events.select("event_id", "date").join(dates, "date").select(
        "event_id", "date", F.when(F.col("is_origin"), F.col("date")).alias("test_origin"), "train_from")


def events_of_origin(membership: DataFrame, origin: Column) -> DataFrame:
    """`role, event_id` of one origin."""
    role = F.when(F.col("test_origin") == origin, "test").when(F.col("train_from") <= origin, "train")
    return membership.select(role.alias("role"), "event_id").where(F.col("role").isNotNull())

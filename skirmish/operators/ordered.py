"""Ordered operators: running aggregates, as-of joins, gap segments, interval islands, neighbours, global rank.

Everything ordered is built on one primitive, a running max/min/sum over the earlier rows of a key. It has two
plans with the same result:

* plain: one window per key. Right when every key fits one task.
* split: for data where a key can hold more rows than one task should sort. Rows are range-partitioned on
  (key, order), so a large key spans many blocks of equal size; each block is scanned on its own and the blocks
  before it are summed up in one carried value per block. Only keys cut by a partition boundary need a carry, so
  the carry table has at most as many rows as there are partitions.

`needs_split` measures which plan a dataset needs; `by_size` uses the split plan for the large keys only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skirmish.session import materialize

HOT_ROWS = 5_000_000
"""Rows of one key that one task may sort. Above this the split plan is used."""

_BLOCK = "_block"


def large_keys(tables: Sequence[DataFrame], key: str = "match_id", limit: int | None = None) -> DataFrame:
    """Keys with more than `limit` (HOT_ROWS) rows over all tables: one counting pass over the key column.

    There are at most (all rows / limit) of them, so the list may be broadcast.
    """
    keys = reduce(lambda a, b: a.unionByName(b), [t.select(key) for t in tables])
    return keys.groupBy(key).count().where(F.col("count") > (limit or HOT_ROWS)).select(key)


def needs_split(tables: Sequence[DataFrame], key: str = "match_id", limit: int | None = None) -> bool:
    """True if there is any such key."""
    return not large_keys(tables, key, limit).isEmpty()


def by_size(build: Callable[[dict[str, DataFrame], bool], dict[str, DataFrame]], tables: dict[str, DataFrame],
            sized: Sequence[str], key: str = "match_id") -> dict[str, DataFrame]:
    """Run `build(tables, split)`, which must not mix keys, with the plain plan for ordinary keys and the split plan
    for large ones only, and put the results together. `sized` names the tables whose rows are counted."""
    large = materialize(large_keys([tables[n] for n in sized], key), "large-keys")
    if large.isEmpty():
        return build(tables, False)
    few = F.broadcast(large)
    ordinary = build({n: t.join(few, key, "left_anti") for n, t in tables.items()}, False)
    heavy = build({n: t.join(few, key, "left_semi") for n, t in tables.items()}, True)
    return {n: df.unionByName(heavy[n]) for n, df in ordinary.items()}


_FNS = {"max": F.max, "min": F.min, "sum": F.sum}
_MERGE = {
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
}


def _null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


class Ordered:
    """Rows of `df` in `order` within `keys`; running values are added column by column."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], split: bool = False):
        self.keys, self.order, self.split = list(keys), list(order), split
        if split:
            df = materialize(
                df.repartitionByRange(*self.keys, *self.order).withColumn(_BLOCK, F.spark_partition_id()), "ranges")
        self._df = df

    def rows(self) -> DataFrame:
        return self._df.drop(_BLOCK)

    def with_column(self, name: str, value: Column) -> "Ordered":
        self._df = self._df.withColumn(name, value)
        return self

    def running(self, out: str, fn: str, value: Column, *, inclusive: bool = True, reverse: bool = False) -> "Ordered":
        """`fn` of `value` over the rows up to this one (before this one if not inclusive; after if reverse)."""
        return self.running_all({out: (fn, value)}, inclusive=inclusive, reverse=reverse)

    def running_all(self, specs: dict[str, tuple[str, Column]], *, inclusive: bool = True, reverse: bool = False) -> "Ordered":
        """Several running values at once: name -> (fn, value). They share one pass, and one carry table if split."""
        last = 0 if inclusive else -1
        sort = [F.col(c).desc_nulls_last() if reverse else F.col(c).asc_nulls_first() for c in self.order]
        part = [*self.keys, _BLOCK] if self.split else self.keys
        frame = W.partitionBy(*part).orderBy(*sort).rowsBetween(W.unboundedPreceding, last)
        here = {out: _FNS[fn](value).over(frame) for out, (fn, value) in specs.items()}
        if not self.split:
            self._df = self._df.withColumns(here)
            return self
        totals = self._df.groupBy(*part).agg(*[_FNS[fn](value).alias(f"_t_{out}") for out, (fn, value) in specs.items()])
        blocks = W.partitionBy(*self.keys).orderBy(F.col(_BLOCK).desc() if reverse else F.col(_BLOCK)).rowsBetween(
            W.unboundedPreceding, -1)
        carry = totals.select(*[F.col(c).alias(f"_k_{c}") for c in part], *[
            _FNS[fn](f"_t_{out}").over(blocks).alias(f"_c_{out}") for out, (fn, _) in specs.items()])
        carry = carry.where(reduce(lambda a, b: a | b, [F.col(f"_c_{out}").isNotNull() for out in specs]))
        local = self._df.withColumns(here)
        # At most one row per partition boundary, so the broadcast is bounded by the partition count.
        joined = local.join(F.broadcast(carry), _null_safe(local, carry, [(c, f"_k_{c}") for c in part]), "left")
        self._df = joined.withColumns({out: _MERGE[fn](F.col(out), F.col(f"_c_{out}")) for out, (fn, _) in specs.items()}).drop(
            *[f"_k_{c}" for c in part], *[f"_c_{out}" for out in specs])
        return self

    def neighbour(self, out: str, payload: dict[str, Column], *, after: bool = False) -> "Ordered":
        """Struct `out` of `payload` taken from the previous (or next) row; null at the end of the key."""
        body = F.struct(*[v.alias(k) for k, v in payload.items()])
        if not self.split:
            w = W.partitionBy(*self.keys).orderBy(*[F.col(c).asc_nulls_first() for c in self.order])
            self._df = self._df.withColumn(out, (F.lead if after else F.lag)(body).over(w))
            return self
        # In order, the previous row is the largest earlier one and the next row the smallest later one.
        ranked = F.struct(*[F.col(c) for c in self.order], body.alias("_body"))
        self.running("_nb", "min" if after else "max", ranked, inclusive=False, reverse=after)
        self._df = self._df.withColumn(out, F.col("_nb._body")).drop("_nb")
        return self


# ------------------------------------------------------------------------------------------------ as-of joins
def asof(left: DataFrame, right: DataFrame, *, left_keys: Sequence[str], right_keys: Sequence[str], left_t: str | Column,
         right_t: str = "t", payload: dict[str, str], tiebreak: Sequence[str] = (), max_age: float | None = None,
         forward: bool = False, split: bool = False) -> DataFrame:
    """Left rows with `payload` (output name -> right column) of the last right row at or before `left_t`.

    Exact time matches count; `forward` takes the first right row at or after instead. With `max_age`, a match
    further away than that is dropped (its payload is null) and no older row is tried. Right rows with a null key
    are ignored, left rows with a null key get null. Same time: highest `tiebreak`, then highest payload (lowest if
    `forward`). Column names starting with `_` are reserved.

    One union and one window: no pairs are formed, so cost is linear in both inputs.
    """
    # Keys with the same name on both sides keep it, so an existing layout by match survives the union.
    key_names = [lk if lk == rk else f"_k{i}" for i, (lk, rk) in enumerate(zip(left_keys, right_keys))]
    renamed = [k for k in key_names if k not in left_keys]
    t = F.col(left_t) if isinstance(left_t, str) else left_t
    null_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in left_keys])
    # Rows that cannot match are spread out: one null key must not become one large group.
    spread = F.when(null_key, F.pmod(F.xxhash64(t, *left_keys), F.lit(4096)))
    lft = left.select("*", *[F.col(c).alias(k) for c, k in zip(left_keys, key_names) if c != k], spread.alias("_spread"),
                      t.cast("double").alias("_t"), F.lit(0 if forward else 1).alias("_side"))
    hit = F.struct(F.col(right_t).cast("double").alias("at"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(tiebreak)],
                   *[F.col(c).alias(f"p{i}") for i, c in enumerate(payload.values())])
    rgt = right.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in right_keys])).select(
        *[F.col(c).alias(k) for c, k in zip(right_keys, key_names)], F.col(right_t).cast("double").alias("_t"),
        F.lit(1 if forward else 0).alias("_side"), hit.alias("_hit"))
    both = lft.unionByName(rgt, allowMissingColumns=True)
    scan = Ordered(both, [*key_names, "_spread"], ["_t", "_side"], split)
    if forward:
        scan.running("_found", "min", F.col("_hit"), reverse=True)
    else:
        scan.running("_found", "max", F.col("_hit"))
    rows = scan.rows().where(F.col("_side") == (0 if forward else 1))
    fresh = F.lit(True) if max_age is None else (
        (F.col("_found.at") - F.col("_t") if forward else F.col("_t") - F.col("_found.at")) <= F.lit(float(max_age)))
    return rows.withColumns({name: F.when(fresh, F.col(f"_found.p{i}")) for i, name in enumerate(payload)}).drop(
        *renamed, "_spread", "_t", "_side", "_hit", "_found")


def interpolate(left: DataFrame, track: DataFrame, *, left_keys: Sequence[str], right_keys: Sequence[str], left_t: str,
                columns: Sequence[str], right_t: str = "t", tiebreak: Sequence[str] = (), split: bool = False) -> DataFrame:
    """Left rows with `columns` of `track` interpolated linearly at `left_t`; clamped to the first / last point."""
    names = [right_t, *columns]
    back = asof(left, track, left_keys=left_keys, right_keys=right_keys, left_t=left_t, right_t=right_t,
                payload={f"_b_{c}": c for c in names}, tiebreak=tiebreak, split=split)
    both = asof(back, track, left_keys=left_keys, right_keys=right_keys, left_t=left_t, right_t=right_t,
                payload={f"_f_{c}": c for c in names}, tiebreak=tiebreak, forward=True, split=split)
    b_t, f_t = F.col(f"_b_{right_t}"), F.col(f"_f_{right_t}")
    share = (F.col(left_t) - b_t) / (f_t - b_t)

    def at(c: str) -> Column:
        b, f = F.col(f"_b_{c}"), F.col(f"_f_{c}")
        return F.when(b_t.isNull(), f).when(f_t.isNull() | (f_t == b_t), b).otherwise(b + (f - b) * share)

    return both.withColumns({c: at(c) for c in columns}).drop(*[f"_{d}_{c}" for d in "bf" for c in names])


# ------------------------------------------------------------------------------------- segments, islands, changes
def gap_segments(df: DataFrame, keys: Sequence[str], t: str, gap: float | Column, out: str = "seg_start",
                 split: bool = False) -> DataFrame:
    """Add `out`, the start time of the row's segment: a new one begins after a step of more than `gap`."""
    gap = gap if isinstance(gap, Column) else F.lit(float(gap))
    scan = Ordered(df, keys, [t], split).running("_prev", "max", F.col(t), inclusive=False)
    starts = F.when(F.col("_prev").isNull() | (F.col(t) - F.col("_prev") > gap), F.col(t))
    return scan.running(out, "max", starts).rows().drop("_prev")


def interval_islands(df: DataFrame, keys: Sequence[str], start: str, end: str, tol: float | Column,
                     out: str = "island_start", tiebreak: Sequence[str] = (), split: bool = False) -> DataFrame:
    """Add `out`, the start of the row's island: intervals of a key chained while each begins at most `tol` after
    the latest end so far. Equals linking every pair with later start - earlier end <= tol (tol >= 0)."""
    tol = tol if isinstance(tol, Column) else F.lit(float(tol))
    scan = Ordered(df, keys, [start, end, *tiebreak], split).running("_reach", "max", F.col(end), inclusive=False)
    starts = F.when(F.col("_reach").isNull() | (F.col(start) - F.col("_reach") > tol), F.col(start))
    return scan.running(out, "max", starts).rows().drop("_reach")


def change_only(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, split: bool = False) -> DataFrame:
    """Rows whose `value` differs (null-safe) from the previous row of the key; the first row always stays."""
    scan = Ordered(df, keys, order, split).neighbour("_before", {"v": F.col(value)})
    rows = scan.rows()
    return rows.where(F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col(value))).drop("_before")


def open_close_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, event: str, reason: str,
                     open_value: str = "open", close_value: str = "close", split: bool = False) -> DataFrame:
    """One row per open event with the time and reason of the close that follows it in its key.

    A re-open without a close leaves the earlier row open (null close), as does the end of the data.
    """
    rows = df.where(F.col(event).isin(open_value, close_value))
    scan = Ordered(rows, keys, order, split).neighbour(
        "_next", {"t": F.col(t), "event": F.col(event), "reason": F.col(reason)}, after=True)
    closed = F.col("_next.event") == close_value
    return scan.rows().where(F.col(event) == open_value).withColumns({
        "close_t": F.when(closed, F.col("_next.t")), "close_reason": F.when(closed, F.col("_next.reason")),
    }).drop("_next")


def global_rank(df: DataFrame, order: Sequence[str | Column], out: str = "rank") -> DataFrame:
    """Add the 0-based rank over the whole table: range partitions ranked on their own plus the sizes before them.

    No task sees more than its range; the single-task step runs over one row per partition.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = materialize(df.repartitionByRange(*cols).withColumn(_BLOCK, F.spark_partition_id()), "rank")
    sizes = parts.groupBy(_BLOCK).agg(F.count("*").alias("_n"))
    before = W.orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(_BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy(_BLOCK).orderBy(*cols)) - 1
    return parts.withColumn("_inside", inside).join(F.broadcast(offsets), _BLOCK).withColumn(
        out, (F.col("_inside") + F.col("_offset")).cast("long")).drop(_BLOCK, "_inside", "_offset")

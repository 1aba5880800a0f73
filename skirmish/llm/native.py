"""Column expressions that Spark has no function for: regular expression matches with places, running values in arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Elements whose running values are built at once; keeps a scan of k elements near k * SCAN / 2 copies.
SCAN = 64
#: Code points per block of a text that is cut at many places.
BLOCK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, join: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element, `join` over all elements before it: within blocks, then over the blocks' totals."""

    def within(block: Column) -> Column:
        return F.aggregate(block, F.array(zero), lambda done, v: F.concat(done, F.array(join(F.element_at(done, -1), v))))

    def joined(inner: Column) -> Column:
        totals = F.aggregate(inner, F.array(zero), lambda done, block: F.concat(done, F.array(join(F.element_at(done, -1), F.element_at(block, -1)))))
        return let(totals, lambda before: F.flatten(F.transform(
            inner, lambda block, b: F.transform(F.slice(block, F.lit(1), F.size(block) - 1), lambda v: join(F.get(before, b), v)))))

    def blocked(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / SCAN).cast("int")), lambda b: within(F.slice(all_, b * SCAN + 1, SCAN)))
        return F.when(F.size(all_) > 0, let(blocks, joined)).otherwise(F.array().cast("array<int>"))

    return let(values, blocked)


def matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern from left to right, as array<struct<start, end, value>> in code points, end exclusive.

    The text between two matches and the matches themselves give the places: both come from the same scan of the pattern.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def placed(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["found"])), x["found"], lambda g, m: g + F.length(m))
        return let(F.struct(x["gaps"].alias("gaps"), x["found"].alias("found"), scan(steps, lambda a, b: a + b, F.lit(0)).alias("before")), lambda y: F.transform(
            y["found"], lambda m, i: F.struct((F.get(y["before"], i) + F.get(y["gaps"], i)).alias("start"),
                                              (F.get(y["before"], i) + F.get(y["gaps"], i) + F.length(m)).alias("end"), m.alias("value"))))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), let(F.struct(found.alias("found"), gaps.alias("gaps")), placed)).otherwise(none)


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK code points."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start..end-1 of a text given in blocks; reads only the blocks it lies in."""
    def part(b: Column, low: Column, high: Column) -> Column:
        return F.coalesce(F.substring(F.get(blocks, b), low + 1, high - low), F.lit(""))

    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    a, b = start - first * BLOCK, end - last * BLOCK
    across = F.concat(part(first, a, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), part(last, F.lit(0), b))
    return F.when(end <= start, F.lit("")).when(first == last, part(first, a, b)).otherwise(across)

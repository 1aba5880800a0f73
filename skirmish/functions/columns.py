"""Column expressions shared by the plans."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names and patterns that results depend on.
MATERIALS = {"W": "wood", "S": "brick", "M": "metal"}
DEFAULT_SHAPES = {"Solid": "wall", "Floor": "floor", "StairW": "stair", "RoofC": "cone"}
KNOWN_SHAPES = (
    "Solid", "Floor", "StairW", "RoofC", "Archway", "ArchwayLarge", "BalconyI", "BalconyS", "Brace", "DoorC", "DoorSide",
    "HalfWallS", "RoofO", "RoofS", "RoofWall", "StairF", "WindowC", "WindowSide", "Windows", "WindowsC", "WindowsSide",
)
PIECE_CLASS = r"^PBWA_([A-Z])(\d)_(.+)_C$"
NAME_TIME = r"(\d{4})\.(\d{2})\.(\d{2})-(\d{2})\.(\d{2})\.(\d{2})"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, null for unknown keys."""
    out = F.lit(None).cast("string")
    for k, v in reversed(list(table.items())):
        out = F.when(key == k, v).otherwise(out)
    return out


def extract(c: str | Column, pattern: str, group: int) -> Column:
    """Regex group, null where the pattern does not match."""
    return F.when(_c(c).rlike(pattern), F.regexp_extract(_c(c), pattern, group))


def piece_material(path: str | Column) -> Column:
    return lookup(extract(path, PIECE_CLASS, 1), MATERIALS)


def piece_shape(path: str | Column) -> Column:
    return extract(path, PIECE_CLASS, 3)


def piece_kind(shape: Column) -> Column:
    """wall | floor | stair | cone; null for a null shape. Unedited shapes first, then by name prefix."""
    name = F.lower(shape)
    by_prefix = (F.when(name.startswith("stair"), "stair").when(name.startswith("roof"), "cone")
                 .when(name.startswith("floor") | name.startswith("balcony"), "floor").otherwise("wall"))
    return F.when(shape.isNotNull(), F.coalesce(lookup(shape, DEFAULT_SHAPES), by_prefix))


def is_edited(shape: Column) -> Column:
    """True for any shape that is not an unedited one, an unknown (null) shape included."""
    return F.coalesce(~shape.isin(*DEFAULT_SHAPES), F.lit(True))


def unit_hash(salt: str, key: str | Column) -> Column:
    """Uniform in [0, 1): the first 12 hex digits of sha256('salt:key') over 16^12."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), _c(key)), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def half_even(c: str | Column) -> Column:
    """Nearest long, ties to even."""
    return F.bround(_c(c).cast("double"), 0).cast("long")


def distance(*deltas: Column) -> Column:
    total = sum((d * d for d in deltas[1:]), deltas[0] * deltas[0])
    return F.sqrt(total)


def id_suffix(c: str | Column) -> Column:
    """n of an id 'match:n'."""
    return F.substring_index(_c(c), ":", -1).cast("long")


def joined(members: Column) -> Column:
    """Sorted distinct members as one ';'-joined string."""
    return F.array_join(F.array_sort(F.array_distinct(members)), ";")


def iso_time(c: str | Column) -> Column:
    """ISO-8601 text as a UTC timestamp, null if it does not parse."""
    return F.try_to_timestamp(_c(c))


def name_time(c: str | Column) -> Column:
    """Timestamp embedded in a replay name (yyyy.MM.dd-HH.mm.ss), null if there is none or it is no date."""
    text = F.when(_c(c).rlike(NAME_TIME), F.regexp_replace(
        F.regexp_extract(_c(c), NAME_TIME, 0), NAME_TIME, r"$1-$2-$3 $4:$5:$6"))
    return F.try_to_timestamp(text)


def known_number(c: str | Column) -> Column:
    """The value with NaN as null (Spark's max and median would return NaN)."""
    return F.when(~F.isnan(_c(c)), _c(c))

"""From exported match folders to the processed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skirmish.operators.ordered import by_size
from skirmish.plans.fights import build_fight_sides, group_fights
from skirmish.plans.pieces import build_pieces
from skirmish.plans.pokes import build_pokes
from skirmish.schema import require_columns
from skirmish.session import materialize, tune
from skirmish.sources.tables import write_tables
from skirmish.sources.telemetry import PATTERN, elims_table, finished_matches, load_table


def derive(t: dict[str, DataFrame], split: bool) -> dict[str, DataFrame]:
    """pieces, fight_sides and pokes of the given matches; the damage is segmented once for both of the latter."""
    hits = materialize(group_fights(t["damage"], t["teams"], split=split), "hits")
    sides = materialize(build_fight_sides(
        t["damage"], t["teams"], t["elims"], t["players"], t["matches"], t["positions"], hits=hits, split=split), "fight_sides")
    return {
        "pieces": build_pieces(t["builds"], t["positions"], t["teams"], t["weapons"], split=split), "fight_sides": sides,
        "pokes": build_pokes(t["damage"], t["teams"], t["elims"], t["players"], t["positions"], sides, hits=hits, split=split),
    }


def build_tables(spark: SparkSession, telemetry_dir: str, pattern: str = PATTERN) -> dict[str, DataFrame]:
    """All processed tables. Only matches too large for one task pay for the plan that splits them."""
    tune(spark)
    finished = materialize(finished_matches(spark, telemetry_dir, pattern), "finished")
    if finished.isEmpty():
        raise ValueError(f"no finished match folders in {telemetry_dir}")
    names = {"matches": "meta", **{n: n for n in ("players", "positions", "damage", "health", "safezones", "teams", "weapons")}}
    tables = {table: load_table(spark, telemetry_dir, file, pattern, finished) for table, file in names.items()}
    eliminations, builds = (load_table(spark, telemetry_dir, n, pattern, finished) for n in ("eliminations", "builds"))
    require_columns({**tables, "eliminations": eliminations, "builds": builds})
    tables["elims"] = elims_table(eliminations)
    tables.update(by_size(derive, {**tables, "builds": builds}, ["damage", "positions", "builds"]))
    return tables


def build_and_write(spark: SparkSession, telemetry_dir: str, out_dir: str, pattern: str = PATTERN) -> list[str]:
    """Build, validate and write; raises before writing anything if a table is invalid."""
    return write_tables(build_tables(spark, telemetry_dir, pattern), out_dir)

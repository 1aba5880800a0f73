"""Reading per-match CSV folders, typed and tagged with the match; finished folders, pending work, rejected lines."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from skirmish.functions.columns import half_even
from skirmish.schema import TABLES, coerce
from skirmish.session import materialize

# File name -> table that types it.
SCHEMA_FOR = {
    "meta": "matches", "players": "players", "positions": "positions", "damage": "damage", "health": "health",
    "eliminations": "eliminations", "builds": "builds", "teams": "teams", "weapons": "weapons",
    "safezones": "safezones", "actor_classes": "actor_classes",
}
DONE_MARK = "meta"
PATTERN = "{dir}/*/{name}.csv"
CSV = {"quote": '"', "escape": '"', "multiLine": True}
"""How the exporter quotes: values with commas, quotes or line ends in quotes, quotes doubled."""
HEAD_BYTES = 1 << 16


def folder_of(path: Column, name: str) -> Column:
    """Match folder of a file path `<folder>/[key=]<name>.csv[/part...]`; a `match_id=` prefix is dropped."""
    plain = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    return F.regexp_extract(plain, rf"/(?:match_id=)?([^/]+)/(?:[^/=]+=)?{name}\.csv(?:/[^/]+)?$", 1)


def _files(spark: SparkSession, directory: str, name: str, pattern: str) -> str:
    return pattern.format(dir=directory.rstrip("/"), name=name)


def finished_matches(spark: SparkSession, directory: str, pattern: str = PATTERN) -> DataFrame:
    """`match_id` of the folders whose export finished (they hold meta.csv). Lists files, reads none."""
    glob = _files(spark, directory, DONE_MARK, pattern)
    try:
        found = spark.read.format("binaryFile").load(glob)
    except AnalysisException:
        return spark.createDataFrame([], "match_id string")
    return found.select(folder_of(F.col("path"), DONE_MARK).alias("match_id")).distinct()


def _head(source: fs.FileSystem, path: str) -> list[str] | None:
    """Names in the first record of a file; only the bytes up to its end are read. None if the file is empty."""
    with source.open_input_file(path) as file:
        size, n = file.size(), HEAD_BYTES
        while size:
            text = file.read_at(min(n, size), 0).decode("utf-8-sig", errors="ignore")
            names = next(csv.reader(io.StringIO(text, newline="")), None)
            rest = csv.reader(io.StringIO(text, newline=""))
            next(rest, None)
            if n >= size or next(rest, None) is not None:  # the record ends inside what was read
                return names
            n *= 2
    return None


def headers(spark: SparkSession, glob: str) -> DataFrame:
    """(file, names): the header of every file, its first record. One small task list; files are not read further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch["file"].to_pylist()
            names = [_head(*fs.FileSystem.from_uri(quote(unquote(p), safe=":/"))) for p in paths]
            yield pa.record_batch([batch["file"], pa.array(names, pa.list_(pa.string()))], ["file", "names"])

    files = spark.read.format("binaryFile").load(glob).select(F.col("_metadata.file_path").alias("file"))
    return files.mapInArrow(run, "file string, names array<string>").where(F.col("names").isNotNull())


def load_table(spark: SparkSession, directory: str, name: str, pattern: str = PATTERN, finished: DataFrame | None = None) -> DataFrame:
    """One table over all finished match folders: tagged with `match_id`, columns matched by name, typed.

    Line 1 of each file is its header, whatever it says; files may differ in column order and in which columns they have,
    undeclared ones included. A file without any declared column is refused by name. All files are read in one scan by
    position and named by their own header. `finished` reuses an earlier `finished_matches`.
    """
    table = SCHEMA_FOR.get(name)
    spec = TABLES[table].schema if table else T.StructType()
    empty = spark.createDataFrame([], T.StructType([T.StructField("match_id", T.StringType())] + [
        T.StructField(f.name, f.dataType) for f in spec.fields if f.name != "match_id"]))
    glob = _files(spark, directory, name, pattern)
    try:
        heads = materialize(headers(spark, glob), "headers")
    except AnalysisException:
        return empty
    # One entry per way a file can be laid out: as many as exporter versions, however many files.
    layouts = [list(r["names"]) for r in heads.groupBy("names").agg(F.min("file").alias("file")).orderBy("file").collect()]
    if not layouts:
        return empty
    declared = {f.name for f in spec.fields}
    for names in layouts:
        if declared and not declared & set(names):
            example = heads.where(F.col("names") == F.array(*map(F.lit, names))).first()["file"]
            raise ValueError(f"{name}: no declared column in the header of {example}")
    width = max(map(len, layouts))
    rows = spark.read.csv(glob, schema=", ".join(f"_c{i} string" for i in range(width)), header=True, enforceSchema=True, **CSV)
    rows = rows.select(*[F.nullif(f"_c{i}", F.lit("")).alias(f"_c{i}") for i in range(width)], F.col("_metadata.file_path").alias("_file"))
    columns = list(dict.fromkeys(c for x in layouts for c in x))
    if len(layouts) == 1:
        rows = rows.select(*[F.col(f"_c{layouts[0].index(c)}").alias(c) for c in columns], "_file")
    else:
        number = F.coalesce(*[F.when(F.col("names") == F.array(*map(F.lit, x)), i) for i, x in enumerate(layouts)])
        tagged = rows.join(heads.select(F.col("file").alias("_file"), number.alias("_layout")), "_file")

        def pick(c: str) -> Column:
            return F.coalesce(*[F.when(F.col("_layout") == i, F.col(f"_c{x.index(c)}")) for i, x in enumerate(layouts) if c in x]).alias(c)

        rows = tagged.select(*[pick(c) for c in columns], "_file")
    rows = rows.select(folder_of(F.col("_file"), name).alias("match_id"), *[F.col(f"`{c}`") for c in columns if c != "match_id"])
    rows = rows.join(finished_matches(spark, directory, pattern) if finished is None else finished, "match_id", "left_semi")
    return coerce(rows, table) if table else rows


def elims_table(eliminations: DataFrame) -> DataFrame:
    """Kill feed with millisecond times (ties to even), unknown `knocked` as false, weapon class as text."""
    return eliminations.select(
        "match_id", half_even(F.col("t") * 1000).alias("t_ms"), "eliminator", "eliminated",
        F.coalesce("knocked", F.lit(False)).alias("knocked"), F.col("gun_type").cast("string").alias("gun_type"))


def pending(source: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Source rows not exported yet (all of them if `force`)."""
    return source if force else source.join(done.select(key).distinct(), key, "left_anti")


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of CSV files: a line that does not fit the schema is kept aside, the rest go on."""
    base = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
    whole = T.StructType([*base.fields, T.StructField("_rejected", T.StringType())])
    rows = spark.read.schema(whole).options(header=header, mode="PERMISSIVE", columnNameOfCorruptRecord="_rejected", **CSV).csv(path)
    # A line is only parsed as far as its columns are asked for: every column takes part in both conditions (a hash is never null).
    parsed = F.hash(*[F.col(f"`{c}`") for c in base.names]) >= -(2**31)
    good = rows.where(F.col("_rejected").isNull() & parsed).drop("_rejected")
    return good, rows.where(F.col("_rejected").isNotNull() & parsed).select(F.col("_rejected").alias("line"))

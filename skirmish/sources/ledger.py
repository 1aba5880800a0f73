"""The ingest ledger: which incoming files are new by content, under which name, with which provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skirmish.schema import TABLES, coerce
from skirmish.sources.telemetry import CSV

# Allowed provenance and the note on backfilled rows.
SOURCES = ("local_demos", "donated", "tournament_ingame", "partner_osirion", "partner_other")
KINDS = ("client", "server", "unknown")
BACKFILL_NOTE = "backfilled: present before manifest existed"


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """`replay_file, sha256, size_bytes` of the files at `path` (a folder or glob)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("replay_file"), F.sha2("content", 256).alias("sha256"),
                        F.col("length").alias("size_bytes"))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The stored manifest, every column read as text and then typed."""
    names = TABLES["manifest"].names
    return coerce(spark.read.csv(path, schema=", ".join(f"{c} string" for c in names), header=True, **CSV), "manifest")


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select(*TABLES["manifest"].names).write.mode("overwrite").csv(path, header=True, quote=CSV["quote"], escape=CSV["escape"])


def import_files(incoming: DataFrame, stored: DataFrame, manifest: DataFrame, *, source: str = "local_demos", kind: str = "client",
                 contributor: str | None = None, consent: str | None = None, notes: str | None = None,
                 acquired_at: str | None = None) -> DataFrame:
    """Manifest rows to add, with `action` (backfilled | copied | duplicate) and `original_file`.

    Stored files the manifest does not list are backfilled first and count as known. An incoming file whose content
    is known, or was seen under an earlier name in this batch, is a duplicate. A new one whose name is taken by
    other content is stored as `stem-<first 8 hash digits>.ext`.
    """
    if source not in SOURCES or kind not in KINDS:
        raise ValueError(f"unknown source or kind: {source}, {kind}")
    if source == "donated" and not consent:
        raise ValueError("donated files need a consent record")
    at = F.lit(acquired_at) if acquired_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    backfill = stored.join(manifest.select("replay_file"), "replay_file", "left_anti")
    known = manifest.select("sha256").where(F.col("sha256").isNotNull()).unionByName(backfill.select("sha256")).distinct()
    # The first name of every content; aggregated before the shuffle, so many copies of one file cost nothing extra.
    first = incoming.groupBy("sha256").agg(F.min("replay_file").alias("_first"))
    fresh = first.join(known, "sha256", "left_anti").withColumn("_new", F.lit(True))
    marked = incoming.join(fresh, "sha256", "left").withColumn(
        "action", F.when(F.col("_new") & (F.col("replay_file") == F.col("_first")), "copied").otherwise("duplicate"))
    taken = stored.select("replay_file").distinct().withColumn("_taken", F.lit(True))
    name = F.col("replay_file")
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    renamed = F.concat(stem, F.lit("-"), F.substring("sha256", 1, 8), ext)
    named = marked.join(taken, "replay_file", "left").select(
        F.when(F.col("_taken") & (F.col("action") == "copied"), renamed).otherwise(name).alias("replay_file"), "sha256", "size_bytes",
        "action", name.alias("original_file"), F.lit(notes).cast("string").alias("notes"))
    old = backfill.select("replay_file", "sha256", "size_bytes", F.lit("backfilled").alias("action"),
                          F.col("replay_file").alias("original_file"), F.lit(BACKFILL_NOTE).alias("notes"))
    return old.unionByName(named).withColumns({
        "source": F.lit(source), "replay_kind": F.lit(kind), "contributor": F.lit(contributor).cast("string"),
        "consent_ref": F.lit(consent).cast("string"), "acquired_at": at}).select(
        *TABLES["manifest"].names, "action", "original_file")


def extend_manifest(manifest: DataFrame, imported: DataFrame) -> DataFrame:
    """The manifest with the backfilled and copied rows added."""
    names = TABLES["manifest"].names
    return coerce(manifest.select(*names).unionByName(imported.where(F.col("action") != "duplicate").select(*names)), "manifest")



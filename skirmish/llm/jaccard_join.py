"""Jaccard self join of documents on word shingles, and the classes of near-duplicates it gives.

Method (Bayesian candidate pruning): texts with equal shingle sets are one representative. Representatives that agree on a
band of MinHash values are candidates. The MinHash values of a candidate pair are compared `STEP` at a time; after each step
the pair is dropped if, with a uniform prior, the posterior probability that its similarity reaches the threshold is below
`TOLERANCE`. What is left is verified exactly on the shingle sets. A pair at the threshold shares a band with probability
1 - (1 - 0.8^4)^32 = 1 - 5e-8, and more similar pairs more surely.

No pair of documents is ever a row. A bucket is dealt into blocks of about `MEMBERS` by hash, however large it is, and each
pair of blocks is one small group in some task, which compares its pairs in numpy and gives one row per member: the number
of its links and one edge toward its class. A pair that shares several bands is treated only in the first of them. Signatures
travel to the groups first; shingle sets are made again, from the texts, only for the groups where a pair is left. Classes are components
over those edges. The intermediate tables are stored in the shared folder.

Defined cases: a null or empty text has no shingles, links to nothing and is a class of its own. One to four words are one
shingle. Repeated rows and repeated or null doc_id are documents of their own; class_id is the least doc_id of the class,
null if it has none. Other columns are ignored by `link`, kept by `drop_near_duplicates`. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from skirmish.llm.common import chunks, materialize, text_values
from skirmish.llm.shingles import BAND, HASHES, bands, shingle_sets, signatures

THRESHOLD, TOLERANCE, STEP, MEMBERS = 0.8, 1e-6, 16, 256
#: Pairs compared at once.
PAIRS = 20_000
GROUP = ("band", "value", "low", "high")
_GROUP_SCHEMA = "band int, value long, low int, high int"


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of compared values, the fewest matches at which a pair goes on.

    With a uniform prior, P(similarity >= t | m of n match) is the probability that n + 1 trials of chance t succeed at most m times.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        out[n] = m
    return out


def _content(key: str, text: str) -> list:
    """Two hashes of id and text: together the identity of a row, for finding it again in its table."""
    k, t = F.col(key).cast("long"), F.col(text).cast("string")
    return [F.xxhash64(k, t).alias("k1"), F.xxhash64(t, F.lit(1), k).alias("k2")]


def describe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored (row, doc_id, k1, k2, print, signature) per document; `print` names the shingle set, null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1_000_000):
            sets = shingle_sets(text_values(batch["text"]))
            full = [i for i, s in enumerate(sets) if len(s)]
            rows = dict(zip(full, signatures([sets[i] for i in full])))
            raw = [s.tobytes() for s in sets]
            prints = [hashlib.blake2b(b, digest_size=16).digest() if b else None for b in raw]
            signed = [rows[i].tobytes() if i in rows else None for i in range(len(sets))]
            yield pa.record_batch([batch["doc_id"], batch["k1"], batch["k2"], *(pa.array(x, pa.binary()) for x in (prints, signed))],
                                  ["doc_id", "k1", "k2", "print", "signature"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *_content(key, text))
    return materialize(rows.mapInArrow(run, "doc_id long, k1 long, k2 long, print binary, signature binary")
                       .withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")


def shingled(docs: DataFrame, wanted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, signature, shingles) of the wanted (k1, k2, row, signature), from their texts: sets are made again for the few
    documents that need them rather than stored for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1_000_000):
            raw = [s.tobytes() for s in shingle_sets(text_values(batch["text"]))]
            yield pa.record_batch([batch["row"], batch["signature"], pa.array(raw, pa.binary())], ["row", "signature", "shingles"])

    texts = docs.select(*_content(key, text), F.col(text).cast("string").alias("text"))
    once = texts.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return materialize(once.select("row", "signature", "text").mapInArrow(run, "row long, signature binary, shingles binary"), "jaccard-shingles")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups, as many as a batch holds: the rows come sorted by group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in GROUP:
            values = batch[c].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        if held and any(held[-1][c][held[-1].num_rows - 1] != batch[c][0] for c in GROUP):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _group_numbers(table: pa.Table) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    for c in GROUP:
        values = table[c].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def _survivors(table: pa.Table, least: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same group that are first candidates there and survive the pruning, in bounded portions."""
    n = table.num_rows
    sig = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(n, HASHES)
    keys, band = bands(sig), table["band"].to_numpy()
    own = table["block"].to_numpy()
    mixed = table["low"].to_numpy() != table["high"].to_numpy()
    number = _group_numbers(table)
    end = np.searchsorted(number, number, side="right")  # where each row's group ends
    partners = end - np.arange(n) - 1
    first = 0
    while first < n:
        done = np.cumsum(partners[first:])
        last = first + max(1, int(np.searchsorted(done, PAIRS, side="right")))
        a = np.repeat(np.arange(first, last), partners[first:last])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(partners[first:last]) - partners[first:last], partners[first:last])
        first = last
        keep = ~mixed[a] | (own[a] != own[b])
        a, b = a[keep], b[keep]
        keep = (keys[a] == keys[b]).argmax(1) == band[a]
        a, b = a[keep], b[keep]
        matches = np.zeros(len(a), np.int64)
        for k in range(0, HASHES, STEP):
            matches += (sig[a, k:k + STEP] == sig[b, k:k + STEP]).sum(1)
            keep = matches >= least[k + STEP]
            a, b, matches = a[keep], b[keep], matches[keep]
        if len(a):
            yield a, b


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Common shingles of every two of a few sets: products of the incidence matrix over what occurs more than once."""
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[shared]
    _, column = np.unique(column[shared], return_inverse=True)
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out


def link(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, copy_id, n_links, n_text_links, and the keys of its row and class) per document.

    class_id: the least doc_id of all that links connect; copy_id: the least doc_id among equal shingle sets; n_links: other
    documents of at least the threshold's similarity, copies included; n_text_links: distinct other shingle sets among them.
    """
    sets = describe(docs, key, text)
    least = least_matches(threshold, TOLERANCE)
    reps = materialize(sets.filter(F.col("print").isNotNull()).groupBy("print").agg(
        F.min("row").alias("row"), F.count("*").alias("copies"), F.min("doc_id").alias("copy_id")), "jaccard-representatives")
    signed = materialize(sets.select("row", "signature").join(reps.select("row", "copies"), "row"), "jaccard-signatures")

    def band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = HASHES // BAND
        for batch in batches:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint16).reshape(n, HASHES)
            yield pa.record_batch([pa.array(np.tile(np.arange(per, dtype=np.int32), n)), pa.array(bands(sig).view(np.int64).ravel()),
                                   batch["row"].take(pa.array(np.repeat(np.arange(n), per)))], ["band", "value", "row"])

    banded = signed.select("row", "signature").mapInArrow(band_rows, "band int, value long, row long")
    buckets = banded.groupBy("band", "value").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / MEMBERS).cast("int")
    dealt = (banded.join(buckets, ["band", "value"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("band", "value", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "row"))

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition(*GROUP).sortWithinPartitions(*GROUP, "row")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            used = np.zeros(table.num_rows, bool)
            for a, b in _survivors(table, least):
                used[a] = used[b] = True
            if used.any():
                yield from table.select([*GROUP, "block", "row"]).filter(pa.array(used)).combine_chunks().to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            n, rows, copies = table.num_rows, table["row"].to_numpy(), table["copies"].to_numpy()
            shingles = table["shingles"].combine_chunks()
            links, texts, root = np.zeros(n, np.int64), np.zeros(n, np.int64), rows.copy()
            pairs = list(_survivors(table, least))
            if not pairs:
                continue
            a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            group = _group_numbers(table)
            of_pair = group[a]
            for g in np.unique(of_pair):
                low, high = np.searchsorted(group, [g, g + 1])
                mine = slice(*np.searchsorted(of_pair, [g, g + 1]))
                i, j = a[mine] - low, b[mine] - low
                sets_ = [np.frombuffer(shingles[k].as_buffer(), np.uint64) for k in range(low, high)]
                size = np.array([len(s) for s in sets_])
                common = _overlaps(sets_)[i, j]
                close = common >= threshold * (size[i] + size[j] - common) - 1e-9
                i, j = i[close], j[close]
                np.add.at(texts, low + np.concatenate([i, j]), 1)
                np.add.at(links, low + np.concatenate([i, j]), copies[low + np.concatenate([j, i])])
                label = np.arange(high - low)
                while True:
                    before = label.copy()
                    np.minimum.at(label, i, before[j])
                    np.minimum.at(label, j, before[i])
                    if (label == before).all():
                        break
                root[low:high] = rows[low + label]
            linked = texts > 0
            if linked.any():
                yield pa.record_batch([pa.array(x[linked]) for x in (rows, links, texts, root)], ["row", "links", "texts", "root"])

    active = materialize(grouped(dealt.join(signed.select("row", "signature"), "row")).mapInArrow(prune, f"{_GROUP_SCHEMA}, block int, row long"), "jaccard-active")
    wanted = sets.select("k1", "k2", "row", "signature").join(active.select("row").distinct(), "row")
    carried = active.join(shingled(docs, wanted, key, text), "row").join(reps.select("row", "copies"), "row")
    verified = materialize(grouped(carried).mapInArrow(verify, "row long, links long, texts long, root long"), "jaccard-links")

    totals = verified.groupBy("row").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    roots = components(verified.filter("row <> root").select(F.col("row").alias("a"), F.col("root").alias("b")))
    classes = reps.join(roots.withColumnRenamed("a", "row"), "row", "left").withColumn("root", F.coalesce("b", "row")).drop("b").join(totals, "row", "left")
    least_id = classes.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    known = classes.join(least_id, "root").select("print", "class_id", "copy_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"), "root")
    out = sets.select("doc_id", "k1", "k2", "print", "row").join(known, "print", "left")
    alone = F.col("print").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
                      F.when(alone, F.lit(0)).otherwise(F.col("copies") - 1 + F.col("links")).cast("long").alias("n_links"),
                      F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"), F.coalesce("root", "row").alias("class_row"), "row", "k1", "k2")


def components(edges: DataFrame) -> DataFrame:
    """(a, b): for each vertex that is not the least of its component, that least one. By large and small stars, stored per round."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "jaccard-edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = mark(edges)
    while now[0]:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()
        edges = materialize(small, "jaccard-edges")
        before, now = now, mark(edges)
        if now == before:
            break
    return edges


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with its own columns: the one of least doc_id (nulls last). Texts without words all stay, but for
    repeated rows of one doc_id."""
    found = link(docs, threshold, key, text)
    # partial aggregates: a large class sends one row per task
    best = found.groupBy("class_row").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")).select("best.row")
    kept = found.join(best, "row", "left_semi").select("k1", "k2").distinct()
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = docs.select(whole, *_content(key, text)).join(kept, ["k1", "k2"])
    return rows.withColumn("n", F.row_number().over(W.partitionBy("k1", "k2").orderBy("k1"))).filter("n = 1").select("doc.*")

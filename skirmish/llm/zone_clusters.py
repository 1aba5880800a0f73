"""Centroid clustering in whole numbers over zone maps in Hilbert order.

Method: vectors are placed along a Hilbert curve, range-partitioned by their place on it and cut into blocks that store the
least and greatest value of every component. In each round the box of a block bounds its distance to every centroid from both
sides: a centroid whose least distance to the box exceeds another's greatest one can win no vector of the block. The rest are
the block's candidates and are compared exactly, all vectors of the block at once. Tasks hand on sums per cluster only.

All arithmetic is exact. Components are floor(scale * x); squared distances of components up to 2^22 fit the whole numbers of a
double, so blocks use one matrix product; blocks with larger ones use 64-bit integers. Sums go through decimals.

Stored once: the numbers, and the blocks. Rounds read only blocks, the driver holds k centroids.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component are left out, and so are those
with a component beyond 2^27 after scaling, whose distances no long could hold. Repeated rows and repeated ids count each on
their own; a null id hashes as an empty text. Starting vectors of equal hash are taken by id, then components. With fewer than k
vectors there are as many centroids; with none the result is empty. An inertia beyond a long is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skirmish.llm.common import materialize

#: Vectors per block.
BLOCK = 256
#: Bits per component that the curve looks at.
BITS = 4
#: Greatest scaled component.
LARGEST = 1 << 27
#: Up to this, sums of squares are exact in doubles.
EXACT = 1 << 22


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with `bits` bits per component (rows x components), as rows of bytes to be
    compared from the left. The usual transform between axes and curve, for all points at once."""
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = np.uint32(q - 1)
        for i in range(n):
            set_ = (x[i] & q) != 0
            swapped = np.where(set_, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(set_, low, swapped)
            x[i] ^= swapped
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where(x[-1] & q, np.uint32(q - 1), np.uint32(0))
    x ^= flip
    planes = np.stack([(x >> b & 1).astype(np.uint8) for b in range(bits - 1, -1, -1)])  # highest bits of all components first
    return np.packbits(planes.reshape(bits * n, -1).T, axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids that may be nearest to some vector of the box."""
    below, above = low - centroids, centroids - high
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(1)
    greatest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(1)
    return np.flatnonzero(least <= greatest.min())


def nearest(vectors: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to each vector's nearest centroid; the smaller number among equals."""
    may = candidates(low, high, centroids)
    own = centroids[may]
    if max(-int(low.min()), int(high.max()), int(np.abs(own).max())) <= EXACT:
        v, c = vectors.astype(np.float64), own.astype(np.float64)
        squared = (v * v).sum(1)[:, None] + (c * c).sum(1) - 2 * (v @ c.T)
    else:
        squared = np.stack([((vectors - c) ** 2).sum(1) for c in own], axis=1)
    best = squared.argmin(1)
    return may[best].astype(np.int32), squared[np.arange(len(best)), best].astype(np.int64)


def _rows(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dimensions).astype(np.int64)


def _binaries(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def whole_vectors(df: DataFrame, dimensions: int, scale: float, salt: str, key: str, vector: str) -> DataFrame:
    """(vec_id, hash, vector, low, high): usable vectors as 32-bit whole numbers, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            with np.errstate(over="ignore"):
                whole = np.floor(scale * values)
            fits = (np.abs(whole) <= LARGEST).all(1)
            whole = whole[fits].astype("<i4")
            rest = batch.filter(pa.array(fits))
            yield pa.record_batch([rest["vec_id"], rest["hash"], _binaries(whole), pa.array(whole.min(1, initial=LARGEST)), pa.array(whole.max(1, initial=-LARGEST))],
                                  ["vec_id", "hash", "vector", "low", "high"])

    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    usable = (F.size("vector") == dimensions) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    kept = rows.where(F.coalesce(usable, F.lit(False))).select("vec_id", hashed.alias("hash"), "vector")
    return materialize(kept.mapInArrow(run, "vec_id long, hash string, vector binary, low int, high int"), "whole-vectors")


def zone_blocks(whole: DataFrame, dimensions: int, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """(ids, vectors, low, high): vectors in Hilbert order, cut into blocks with their boxes, stored."""
    least, greatest = whole.agg(F.min("low"), F.max("high")).first()
    least, width = least or 0, max(1, (greatest or 0) - (least or 0) + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0  # equal vectors are dealt by their number within the task, so no place makes a large partition
        for batch in batches:
            cells = (_rows(batch["vector"], dimensions) - least) * (1 << bits) // width
            yield pa.record_batch([batch["vec_id"], batch["vector"], _binaries(hilbert_keys(cells, bits)), pa.array(np.arange(done, done + batch.num_rows))],
                                  ["vec_id", "vector", "place", "turn"])
            done += batch.num_rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, block):
                part = batch.slice(first, block)
                rows = _rows(part["vector"], dimensions).astype("<i4")
                ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), part["vec_id"])
                yield pa.record_batch([ids, pa.array([rows.tobytes()], pa.binary()), _binaries(rows.min(0)[None]), _binaries(rows.max(0)[None])],
                                      ["ids", "vectors", "low", "high"])

    placed = whole.select("vec_id", "vector").mapInArrow(place, "vec_id long, vector binary, place binary, turn long")
    ordered = placed.repartitionByRange("place", "turn").sortWithinPartitions("place", "turn")
    return materialize(ordered.select("vec_id", "vector").mapInArrow(cut, "ids array<long>, vectors binary, low binary, high binary"), "zone-blocks")


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
    """(ids, vectors, cluster, distance) per block."""
    dimensions = centroids.shape[1]
    for batch in batches:
        lows, highs = _rows(batch["low"], dimensions), _rows(batch["high"], dimensions)
        for i in range(batch.num_rows):
            vectors = np.frombuffer(batch["vectors"][i].as_py(), "<i4").reshape(-1, dimensions).astype(np.int64)
            yield batch["ids"][i].values, vectors, *nearest(vectors, lows[i], highs[i], centroids)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the floor of its vectors' mean; those without vectors stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, vectors, cluster, _ in _assigned(batches, centroids):
            counts += np.bincount(cluster, minlength=len(centroids))
            for c in np.unique(cluster):
                sums[c] += vectors[cluster == c].sum(0)
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(counts[seen]), pa.array(sums[seen].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    partial = blocks.mapInArrow(run, "cluster int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in partial.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():  # a row per centroid
        out[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(centroids.shape[1])]
    return out


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: float = 64, salt: str = "1",
            key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector."""
    whole = whole_vectors(df, dimensions, scale, salt, key, vector)
    first = whole.select("hash", "vec_id", "vector").orderBy("hash", F.asc_nulls_last("vec_id"), "vector").limit(k).collect()
    centroids = np.array([np.frombuffer(r["vector"], "<i4") for r in first], np.int64).reshape(-1, dimensions)
    blocks = zone_blocks(whole, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(blocks, centroids)
    final = centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, number, distance in _assigned(batches, final):
            yield pa.record_batch([ids, pa.array(number), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = materialize(blocks.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("sum")).collect()  # a row per centroid
    total, text = sum(int(r["sum"]) for r in sums), lambda c: ",".join(map(str, c.tolist()))
    long = lambda n: n if n < 1 << 63 else None
    found = [(r["cluster"], long(int(r["sum"])), long(total), hashlib.sha256(text(final[r["cluster"]]).encode()).hexdigest()) for r in sums]
    verdicts = df.sparkSession.createDataFrame(found, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(verdicts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Approximate nearest neighbours by a forest of long hash strings.

Method (hash-prefix forest): in each of `TREES` trees every vector gets a string of `SYMBOLS` hashes of one bit (the side of
the axes of a random rotation it lies on), read as a long number, so that a tree is the sorted array of its strings. A
query descends in each array to its longest matching prefix; all trees then ascend together, one symbol at a time, until they
hold enough distinct vectors between them, and every vector below those prefixes is compared exactly. One bit a step keeps
what is compared within about twice of what is asked for.

Enough is a share of the index by one rule for every size (`wanted`): the share a query has to see for a given recall falls only
slowly as the index grows, so a fixed number would lose recall. On random directions it is large (the README has the figures);
nothing less reaches the recall there.

The index is dealt into blocks of about `BLOCK` vectors, each a forest of its own, and every query searches each of them for its
share. Queries with their strings are stored once in the shared folder; the task of a block reads them from there in batches of
`BATCH`, so vectors are shuffled once, queries never, and neither candidates nor pairs are ever rows: a block returns at most `k`
rows per query. Equal vectors are indexed once with their `k + 1` smallest ids, which is all that an answer can use. Everything is
indexed and no bucket is capped.

Defined cases: vectors that are null, empty, zero, hold null or non-finite parts, or differ in length from the most common
length take no part; rows without an id neither. Several rows of one id count as one if equal; otherwise each takes part.
A query never finds its own id. Ties go to the smaller id. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skirmish.llm.common import materialize, spans_of
from skirmish.llm.token_files import filesystem
from skirmish.session import scratch_path

TREES, SYMBOLS = 64, 30
#: The distinct vectors a query has to reach in an index of n: FACTOR * n ** POWER, and CANDIDATES at least (all, if there are fewer).
FACTOR, POWER, CANDIDATES = 1.7, 0.85, 256
BLOCK, BATCH = 16384, 4096
SEED = 17


@lru_cache(maxsize=2)
def _axes(trees: int, symbols: int, width: int) -> np.ndarray:
    """(trees, width, symbols): columns of random rotations, a tree's own at right angles as far as the width goes."""
    random = np.random.default_rng(SEED)
    rotation = lambda: np.linalg.qr(random.standard_normal((width, width)))[0]
    return np.stack([np.concatenate([rotation() for _ in range(-(-symbols // width))], 1)[:, :symbols] for _ in range(trees)]).astype(np.float32)


def hash_strings(x: np.ndarray, trees: int, symbols: int) -> np.ndarray:
    """(rows, trees) of long numbers: `symbols` bits each, 30 at most, the first symbol highest."""
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    values = 1 << np.arange(symbols - 1, -1, -1, dtype=np.int32)
    return np.stack([(unit @ axes > 0) @ values for axes in _axes(trees, symbols, x.shape[1])], 1).astype(np.int32)


def wanted(total: int, candidates: int = CANDIDATES) -> float:
    """The distinct vectors that a query has to reach in an index of `total`."""
    return min(total, max(candidates, FACTOR * total ** POWER))


class Forest:
    """The sorted arrays of one block."""

    def __init__(self, strings: np.ndarray, symbols: int):
        self.symbols, self.size = symbols, len(strings)
        self.order = np.argsort(strings, axis=0, kind="stable").T
        self.trees = np.take_along_axis(strings.T, self.order, 1)
        self.entries = self.order.ravel()

    def descend(self, query: np.ndarray) -> np.ndarray:
        """Length of the longest prefix that each query string shares with a string of its tree: one of its two neighbours has it."""
        best = np.zeros(query.shape, np.int64)
        for t, tree in enumerate(self.trees):
            at = np.searchsorted(tree, query[:, t])
            for near in (np.maximum(at - 1, 0), np.minimum(at, self.size - 1)):
                differs = np.frexp((tree[near] ^ query[:, t]).astype(np.float64))[1]  # bits up to the first that differs
                best[:, t] = np.maximum(best[:, t], self.symbols - differs)
        return best

    def ranges(self, query: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First entry and number of entries below the prefixes of `level` symbols, per query and tree."""
        below = self.symbols - level
        low = query.astype(np.int64) >> below << below
        starts, ends = np.empty(low.shape, np.int64), np.empty(low.shape, np.int64)
        for t, tree in enumerate(self.trees):
            starts[:, t] = np.searchsorted(tree, low[:, t]) + t * self.size
            ends[:, t] = np.searchsorted(tree, low[:, t] + (np.int64(1) << below)) + t * self.size
        return starts, ends - starts

    def search(self, query: np.ndarray, need: int) -> Iterator[tuple[int, np.ndarray]]:
        """(query, vectors): what the trees hold where they have ascended to `need` distinct vectors between them."""
        waiting = np.arange(len(query))
        deepest = self.descend(query).max(1)
        for level in range(self.symbols, -1, -1):
            now = waiting[deepest[waiting] >= level]
            if not len(now):
                continue
            starts, sizes = self.ranges(query[now], level)
            done = []
            for i in np.flatnonzero(sizes.sum(1) >= need):  # entries repeat from tree to tree: count vectors
                hit = np.zeros(self.size, bool)
                hit[self.entries[spans_of(starts[i], sizes[i])]] = True
                if (at := np.flatnonzero(hit)).size >= need:
                    yield int(now[i]), at
                    done.append(now[i])
            waiting = np.setdiff1d(waiting, done)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (common["n"] if common else 0))


def search(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", trees: int = TREES,
           symbols: int = SYMBOLS, candidates: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found of each row that `is_query` (over vec_id) picks."""
    rows = usable(vectors, key, vector)
    first = W.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    distinct = materialize(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("vid", F.element_at("ids", 1)), "ann-vectors")
    total = distinct.count()
    blocks, share = max(1, -(-total // BLOCK)), wanted(total, candidates) / max(total, 1)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h = hash_strings(_matrix(batch["v"]), trees, symbols)
                strings = pa.ListArray.from_arrays(np.arange(0, h.size + 1, trees, dtype=np.int32), pa.array(h.ravel()))
                yield pa.record_batch([*batch.columns, strings], [*batch.schema.names, "strings"])

    asked = rows.filter(is_query).distinct().withColumn("query", F.monotonically_increasing_id()).select("query", F.col("vec_id").alias("query_id"), "v")
    folder = scratch_path(distinct.sparkSession, "ann-queries")
    asked.mapInArrow(hashed, "query long, query_id long, v array<double>, strings array<int>").write.parquet(folder)

    def nearest(group: pa.Table) -> pa.Table:
        """Exact distances of the candidates in one block, for all queries."""
        x, ids = _matrix(group["v"]), group["ids"].to_pylist()
        forest, out = Forest(hash_strings(x, trees, symbols), symbols), []
        need = min(len(x), int(np.ceil(share * len(x))))
        source, base = filesystem(folder)
        files = [f.path for f in source.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet")]
        for path in sorted(files):
            for batch in parquet.ParquetFile(source.open_input_file(path)).iter_batches(BATCH):
                points, numbers, own = _matrix(batch["v"]), batch["query"].to_pylist(), batch["query_id"].to_pylist()
                for i, at in forest.search(_matrix(batch["strings"]), need) if batch.num_rows else ():
                    distance = np.sqrt(((x[at] - points[i]) ** 2).sum(1))
                    keep = np.flatnonzero(distance <= np.partition(distance, k)[k]) if len(distance) > k + 1 else np.arange(len(distance))
                    best = sorted((distance[j], m) for j in keep for m in ids[at[j]] if m != own[i])[:k]
                    out += [(numbers[i], own[i], m, float(d)) for d, m in best]
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                        ["query", "query_id", "vec_id", "score"])

    placed = distinct.select("v", "ids", F.pmod(F.xxhash64("vid", "v"), F.lit(blocks)).cast("int").alias("block"))
    found = placed.groupBy("block").applyInArrow(nearest, "query long, query_id long, vec_id long, score double")
    best = found.distinct().withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("score", "vec_id")))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

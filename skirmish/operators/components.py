"""Connected components of graphs whose edges come in groups that never share a vertex with another group.

Two levels, exact for any size:

1. Edges of one group (of one range block of it, if groups can be large) are solved together in one task, with a
   vectorised min-label pass. Blocks are bounded by the range partitioning, so no task sees an unbounded group.
2. Vertices that occur in several blocks tie the block-local answers together. Those ties form a much smaller
   graph, solved by alternating large-star / small-star rounds (Kiveris et al., "Connected Components in MapReduce
   and Beyond", SoCC 2014), each a pair of shuffles with map-side minimum. Without blocks there are no ties.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from skirmish.operators.ordered import _BLOCK
from skirmish.session import materialize


def connected_components(edges: DataFrame, group: Sequence[str], u: tuple[str, str], v: tuple[str, str],
                         root: tuple[str, str], split: bool = False, within: Sequence[str] = ()) -> DataFrame:
    """Edges with two more columns, the smallest vertex of the edge's component.

    A vertex is a pair (double, long) given by the column names in `u` and `v`; order is by the double first.
    `within` names columns (settings of a sweep) that keep graphs of one group apart: each is a group of its own.
    """
    rows, group = edges, [*group, *within]
    tasks = list(group)
    if split:
        # Parallel edges say nothing new; without them every edge is distinct and the ranges can be cut anywhere.
        ends = [*group, *u, *v]
        edges = materialize(edges.select(*ends).distinct().repartitionByRange(*ends).withColumn(_BLOCK, F.spark_partition_id()), "edge-blocks")
        tasks = [*tasks, _BLOCK]
    schema = T.StructType([*edges.schema.fields, T.StructField(root[0], T.DoubleType()), T.StructField(root[1], T.LongType())])

    # Both functions stay local so that they travel to the executors by value.
    def min_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
        """Smallest vertex number of each vertex's component."""
        label = np.arange(n)
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            for side in (u, v):
                np.minimum.at(new, label[side], low)
                np.minimum.at(new, side, low)
            new = new[new]
            if np.array_equal(new, label):
                return label
            label = new

    def solve(rows: pa.Table) -> pa.Table:
        first = np.concatenate([rows[u[0]].to_numpy(), rows[v[0]].to_numpy()])
        second = np.concatenate([rows[u[1]].to_numpy(), rows[v[1]].to_numpy()])
        order = np.lexsort((second, first))
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([c[order][1:] != c[order][:-1] for c in (second, first)], axis=0)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        n = rows.num_rows
        label = min_labels(number[:n], number[n:], int(fresh.sum()))[number[:n]]
        return rows.append_column(root[0], pa.array(first[order][fresh][label])).append_column(
            root[1], pa.array(second[order][fresh][label]))

    local = edges.groupBy(*tasks).applyInArrow(solve, schema)
    if not split:
        return local
    local = materialize(local, "local-components")
    def vertex(names: tuple[str, str]):
        return F.struct(F.col(names[0]).alias("a"), F.col(names[1]).alias("b"))

    seen = local.select(*group, F.explode(F.array(vertex(u), vertex(v))).alias("_vertex"), vertex(root).alias("_root"))
    # The smallest root a vertex was given in any block is tied to the others.
    low = seen.groupBy(*group, "_vertex").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high")).where(
        F.col("_low") != F.col("_high")).select(*group, "_vertex", "_low")
    ties = seen.join(low, [*group, "_vertex"]).where(F.col("_root") != F.col("_low"))
    final = _stars(ties.select(F.struct(*group, "_root").alias("x"), F.struct(*group, F.col("_low").alias("_root")).alias("y")))
    here = F.struct(*group, vertex(root).alias("_root"))
    out = local.withColumn("_here", here).join(final, F.col("_here") == F.col("_node"), "left")
    solved = out.select(*ends, F.coalesce("_to._root.a", root[0]).alias(root[0]), F.coalesce("_to._root.b", root[1]).alias(root[1]))
    return rows.join(solved, ends)


def _stars(links: DataFrame) -> DataFrame:
    """(_node, _to): every vertex that is not the smallest of its component, with that smallest vertex.

    Starts from links (x, y); each round keeps connectivity and ends as stars around the smallest vertices.
    """
    e = materialize(links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct(), "links")
    mark = None
    while True:
        both = e.select(F.inline(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.inline(F.array(
            F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct(F.col("x").alias("x"), F.col("m").alias("y")))))
        e = materialize(small.where("x <> y").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            return e.select(F.col("x").alias("_node"), F.col("y").alias("_to"))
        mark = tuple(now)

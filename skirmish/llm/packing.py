"""Best-fit packing of documents into training sequences of several permitted lengths.

Method (variable-capacity best fit): documents are cut into pieces of at most the largest length and taken by falling size.
A piece goes into the open bin whose remaining room is smallest but sufficient; where none fits, a bin is opened, and at the
end each bin shrinks to the least permitted length that holds its contents. Which length to open is optimised jointly: an
opening rule names one length per class of sizes (those whose least fitting length is the same). From the best of the rules
that open one length wherever it fits, the class whose change saves most total cost, fitted and shrunk, is changed until none
saves. The rule of least cost per token given what is left is tried as well. So a group never costs more than with any one
length.

Pieces are dealt into groups of about `GROUP` pieces by row number, never by a key, and each group is packed by one task, so
no key makes a large group; the loss against one packing of everything is at most the open bins of each group. Token counts
are stored first, so a repeated task sees the same rows and gives the same bins.

Defined cases: null and empty texts have no tokens and one empty piece with no bin. Repeated rows and null doc_id are packed
as they stand; pieces of equal size are taken by doc_id, then start. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skirmish.llm.common import chunks, materialize, text_values
from skirmish.llm.tokens import RANKS, rank_fragments

GROUP = 50_000
#: Cost of a sequence of each permitted length: its tokens, a fixed share per sequence, and attention that grows with the square.
COSTS = {n: n + 64 + n * n // 65536 for n in (512, 1024, 2048, 4096, 8192)}


def token_counts(docs: DataFrame, path: str = RANKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_fragments(path)
        for batch in chunks(batches):
            yield pa.record_batch([batch["doc_id"], pa.array(encode(text_values(batch["text"]))[1])], ["doc_id", "n_tokens"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def pack(sizes: list[int], costs: Mapping[int, int], opens: Mapping[int, int] | None = None) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size (falling, positive, at most the largest length), and the length of each bin.

    `opens` names the length to open for sizes whose least fitting length is the key; without it, the length of least cost per
    token it can hold of what is left.
    """
    lengths = sorted(costs)
    open_bins: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # by remaining room
    room = 0  # bit r: some bin has r tokens left
    left, bins, offsets, used = sum(sizes), [], [], []
    for size in sizes:
        fitting = room >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                room &= ~(1 << r)
        else:
            if opens is None:
                r = min((n for n in lengths if n >= size), key=lambda n: (costs[n] / min(n, left), n))
            else:
                r = opens[lengths[bisect_left(lengths, size)]]
            b = len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        left -= size
        if rest := r - size:
            open_bins[rest].append(b)
            room |= 1 << rest
    return bins, offsets, [lengths[bisect_left(lengths, u)] for u in used]


def pack_jointly(sizes: list[int], costs: Mapping[int, int]) -> tuple[list[int], list[int], list[int]]:
    """The same, under the opening rule of least total cost that the search finds."""
    lengths = sorted(costs)
    classes = sorted({lengths[bisect_left(lengths, s)] for s in set(sizes)})

    def tried(opens: Mapping[int, int] | None) -> tuple:
        packed = pack(sizes, costs, opens)
        return sum(map(costs.__getitem__, packed[2])), packed, opens

    if not classes:
        return [], [], []
    best = min((tried({c: max(c, n) for c in classes}) for n in lengths), key=itemgetter(0))
    while True:
        changed = [tried({**best[2], c: n}) for c in classes for n in lengths if n >= c and n != best[2][c]]
        found = min(changed, key=itemgetter(0), default=best)
        if found[0] >= best[0]:
            return min(best, tried(None), key=itemgetter(0))[1]
        best = found


def pack_documents(counts: DataFrame, costs: Mapping[int, int] = COSTS, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin, bin_length, bin_offset) from (doc_id, n_tokens); a bin is `group * 2**32 + number`."""
    costs, top = dict(costs), max(costs)
    stored = materialize(counts.select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("row")), "token-counts")
    pieces = stored.select("doc_id", "n_tokens", "row", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_tokens") - 1, F.lit(0)), F.lit(top).cast("long"))).alias("piece", "start"))
    total = stored.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / top)))).first()[0] or 0
    groups = max(1, -(-int(total) // group))
    dealt = pieces.select(F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("int").alias("dealt"), "doc_id", "piece", "start",
                          F.least(F.lit(top), F.col("n_tokens") - F.col("start")).alias("n_tokens"))
    schema = "doc_id long, piece int, start long, n_tokens long, bin long, bin_length int, bin_offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            dealt_to = batch["dealt"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dealt_to)) + 1).tolist(), len(dealt_to)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now is not None and dealt_to[a] != now:
                    yield packed(held, now)
                    held = []
                now = int(dealt_to[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield packed(held, now)

    def packed(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        sizes = table["n_tokens"].to_pylist()
        bins, offsets, lengths = pack_jointly([s for s in sizes if s > 0], costs)
        none = [None] * (len(sizes) - len(bins))  # sizes fall, so empty pieces come last
        columns = [pa.array([number << 32 | b for b in bins] + none, pa.int64()), pa.array([lengths[b] for b in bins] + none, pa.int32()),
                   pa.array(offsets + none, pa.int64())]
        own = [table[c].combine_chunks() for c in ("doc_id", "piece", "start", "n_tokens")]
        return pa.record_batch([*own, *columns], ["doc_id", "piece", "start", "n_tokens", "bin", "bin_length", "bin_offset"])

    return (dealt.repartition(groups, "dealt").sortWithinPartitions("dealt", F.desc("n_tokens"), "doc_id", "start").mapInArrow(run, schema))

"""Token files of directly addressable codes: any token of a corpus can be read without decoding its neighbours.

Format of one shard (little-endian): magic, document count and id count, then per document its id and its end offset, then
the levels. Level k holds the k-th 8-bit chunk (lowest first) of every id that has one. Below the last level each entry has
a continuation bit, and every 512 bits a rank directory says how many bits were set before; the place of an id's next chunk
is the rank of its bit. A range of ids is contiguous on every level, so ranges are decoded at once.

Rows are range-partitioned by doc_id and encoded where they are written, so that reading the shards in order gives the corpus in
ascending doc_id order (nulls first, equal ids in the order of the input). A task closes a shard whenever it holds `SHARD_IDS`
ids, whatever the size of its range; it writes under a name of its own and renames: a repeated attempt gives the same bytes.

Defined cases: null and empty texts hold the end id only. Repeated rows are all stored. Other columns are ignored. An empty
table gives no shard.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from skirmish.llm.byte_pairs import binaries
from skirmish.llm.common import CHUNK_CHARS, chunks, materialize, text_values
from skirmish.llm.tokens import TOKENIZER, library_fragments

MAGIC = b"DAC1"
HEADER = struct.Struct("<4sIQQI")  # magic, levels, documents, ids, 0
SAMPLE = 512  # bits between two entries of a rank directory
#: Ids per shard: a shard is closed with the batch of documents that reaches this.
SHARD_IDS = 8 << 20
#: Ids decoded at once while reading a whole shard.
READ_IDS = 1 << 20


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(chunks, continuation bits) per level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        out.append(((rest & 255).astype(np.uint8), more))
        if not more.any():
            return out
        rest = rest[more] >> 8


def shard_bytes(keys: list[int | None], counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a shard file."""
    levels = levels_of(ids)
    valid = np.array([k is not None for k in keys], bool)
    parts = [HEADER.pack(MAGIC, len(levels), len(keys), len(ids), 0), np.packbits(valid, bitorder="little").tobytes(),
             np.array([k or 0 for k in keys], "<i8").tobytes(), np.cumsum(counts).astype("<u8").tobytes()]
    for k, (codes, more) in enumerate(levels):
        parts += [struct.pack("<Q", len(codes)), codes.tobytes()]
        if k + 1 < len(levels):
            before = np.concatenate([[0], np.cumsum(np.add.reduceat(more.astype(np.int64), np.arange(0, len(more), SAMPLE)))]) if len(more) else np.zeros(1)
            parts += [np.packbits(more, bitorder="little").tobytes(), before.astype("<u8").tobytes()]
    return parts


class TokenShard:
    """Reader of one shard; only the asked ranges are read from the file."""

    def __init__(self, filesystem: fs.FileSystem, path: str):
        self.file = filesystem.open_input_file(path)
        magic, levels, self.documents, self.ids, _ = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        at = HEADER.size
        self.valid_at, at = at, at + (self.documents + 7) // 8
        self.keys_at, at = at, at + 8 * self.documents
        self.ends_at, at = at, at + 8 * self.documents
        self.levels = []
        for k in range(levels):
            n, = struct.unpack("<Q", self.file.read_at(8, at))
            codes = at + 8
            bits = codes + n
            directory = bits + (n + 7) // 8
            self.levels.append((n, codes, bits, directory))
            at = directory + 8 * (-(-n // SAMPLE) + 1) if k + 1 < levels else bits

    def __enter__(self) -> TokenShard:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _array(self, at: int, kind: str, first: int, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at(n * size, at + first * size), kind)

    def _bits(self, at: int, first: int, end: int) -> np.ndarray:
        low = first // 8
        return np.unpackbits(self._array(at, "u1", low, -(-end // 8) - low), bitorder="little")[first - 8 * low:end - 8 * low].astype(bool)

    def _rank(self, level: int, i: int) -> int:
        _, _, bits, directory = self.levels[level]
        start = i // SAMPLE
        return int(self._array(directory, "<u8", start, 1)[0]) + int(self._bits(bits, start * SAMPLE, i).sum())

    def slice(self, first: int, end: int, level: int = 0) -> np.ndarray:
        """Ids first..end-1."""
        _, codes, bits, _ = self.levels[level]
        out = self._array(codes, "u1", first, end - first).astype(np.uint32)
        if end > first and level + 1 < len(self.levels):
            more = self._bits(bits, first, end)
            if n := int(more.sum()):
                start = self._rank(level, first)
                out[more] |= self.slice(start, start + n, level + 1) << np.uint32(8)
        return out

    def token(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def keys(self, first: int, end: int) -> list[int | None]:
        valid = self._bits(self.valid_at, first, end)
        return [int(k) if v else None for k, v in zip(self._array(self.keys_at, "<i8", first, end - first), valid)]

    def ends(self, first: int, end: int) -> np.ndarray:
        return self._array(self.ends_at, "<u8", first, end - first).astype(np.int64)

    def document(self, k: int) -> np.ndarray:
        ends = self.ends(max(0, k - 1), k + 1)
        return self.slice(int(ends[0]) if k else 0, int(ends[-1]))


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = 2, shard_ids: int = SHARD_IDS,
                      key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards; returns the stored manifest (part, shard, path, documents, ids), one row per shard, in corpus order by
    (part, shard)."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("turn"))
    # equal and null ids are told apart by their place, so that no id makes a large range; finding the bounds reads ids only
    ordered = rows.repartitionByRange(F.asc_nulls_first("doc_id"), "turn").sortWithinPartitions(F.asc_nulls_first("doc_id"), "turn")

    def store(target: fs.FileSystem, base: str, part: int, shard: int, keys: list, counts: list[np.ndarray], ids: list[np.ndarray]) -> tuple:
        name, own = f"part-{part:06d}-shard-{shard:06d}.dac", f"{base}/.{uuid.uuid4().hex}"
        flat = np.concatenate(ids)
        with target.open_output_stream(own) as out:
            for piece in shard_bytes(keys, np.concatenate(counts), flat):
                out.write(piece)
        target.move(own, f"{base}/{name}")
        return part, shard, name, len(keys), len(flat)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = filesystem(folder)
        target.create_dir(base, recursive=True)
        part, run = TaskContext.get().partitionId(), library_fragments(tokenizer)
        keys, counts, ids, held, done = [], [], [], 0, []
        for batch in chunks(batches, limit=min(CHUNK_CHARS, 4 * shard_ids)):
            flat, n = run(text_values(batch["text"]))
            keys += batch["doc_id"].to_pylist()
            ids.append(np.insert(flat, np.cumsum(n), end_id))
            counts.append(n + 1)
            held += len(ids[-1])
            if held >= shard_ids:
                done.append(store(target, base, part, len(done), keys, counts, ids))
                keys, counts, ids, held = [], [], [], 0
        if keys:
            done.append(store(target, base, part, len(done), keys, counts, ids))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                                         ["part", "shard", "path", "documents", "ids"])

    return materialize(ordered.select("doc_id", "text").mapInArrow(write, "part int, shard int, path string, documents long, ids long"), "token-shards")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids): every stored document, its first id's place in the corpus, its ids as unsigned 32-bit."""
    before = F.coalesce(F.sum("ids").over(W.orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per shard
    shards = manifest.select("path", before.alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, root = filesystem(folder)
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist()):
                with TokenShard(source, f"{root}/{path}") as shard:
                    ends = shard.ends(0, shard.documents)
                    starts = np.concatenate([[0], ends[:-1]])
                    first = 0
                    while first < shard.documents:
                        last = max(first + 1, int(np.searchsorted(ends, starts[first] + READ_IDS, side="right")))
                        ids = shard.slice(int(starts[first]), int(ends[last - 1])).astype("<u4")
                        yield pa.record_batch([pa.array(shard.keys(first, last), pa.int64()), pa.array(base + starts[first:last]),
                                               binaries(ids, ends[first:last] - starts[first:last])], ["doc_id", "start", "ids"])
                        first = last

    n = max(1, manifest.count())
    return shards.repartition(n).mapInArrow(run, "doc_id long, start long, ids binary")

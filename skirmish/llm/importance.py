"""Importance resampling towards a target distribution of hashed n-grams, over prefix checksums.

Method: words of a text are lowered and joined by one separator, and that line of bytes is scanned once. The scan stores the
running CRC at the end of every word. The CRC of any run of words follows from two of these values: the earlier one is
advanced over the run's length (a linear map over GF(2), from tables) and cancels everything before the run, so no n-gram is
ever built. A feature is its CRC modulo the number of buckets. Bucket counts of the whole corpus and of all target texts give
a gain per bucket, a document's weight is the sum of gains over its features, and a seeded Gumbel key turns weights into a
draw without replacement: the documents with the highest scores.

Counts leave a task as one row per bucket, so at most `buckets` rows reach the driver; documents are ranked by range
partitions.

Defined cases: null and empty texts have no words, no features and weight 0; so have texts of separators only. A null doc_id
hashes as an empty text and comes last among equal scores. Repeated rows are counted, scored and drawn each on their own; rows
equal in score and doc_id are drawn by falling weight, then number of features, then place. Other columns are ignored, whatever
their names. Without documents the result is empty; without target texts every bucket counts as seen once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skirmish.llm.common import chunks, materialize
from skirmish.operators.ordered import global_rank

POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)
SPACE = 0x20
#: Bytes per lane of the scan; lanes run side by side.
LANE = 64
#: Bytes scanned at once.
BLOCK = 1 << 20

#: Words are runs of a-z, 0-9 and everything beyond ASCII; A-Z is lowered, all else separates.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else SPACE for b in range(256))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step over a byte; advances over 0..LANE-1 zero bytes; advances over LANE * 2^k zero bytes. An advance is four
    tables of 256, one per byte of the register."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(POLYNOMIAL) ^ (step >> 1), step >> 1).astype(np.uint32)
    units = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    short = [units]
    for _ in range(LANE):
        short.append(step[short[-1] & 255] ^ (short[-1] >> 8))
    powers = [short.pop()]
    for _ in range(40):
        powers.append(_advance(powers[-1], 0, powers[-1]))
    return step, np.concatenate(short), np.concatenate(powers)


def _advance(tables: np.ndarray, number: int | np.ndarray, crc: np.ndarray) -> np.ndarray:
    """`crc` through the advance of that number in `tables`."""
    base = number * 1024
    return (tables[base + (crc & 255)] ^ tables[base + 256 + (crc >> 8 & 255)]
            ^ tables[base + 512 + (crc >> 16 & 255)] ^ tables[base + 768 + (crc >> 24)])


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each register after `length` more zero bytes."""
    _, short, powers = _tables()
    out = _advance(short, length % LANE, crc)
    lanes, k = length // LANE, 0
    while (rows := np.flatnonzero(lanes >> k)).size:
        odd = rows[(lanes[rows] >> k & 1).astype(bool)]
        out[odd] = _advance(powers, k, out[odd])
        k += 1
    return out


def running(line: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Plain CRC registers (zero at the start) of line[:end], for each rising end > 0."""
    step, _, powers = _tables()
    out, before = np.empty(len(ends), np.uint32), np.uint32(0)
    for start in range(0, len(line), BLOCK):
        part = line[start:start + BLOCK]
        lanes = -(-len(part) // LANE)
        padded = np.zeros(lanes * LANE, np.uint8)
        padded[:len(part)] = part
        columns = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
        local, register = np.empty((LANE, lanes), np.uint32), np.zeros(lanes, np.uint32)
        for j in range(LANE):
            register = step[(register ^ columns[j]) & 255] ^ (register >> 8)
            local[j] = register
        total = local[-1].copy()
        total[0] ^= _advance(powers, 0, np.array([before]))[0]
        k = 0
        while 1 << k < lanes:  # running values over the lanes, by doubling
            total[1 << k:] ^= _advance(powers, k, total[:-(1 << k)])
            k += 1
        first, last = np.searchsorted(ends, [start, start + len(part)], side="right")
        lane, column = np.divmod(ends[first:last] - start - 1, LANE)
        out[first:last] = shift(np.concatenate([[before], total[:-1]]).astype(np.uint32)[lane], column + 1) ^ local[column, lane]
        before = total[-1]  # only read again where this block was a full one
    return out


class Words:
    """Normalised texts: where words end, whose they are, and the checksums between them."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join(texts).translate(NORMAL), np.uint8)
        word = raw != SPACE
        keep = word.copy()
        keep[1:] |= word[:-1]  # one separator after each word
        line = raw[keep]
        closing = np.flatnonzero((line == SPACE))
        self.ends = closing if not len(line) or line[-1] == SPACE else np.append(closing, len(line))
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.cumsum(sizes + 1)[:-1]  # first byte of each text but the first
        opening = word.copy()
        opening[1:] &= ~word[:-1]
        self.first = np.searchsorted(np.flatnonzero(opening), np.concatenate([[0], at, [len(raw) + 1]]) if len(texts) else np.zeros(1, np.int64))
        self.counts = np.diff(self.first)
        after = running(line, self.ends)
        step = _tables()[0]
        self.after = after
        self.before = np.concatenate([[np.uint32(0)], step[(after[:-1] ^ SPACE) & 255] ^ (after[:-1] >> 8)]) if len(after) else after

    def crc(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned crc32 of every run of n words, and the number of runs per text."""
        runs = np.maximum(self.counts - (n - 1), 0)
        first = np.repeat(self.first[:-1] - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
        last = first + (n - 1)
        return shift(self.before[first] ^ ONES, self.ends[last] - self.starts[first]) ^ self.after[last] ^ ONES, runs


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()]


def bucket_counts(df: DataFrame, text: str, low: int, high: int, buckets: int) -> np.ndarray:
    """Features of all rows per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in chunks(batches):
            words = Words(_texts(batch))
            for n in range(low, high + 1):
                counts += np.bincount(words.crc(n)[0] % np.uint32(buckets), minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["bucket", "n"])

    partial = df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) per bucket, both sides with one more feature in each bucket, in doubles."""
    import math

    buckets, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets))))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, low: int = 1, high: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in chunks(batches):
            words = Words(_texts(batch))
            features, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for n in range(low, high + 1):
                crc, runs = words.crc(n)
                total = np.concatenate([[0], np.cumsum(gain[crc % np.uint32(len(gain))])])
                ends = np.cumsum(runs)
                features += runs
                weight += total[ends] - total[ends - runs]
            yield pa.record_batch([batch["doc_id"], pa.array(words.counts), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, percent: int = 10,
             least_words: int = 20, seed: int = 2024, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): every row of `docs`; rank is null where it was not drawn."""
    gains = bucket_gains(bucket_counts(docs, text, low, high, buckets), bucket_counts(target, target_text, low, high, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296)))
    weighed = weigh(docs, gains, low, high, key, text).withColumn("score", F.col("weight") + gumbel)
    stored = materialize(weighed.withColumn("row", F.monotonically_increasing_id()), "weights")
    may = F.col("n_words") >= least_words
    drawn = percent * stored.where(may).count() // 100
    ranked = global_rank(stored, [(~may).cast("int"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features"), "row"])
    place = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", place.cast("long").alias("rank"))

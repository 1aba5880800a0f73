"""Byte-level BPE in numpy: encode and decode documents with the ranks of a public vocabulary.

Method: the distinct pre-tokens of a batch are laid out as padded matrices, one per length bucket. In each round every row
merges its leftmost pair of minimum rank; pair ranks come from one hash table of (left id, right id), only the two pairs
beside a merge are looked up again, and finished rows leave the matrix. Rows longer than the widest bucket merge every
occurrence of their minimum pair per round, which gives the same ids as long as no new pair ranks lower (checked; else one).

Defined cases: null and empty texts have no ids and decode to no bytes. Repeated rows and repeated or null doc_id are each
encoded as they stand. Other columns are ignored, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skirmish.llm.common import chunks, spans_of, text_values
from skirmish.llm.fragments import FragmentEncoder
from skirmish.llm.tokens import RANKS, ranks_of

NONE = np.int32(2**31 - 1)
#: Widths of the matrices; a wider row is merged on its own.
WIDTHS = (4, 8, 16, 32, 64, 128, 256, 512)
#: Cells of a matrix at most.
CELLS = 1 << 20


class PairTable:
    """Open-addressing hash table from (left id, right id) to the rank of the joined token."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] == -1]
            self.keys[slots[free]] = keys[free]
            won = self.keys[slots[left]] == keys[left]
            self.values[slots[left[won]]] = values[left[won]]
            left = left[~won]
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is no token or an id is negative."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(len(keys), NONE, np.int32)
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self._slots(keys[open_])
        while len(open_):
            found = self.keys[slots]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[hit]]
            more = ~hit & (found != -1)
            open_, slots = open_[more], (slots[more] + 1) & (len(self.keys) - 1)
        return out.reshape(left.shape)


class BytePairs:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        import regex

        self.ranks, self.pairs, self.split = ranks, PairTable(ranks), regex.compile(pattern).findall
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths

    def merge_rows(self, m: np.ndarray) -> np.ndarray:
        """Merge the rows of a matrix of ids, padded with -1 on the right, until no pair is left."""
        width, done = m.shape[1], m.copy()
        at, columns = np.arange(len(m)), np.arange(width)
        r = self.pairs(m[:, :-1], m[:, 1:])
        while len(at):
            p = r.argmin(1)
            best = r[np.arange(len(at)), p]
            live = best < NONE
            if not live.all():
                done[at[~live]] = m[~live]
                at, m, r, p, best = at[live], m[live], r[live], p[live], best[live]
                if not len(at):
                    break
            rows = np.arange(len(at))
            take = np.minimum(columns + (columns > p[:, None]), width - 1)
            m = np.take_along_axis(m, take, 1)
            m[:, -1] = np.where(p == width - 1, m[:, -1], -1)
            m[rows, p] = best
            r = np.take_along_axis(r, np.minimum(take[:, :-1], width - 2), 1)
            r[:, -1] = NONE
            right, left = np.minimum(p + 1, width - 1), np.maximum(p - 1, 0)
            inside = p < width - 1
            r[rows[inside], p[inside]] = self.pairs(m[rows, p], np.where(inside, m[rows, right], -1))[inside]
            again = self.pairs(m[rows, left], m[rows, p])
            r[rows[p > 0], left[p > 0]] = again[p > 0]
        return done

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Merge one long row; per round every occurrence of the minimum pair, from left to right."""
        r = self.pairs(ids[:-1], ids[1:])
        while len(ids) > 1 and (best := r.min()) < NONE:
            hits = np.flatnonzero(r == best)
            run = np.concatenate([[0], np.cumsum(np.diff(hits) != 1)])  # overlapping ones: every second of a run
            hits = hits[(np.arange(len(hits)) - np.searchsorted(run, run)) % 2 == 0]
            for use in (hits, hits[:1]):
                keep = np.ones(len(ids), bool)
                keep[use + 1] = False
                new = ids.copy()
                new[use] = best
                new = new[keep]
                ranks = self.pairs(new[:-1], new[1:])
                if len(use) == 1 or ranks.min() > best:
                    break
            ids, r = new, ranks
        return ids

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if (whole := self.ranks.get(word)) is not None:
                out[i] = np.array([whole], np.int32)
            elif len(word) > WIDTHS[-1]:
                out[i] = self.merge_long(self.of_byte[np.frombuffer(word, np.uint8)])
            else:
                buckets.setdefault(next((w for w in WIDTHS if len(word) <= w)), []).append(i)
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for k in range(0, len(members), step):
                part = members[k:k + step]
                lengths = np.fromiter((len(words[i]) for i in part), np.int64, len(part))
                m = np.full((len(part), width), -1, np.int32)
                m[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(words[i] for i in part), np.uint8)]
                for i, row, n in zip(part, m := self.merge_rows(m), (m >= 0).sum(1)):
                    out[i] = row[:n]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, encoded through the distinct pre-tokens of all."""
        pieces = [self.split(t) for t in texts]
        number = {w: k for k, w in enumerate(dict.fromkeys(w for p in pieces for w in p))}
        ids = self.encode_words([w.encode() for w in number])
        empty = np.zeros(0, np.int32)
        return [np.concatenate([ids[number[w]] for w in p]) if len(p) > 1 else ids[number[p[0]]] if p else empty for p in pieces]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids, one token after the other."""
        return self.token_bytes[spans_of(self.token_starts[ids], self.token_lengths[ids])]


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(ranks_of(path))


@lru_cache(maxsize=2)
def _fragments(path: str) -> FragmentEncoder:
    return FragmentEncoder(byte_pairs(path).encode)


def encode_documents(docs: DataFrame, path: str = RANKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _fragments(path)
        for batch in chunks(batches):
            ids, counts = encode(text_values(batch["text"]))
            yield pa.record_batch([batch["doc_id"], binaries(ids.astype("<u4"), counts)], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, ids, decoded): the bytes behind the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(path)
        for batch in chunks(batches, "ids", 1 << 22):
            raw = batch["ids"].to_pylist()
            decoded = pa.array([pairs.decode(np.frombuffer(x, "<u4")).tobytes() for x in raw], pa.binary())
            yield pa.record_batch([batch["doc_id"], batch["ids"], decoded], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow binary column of consecutive slices of an array."""
    data = values.tobytes()
    ends = (np.cumsum(counts) * values.itemsize).tolist()
    return pa.array([data[a:b] for a, b in zip([0, *ends[:-1]], ends)], pa.binary())

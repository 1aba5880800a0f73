"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

Method: every text becomes a bag of hashed features (its words, their shapes, and how repetitive it is). A bounded sample of
labelled rows gives the weights and, by a truncated singular value decomposition, the latent space. The sample's vectors are
broadcast; each document is compared with all of them by exact cosine products, block by block, and its score is the mean
label of the `NEIGHBOURS` nearest, weighted by similarity.

The fit sees at most `SAMPLE` rows of `DIM` features, whatever the corpus holds: that is the bound of what reaches the driver
and of the broadcast. Every document is scored from its whole text.

Defined cases: a null or empty text has no features; its score is the mean label of the sample. Without labelled rows every
score is 0.5. Repeated rows and null doc_id are scored as they stand; several labels of one document all vote. `filter_documents`
keeps every column. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skirmish.llm.common import chunks, text_values
from skirmish.llm.fragments import FragmentEncoder

#: Labelled rows that the model is fitted to at most.
SAMPLE = 4000
DIM, RANK, NEIGHBOURS = 4096, 64, 15
#: Features of repetition and length, counted this often so that they weigh beside thousands of words.
EMPHASIS = 64
BLOCK = 400


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % DIM


#: The kind of each ASCII sign, and runs of one kind.
_KINDS = {c: "A" if chr(c).isupper() else "a" if chr(c).isalpha() else "0" if chr(c).isdigit() else chr(c) for c in range(128)}
_REPEATS = re.compile(r"(.)\1+", re.S)


def _shape(word: str) -> str:
    """The whole word with each run of capitals as A, of other letters as a, of digits as 0, and of any other sign as that sign."""
    kinds = word.translate(_KINDS) if word.isascii() else "".join(["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word])
    return _REPEATS.sub(r"\1", kinds)


def _features(fragments: list[str]) -> list[list[int]]:
    return [[_bucket(w), _bucket("shape " + _shape(w))] if (w := f.strip()) else [] for f in fragments]


@lru_cache(maxsize=1)
def _encoder() -> FragmentEncoder:
    return FragmentEncoder(_features, 120_000)


def _repetition(text: str) -> list[int]:
    words = text.split()
    if not words:
        return []
    n = len(words)
    distinct, again = len(set(words)) / n, sum(map(eq, words, words[1:])) / n
    lines = [x for x in text.split("\n") if x.strip()]
    return [_bucket(f"{name} {value}") for name, value in (
        ("distinct", int(distinct * 10)), ("again", int(again * 20)), ("length", n.bit_length()), ("lines", int(10 * len(set(lines)) / len(lines))))]


def counted(texts: list[str]) -> np.ndarray:
    """Feature counts, one row per text."""
    ids, counts = _encoder()(texts)
    rows = np.repeat(np.arange(len(texts)), counts)
    out = np.bincount(rows * DIM + ids, minlength=len(texts) * DIM).reshape(len(texts), DIM).astype(np.float32)
    for i, text in enumerate(texts):
        out[i, _repetition(text)] += EMPHASIS
    return out


class Model:
    """Weights, latent space and labelled vectors."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.mean = float(labels.mean()) if len(labels) else 0.5
        if not len(labels):
            return
        seen = (counts > 0).sum(0)
        self.weights = (np.log((1 + len(counts)) / (1 + seen)) + 0.1).astype(np.float32)
        x = self._weighted(counts)
        start = np.random.default_rng(7).standard_normal((x.shape[1], RANK + 16), dtype=np.float32)
        basis = x @ start
        for _ in range(4):
            basis = np.linalg.qr(x @ (x.T @ basis))[0]
        _, _, v = np.linalg.svd(basis.T @ x, full_matrices=False)
        self.space = np.ascontiguousarray(v[:RANK].T)
        self.vectors = self._unit(x @ self.space)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(np.log1p(counts) * self.weights)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, length, out=np.zeros_like(x), where=length > 0)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = self._unit(self._weighted(counts) @ self.space) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** 4
        total = weight.sum(1)
        vote = np.divide((weight * self.labels[top]).sum(1), total, out=np.full(len(counts), self.mean), where=total > 0)
        return np.where(counts.any(1), vote, self.mean).clip(0, 1)


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit to at most `sample` labelled rows outside the held-out fold, chosen by a hash of their id."""
    chosen = (labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
              .filter((fold(F.col("doc_id")) != 1) & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
              .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")  # at most `sample` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                x = counted(text_values(part["text"]))
                used = [np.flatnonzero(r) for r in x]
                yield pa.record_batch([part["doc_id"], part["label"], pa.array([u.astype("<u2").tobytes() for u in used], pa.binary()),
                                       pa.array([r[u].astype("<f4").tobytes() for r, u in zip(x, used)], pa.binary())], ["doc_id", "label", "ids", "counts"])

    # repeated documents could exceed the sample: again at most `sample` rows reach the driver
    got = (rows.mapInArrow(run, "doc_id long, label int, ids binary, counts binary")
           .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample).collect())
    counts = np.zeros((len(got), DIM), np.float32)
    for row, r in zip(counts, got):
        row[np.frombuffer(r["ids"], "<u2")] = np.frombuffer(r["counts"], "<f4")
    return Model(counts, np.array([r["label"] for r in got], np.float32))


def score_texts(docs: DataFrame, model: Model, carried: str = "doc_id", text: str = "text") -> DataFrame:
    """(carried, score): every row, by its whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[carried].dataType
    from pyspark.sql.types import DoubleType, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text"):
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                yield pa.record_batch([part[carried], pa.array(held.value.score(counted(text_values(part["__text"]))))], [carried, "score"])

    return docs.select(carried, F.col(text).cast("string").alias("__text")).mapInArrow(run, StructType().add(carried, kind).add("score", DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = score_texts(rows, fit(rows, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with their own columns."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    scored = score_texts(docs.select(whole, F.col(text).alias("text")), fit(docs, labels, key=key, text=text), "doc")
    return scored.filter(F.col("score") >= threshold).select("doc.*")

"""Word shingles and MinHash signatures of many texts at once, in numpy.

Words are runs of anything but ASCII white space, in lower case. A shingle is five words in a row; a text of one to four
words has one shingle of all of them. Shingles are 64-bit hashes; equal sets of hashes count as equal sets of shingles.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 5
HASHES, BAND = 128, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_PLACE = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)
_random = np.random.default_rng(11)
_MULTIPLY = _random.integers(0, 2**63, HASHES, dtype=np.uint64) << _U(1) | _U(1)
_ADD = _random.integers(0, 2**63, HASHES, dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    p = int(_ODD)
    inverse = pow(p, -1, 1 << 64)
    make = lambda b: np.cumprod(np.concatenate([[_U(1)], np.full((1 << bits) - 1, b, np.uint64)]), dtype=np.uint64)
    return make(_U(p)), make(_U(inverse))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words per text. The hash of bytes s..e-1 comes from running sums."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    up, down = _powers(max(21, len(data).bit_length()))
    sums = np.concatenate([[_U(0)], np.cumsum(_BYTE[data] * up[:len(data)], dtype=np.uint64)])
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    words = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)
    text_end = np.cumsum([len(r) + 1 for r in raw])
    last = np.searchsorted(start, text_end)
    return words, np.diff(np.concatenate([[0], last]))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    words, counts = word_hashes(texts)
    n = len(words)
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    whole = np.zeros(n, np.uint64)
    for k in range(WORDS):
        whole += padded[k:k + n] * _PLACE[k]
    whole = mix(whole)
    out, at = [], 0
    for c in counts:
        if c >= WORDS:
            out.append(np.unique(whole[at:at + c - WORDS + 1]))
        else:
            out.append(mix((words[at:at + c] * _PLACE[:c]).sum(keepdims=True, dtype=np.uint64) + _U(c)) if c else np.zeros(0, np.uint64))
        at += c
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) of 16-bit MinHash values; every set must have a shingle."""
    out = np.empty((len(sets), HASHES), np.uint16)
    if not sets:
        return out
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    for j in range(HASHES):
        least = np.minimum.reduceat((flat * _MULTIPLY[j] + _ADD[j]) >> _U(24), starts)
        out[:, j] = (mix(least) & _U(0xFFFF)).astype(np.uint16)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """(sets, HASHES / BAND) of 64-bit keys, each the values of one band exactly."""
    return np.ascontiguousarray(signature).view(np.uint64)

"""Encode texts through their distinct fragments.

The byte-level pattern never joins what stands before a space to that space, unless the space lies inside a longer run of
white space. A text may therefore be cut before each such space and the fragments be encoded on their own: the ids are
those of the whole text. Words repeat, so a task encodes each distinct fragment once and gathers the rest.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

from skirmish.llm.common import spans_of

_SPACE_THEN_SPACE = re.compile(r" \s")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def cut(text: str) -> list[str]:
    """Fragments of a text; all but the first had a space before them, which is left out."""
    return _SAFE_CUT.split(text) if _SPACE_THEN_SPACE.search(text) else text.split(" ")


class FragmentEncoder:
    """Ids of texts, through `encode` for lists of fragments, which gives a list of ids each or all ids and their numbers. Holds at most `limit` fragments between two calls: beyond that it
    forgets those used once, and if need be the rarer ones, since most distinct fragments never return."""

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]] | tuple[np.ndarray, np.ndarray]], limit: int = 250_000):
        self.encode, self.limit = encode, limit
        self.inner: defaultdict[str, int] = defaultdict()  # with a space before
        self.first: defaultdict[str, int] = defaultdict()
        self.known = 0
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        half = self.limit // 2
        keep = self.uses >= 2
        if keep.sum() > half:
            keep = self.uses > np.partition(self.uses, -half)[-half]
        number = np.cumsum(keep) - 1
        flags = keep.tolist()
        for name in ("inner", "first"):  # the order of numbers stays the order of insertion
            setattr(self, name, defaultdict(None, {f: int(number[k]) for f, k in getattr(self, name).items() if flags[k]}))
        self.ids = self.ids[spans_of(self.starts[keep], self.lengths[keep])]
        self.lengths, self.uses = self.lengths[keep], self.uses[keep] // 2
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.known = len(self.lengths)

    def _codes(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each fragment of each text, and the fragments per text."""
        self.new: list[str] = []

        def number(prefix: str, of: defaultdict):
            def make() -> int:
                self.known += 1
                return self.known - 1
            of.default_factory = make

        number(" ", self.inner)
        number("", self.first)
        codes, counts = [], np.empty(len(texts), np.int64)
        inner, first = self.inner.__getitem__, self.first.__getitem__
        for i, text in enumerate(texts):
            parts = cut(text)
            counts[i] = len(parts)
            codes.append(first(parts[0]))
            codes.extend(map(inner, parts[1:]))
        return np.array(codes, np.int64), counts

    def _learn(self, before: int) -> None:
        """Encode the fragments numbered from `before` on; a dictionary keeps the order of insertion."""
        new: list[str] = [""] * (self.known - before)
        for of, prefix in ((self.first, ""), (self.inner, " ")):
            for fragment in reversed(of):
                if (k := of[fragment]) < before:
                    break
                new[k - before] = prefix + fragment
        if not new:
            return
        found = self.encode(new)
        if isinstance(found, tuple):
            flat, lengths = found
        else:
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, flat])

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        if self.known > self.limit:
            self._forget()
        before = self.known
        codes, counts = self._codes(texts)
        self._learn(before)
        uses = np.bincount(codes, minlength=self.known)
        uses[:before] += self.uses
        self.uses = uses
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        last = np.cumsum(counts)
        total = np.diff(np.concatenate([[0], ends[last - 1]])) if len(texts) else np.zeros(0, np.int64)
        return self.ids[spans_of(self.starts[codes], lengths)], total

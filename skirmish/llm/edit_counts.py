"""Token counts that follow edits: per document a tree over its pre-tokens, of which an edit touches only a few leaves.

Method: a document is cut by the byte-level pattern; every `LEAF` pre-tokens form a leaf with its characters and tokens, and
each inner node holds the sums of its two children. For an edit, the pattern runs again from the first pre-token that may
have read into the edited place (it looks at most one character beyond its own end) and goes on until a boundary meets an
old one behind the edit; from there on nothing can change. Only pre-tokens of that stretch are encoded again, the leaves
they lie in are rebuilt, and the sums above them updated. The result equals a fresh count (tested).

All edits of a document are made in one walk: the new text is put together once, stretches that an edit reaches are read again in
it, everything between them is skipped by the tree, and every touched leaf is summed up once. A leaf may grow or run empty; only
when one has outgrown `LEAF` by far are the leaves dealt anew.

Defined cases: null and empty texts have no tokens. Edits are (start, end, text) in code points of the original text and count
in any order. A null edit, or one with a null start or end, is skipped; null text inserts nothing; places out of range are cut to
the text, and an end before its start to the start. Of edits that overlap, the first by start, end and text is made and the others
are skipped; edits that touch do not overlap, and insertions at one place are made in that order. `n_edits` counts the edits made.
Repeated rows and null doc_id are counted as they stand. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skirmish.llm.common import chunks, text_values
from skirmish.llm.native import matches
from skirmish.llm.tokens import RANKS, rank_encoder

#: Pre-tokens per leaf.
LEAF = 64
#: Distinct pre-tokens whose counts a task remembers.
REMEMBERED = 500_000


class CountTree:
    """Leaves of (characters, tokens) per pre-token under a tree of sums."""

    def __init__(self, text: str, split: Callable[[str, int], Iterator[str]], count: Callable[[str], int]):
        self.text, self.split, self.count = text, split, count
        self.encoded = 0
        self.leaves = self._leaves([(len(w), self._count(w)) for w in split(text, 0)])
        self._build()

    def _count(self, word: str) -> int:
        self.encoded += 1
        return self.count(word)

    @staticmethod
    def _leaves(pieces: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        return [pieces[i:i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]

    def _build(self) -> None:
        level = [(sum(c for c, _ in leaf), sum(n for _, n in leaf)) for leaf in self.leaves]
        self.levels = [level]
        while len(level) > 1:
            level = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], [*level[1::2], (0, 0)][:len(level[::2])])]
            self.levels.append(level)

    def _refresh(self, leaf: int) -> None:
        """Sums on the way from one leaf to the root."""
        self.levels[0][leaf] = (sum(c for c, _ in self.leaves[leaf]), sum(n for _, n in self.leaves[leaf]))
        for below, level in zip(self.levels, self.levels[1:]):
            leaf //= 2
            pair = below[2 * leaf:2 * leaf + 2]
            level[leaf] = (sum(c for c, _ in pair), sum(n for _, n in pair))

    @property
    def tokens(self) -> int:
        return self.levels[-1][0][1]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, or the last, and where that leaf starts; from the root down."""
        leaf, start = 0, 0
        for level in reversed(self.levels[:-1]):
            leaf *= 2
            if place >= start + level[leaf][0] and leaf + 1 < len(level):
                start += level[leaf][0]
                leaf += 1
        return leaf, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start..end-1."""
        self.edit_all([(start, end, new)])

    def chosen(self, edits: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """The edits to make, within the text, in order and apart from each other."""
        size, out = len(self.text), []
        for start, end, new in sorted((min(max(s, 0), size), min(max(e, s, 0), size), t) for s, e, t in edits):
            if not out or start >= out[-1][1]:
                out.append((start, end, new))
        return out

    def edit_all(self, edits: Iterable[tuple[int, int, str]]) -> int:
        """Make the edits, given in places of the text as it is; returns how many were made."""
        edits = self.chosen(edits)
        if not edits:
            return 0
        parts, done, begins, now = [], 0, [], 0
        for start, end, new in edits:
            parts += [self.text[done:start], new]
            now += start - done
            begins.append(now)
            now += len(new)
            done = end
        old_size, self.text = len(self.text), "".join([*parts, self.text[done:]])
        ends = [b + len(new) for b, (_, _, new) in zip(begins, edits)]  # of the new texts, like `begins` in the new text
        changes, k = [], 0
        leaf = piece = at = 0  # a place among the old pre-tokens, and the character it starts at
        while k < len(edits):
            start = edits[k][0]
            if self._reach(max(0, start - 2)) > at:
                leaf, at = self.find(max(0, start - 2))
                piece = 0
            leaf, piece, at = self._forward(leaf, piece, at, lambda stop: stop >= start - 1)
            first, pieces, new_at = (leaf, piece), [], at + begins[k] - start
            for word in self.split(self.text, new_at):
                while k + 1 < len(edits) and new_at > begins[k + 1]:
                    k += 1
                if new_at >= ends[k]:
                    wanted = new_at - ends[k] + edits[k][1]
                    leaf, piece, at = self._forward(leaf, piece, at, lambda stop: stop > wanted)
                    if at == wanted:
                        break
                pieces.append((len(word), self._count(word)))
                new_at += len(word)
            else:
                leaf, piece, at, k = len(self.leaves) - 1, len(self.leaves[-1]), old_size, len(edits) - 1
            changes.append((*first, leaf, piece, pieces))
            k += 1
        touched = set()
        for leaf, piece, last, stop, pieces in reversed(changes):
            if leaf == last:
                self.leaves[leaf][piece:stop] = pieces
            else:
                self.leaves[last][:stop] = []
                self.leaves[leaf][piece:] = pieces
                for middle in range(leaf + 1, last):
                    self.leaves[middle] = []
            touched.update(range(leaf, last + 1))
        if any(len(self.leaves[i]) > 8 * LEAF for i in touched):
            self.leaves = self._leaves([p for one in self.leaves for p in one])
            self._build()
        else:
            for i in touched:
                self._refresh(i)
        return len(edits)

    def _reach(self, place: int) -> int:
        """Where the leaf that holds a character starts."""
        return self.find(place)[1]

    def _forward(self, leaf: int, piece: int, at: int, enough: Callable[[int], bool]) -> tuple[int, int, int]:
        """The first pre-token from here on whose end is enough; the end of all if there is none."""
        while True:
            pieces = self.leaves[leaf]
            while piece < len(pieces) and not enough(at + pieces[piece][0]):
                at += pieces[piece][0]
                piece += 1
            if piece < len(pieces) or leaf + 1 == len(self.leaves):
                return leaf, piece, at
            leaf, piece = leaf + 1, 0


@lru_cache(maxsize=2)
def _tools(path: str) -> tuple[Callable, Callable]:
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    encoder = rank_encoder(path)
    count = lru_cache(maxsize=REMEMBERED)(lambda word: len(encoder.encode_ordinary(word)))

    def split(text: str, start: int) -> Iterator[str]:
        return pattern.findall(text) if not start else (m.group() for m in pattern.finditer(text, start))

    return split, count


def count_with_edits(docs: DataFrame, path: str = RANKS, key: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_recounted) from rows with `edits array<struct<start, end, text>>`."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.col(edits).cast("array<struct<start:int,end:int,text:string>>").alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, count = _tools(path)
        for batch in chunks(batches):
            out = []
            for t, changes in zip(text_values(batch["text"]), batch["edits"].to_pylist()):
                tree = CountTree(t, split, count)
                before, tree.encoded = tree.tokens, 0
                made = tree.edit_all((e["start"], e["end"], e["text"] or "") for e in changes or () if e and e["start"] is not None and e["end"] is not None)
                out.append((before, made, tree.tokens, tree.encoded))
            yield pa.record_batch([batch["doc_id"], *(pa.array([o[i] for o in out], pa.int64()) for i in range(4))],
                                  ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_recounted"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_recounted long")


def masked_numbers(text: str = "text", mask: str = "<num>"):
    """Edits that replace every run of four or more digits: the kind of edit a redaction step makes."""
    return F.transform(matches(F.coalesce(F.col(text), F.lit("")), "[0-9]{4,}"),
                       lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(mask).alias("text")))

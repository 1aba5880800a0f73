"""BPE with word ends, encoded between forced boundaries, and decoded.

Method: two neighbouring bytes that stand together inside no token of the vocabulary can never be merged, whatever surrounds
them, so a word may be cut there and its parts encoded on their own; their ids are then put one after the other. White space
is the plainest case and cuts texts into fragments, which a task encodes once each (`FragmentEncoder`). New fragments are
normalised and split as the library does (by its own code where they are not plain ASCII), their distinct words become one line
of symbols (a byte, or a byte that ends a word), one table look-up per neighbouring pair marks the cuts, and all parts are
merged by rank side by side.

Added tokens are taken out of the raw fragment first, as the library does. Decoding joins the tokens' own writing by spaces:
the vocabulary file names no decoder.

Defined cases: null and empty texts, and texts of white space, have no ids and decode to an empty text. Repeated rows and
repeated or null doc_id are each encoded as they stand. Other columns are ignored. An empty table gives an empty table. Parts of
any length are merged in n log n.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skirmish.llm.common import chunks, spans_of, text_values
from skirmish.llm.fragments import FragmentEncoder
from skirmish.llm.tokens import _byte_signs

WORDS = public_tokenizers.path("word_bpe_49k.json")
#: A symbol is a byte, or END + a byte that ends its word.
END = 256
#: Parts of more symbols are merged on their own, through a heap.
LONG = 64
NONE = np.int64(2**31 - 1)
#: Between two fragments that go through the library's splitter in one text: a sign of its own that no rule joins to anything.
MARK = "\ue000"
#: Fragments per such text.
TOGETHER = 500


class ForcedCuts:
    """Encoder of one vocabulary file."""

    def __init__(self, path: str = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or not model.get("end_of_word_suffix"):
            raise ValueError(f"{path}: not a plain BPE model with word ends")
        library = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.to_byte = {chr(s): b for b, s in _byte_signs().items()}
        self.table = {s: b for s, b in ((ord(c), chr(b)) for c, b in self.to_byte.items())}
        self.names = token_names(path)
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in file["added_tokens"]):
            raise ValueError(f"{path}: added tokens are expected to match the raw text exactly and hold no white space")
        self.holds_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")" if self.added else "((?!))")

        self.together = np.zeros((END, 2 * END), bool)  # pairs inside some token
        self.single = np.zeros(2 * END, np.uint32)  # ids of single symbols
        for name, i in vocab.items():
            symbols = self._symbols(name, suffix)
            self.together[symbols[:-1], symbols[1:]] = True
            if len(symbols) == 1:
                self.single[symbols[0]] = i
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[x], vocab[y]] = rank
        self.joined = np.zeros(len(self.merges), np.int64)  # id by rank
        keys = np.empty(len(self.merges), np.int64)
        for (x, y), rank in self.merges.items():
            keys[rank], self.joined[rank] = x << 32 | y, vocab[self.names[x] + self.names[y]]
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]
        self.first = self._ranks(np.repeat(self.single[:END], 2 * END), np.tile(self.single, END)).reshape(END, 2 * END)
        # printable ASCII is lowered and split alike by plain rules; everything else goes through the library
        self.ascii = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall

    def _symbols(self, name: str, suffix: str) -> list[int]:
        ends = name.endswith(suffix) and name != suffix
        symbols = [self.to_byte[c] for c in (name[:-len(suffix)] if ends else name)]
        return [*symbols[:-1], END + symbols[-1]] if ends else symbols

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where it is never merged."""
        wanted = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.by_key[at], NONE)

    def merge_long(self, ids: list[int]) -> list[int]:
        """Ids of one part: the pair of least rank first, leftmost among equals."""
        merges, joined = self.merges, self.joined
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(rank, i) for i, pair in enumerate(zip(ids, ids[1:])) if (rank := merges.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or merges.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = int(joined[rank]), -1
            after[i] = after[j]
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(ids):
                    before[y] = x
                    if (rank := merges.get((ids[x], ids[y]))) is not None:
                        heapq.heappush(heap, (rank, x))
        return [i for i in ids if i >= 0]

    def merge(self, symbols: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, part of each id) of parts that stand one after the other: every round merges the leftmost least pair of each
        part, looks the two pairs beside it up again, and puts finished parts aside."""
        ids, done = self.single[symbols].astype(np.int64), []
        rank = np.full(len(ids), NONE)  # of each id and the next in its part
        inner = np.flatnonzero(part[:-1] == part[1:])
        rank[inner] = self.first[symbols[inner], symbols[inner + 1]]
        while len(ids):
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
            least, place = best >> 32, best & 0xFFFFFFFF
            over = least == NONE
            if over.any():
                finished = np.repeat(over, np.diff(starts, append=len(ids)))
                done.append((ids[finished], part[finished]))
                before = np.cumsum(finished)
                least, place = least[~over], place[~over]
                place -= before[place]
                ids, part, rank = ids[~finished], part[~finished], rank[~finished]
                if not len(ids):
                    break
            ids[place] = self.joined[least]
            stay = np.ones(len(ids), bool)
            stay[place + 1] = False
            ids, part, rank = ids[stay], part[stay], rank[stay]
            changed = place - np.arange(len(place))
            changed = np.concatenate([changed, changed[changed > 0] - 1])
            follows = np.minimum(changed + 1, len(ids) - 1)
            rank[changed] = np.where((changed + 1 < len(ids)) & (part[changed] == part[follows]), self._ranks(ids[changed], ids[follows]), NONE)
        ids, part = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(2))
        order = np.argsort(part, kind="stable")
        return ids[order], part[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of words given in byte signs: cut at forced boundaries, parts merged on their own."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        line = np.frombuffer("".join(words).translate(self.table).encode("latin-1"), np.uint8).astype(np.int64)
        closing = np.zeros(len(line), bool)
        closing[np.cumsum(lengths) - 1] = True
        symbols = line + END * closing
        cut = closing.copy()
        cut[:-1] |= ~self.together[line[:-1], symbols[1:]]
        part = np.cumsum(cut) - cut
        sizes = np.bincount(part)
        word_of = np.repeat(np.arange(len(words)), lengths)[np.flatnonzero(cut)]
        wide = sizes[part] > LONG
        ids, owner = self.merge(symbols[~wide], part[~wide])
        if wide.any():
            ends = np.cumsum(sizes)
            long = {int(p): self.merge_long(self.single[symbols[ends[p] - sizes[p]:ends[p]]].tolist()) for p in np.unique(part[wide])}
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(long.values()), np.int64)])
            owner = np.concatenate([owner, np.repeat(np.array(list(long), np.int64), [len(x) for x in long.values()])])
            order = np.argsort(owner, kind="stable")
            ids, owner = ids[order], owner[order]
        return ids, np.bincount(word_of[owner], minlength=len(words))

    def _library(self, fragments: list[str]) -> list[str]:
        """Words of the fragments in byte signs, a line end after each fragment."""
        mark, = [w for w, _ in self.pre_tokenize(MARK)]
        out: list[str] = []
        for k in range(0, len(fragments), TOGETHER):
            text = self.normalize(f" {MARK} ".join([*fragments[k:k + TOGETHER], ""]))
            out += ["\n" if w == mark else w for w, _ in self.pre_tokenize(text)]
        return out

    def _with_added(self, fragment: str) -> list:
        """Words and added tokens (by id) of one fragment, then a line end."""
        out: list = []
        for k, piece in enumerate(self.holds_added.split(fragment)):
            out += [self.added[piece]] if k % 2 else [w for w, _ in self.pre_tokenize(self.normalize(piece))] if piece else []
        return [*out, "\n"]

    def __call__(self, fragments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per fragment)."""
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])  # plain, for the library, on their own
        for i, f in enumerate(fragments):
            kinds[2 if "<" in f and self.holds_added.search(f) or MARK in f else 0 if f.isascii() and f.isprintable() else 1].append(i)
        plain, library, alone = ([fragments[i] for i in k] for k in kinds)
        pieces = [*self.ascii("\n".join([*plain, ""]).lower()), *self._library(library), *chain.from_iterable(map(self._with_added, alone))]
        number: defaultdict = defaultdict(lambda: len(number))
        codes = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        known = list(number)
        flat, lengths = self.encode_words(words) if (words := [w for w in known if isinstance(w, str) and w != "\n"]) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        size, start = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        is_word = np.fromiter((isinstance(w, str) and w != "\n" for w in known), bool, len(known))
        size[is_word], start[is_word] = lengths, np.cumsum(lengths) - lengths
        tokens = [k for k, w in enumerate(known) if isinstance(w, int)]
        size[tokens], start[tokens] = 1, len(flat) + np.arange(len(tokens))
        flat = np.concatenate([flat, np.array([known[k] for k in tokens], np.int64)])
        ids, taken = flat[spans_of(start[codes], size[codes])], size[codes]
        ends = codes == number["\n"]
        per = np.bincount(np.cumsum(ends) - ends, weights=taken, minlength=len(fragments)).astype(np.int64)[:len(fragments)]
        order = np.array([*chain.from_iterable(kinds)], np.int64)  # the fragment of each run
        starts, counts = np.empty(len(fragments), np.int64), np.empty(len(fragments), np.int64)
        starts[order], counts[order] = np.cumsum(per) - per, per
        return ids[spans_of(starts, counts)].astype(np.uint32), counts


@lru_cache(maxsize=1)
def token_names(path: str) -> list[str]:
    """The writing of each id, added tokens included: all that decoding needs."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    names = [""] * (1 + max([*file["model"]["vocab"].values(), *(t["id"] for t in file["added_tokens"])]))
    for name, i in [*file["model"]["vocab"].items(), *((t["content"], t["id"]) for t in file["added_tokens"])]:
        names[i] = name
    return names


@lru_cache(maxsize=1)
def _loaded(path: str) -> tuple[ForcedCuts, FragmentEncoder]:
    cuts = ForcedCuts(path)
    return cuts, FragmentEncoder(cuts)


def encode_documents(docs: DataFrame, tokenizer: str = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _loaded(tokenizer)[1]
        for batch in chunks(batches):
            ids, counts = encode(text_values(batch["text"]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.record_batch([batch["doc_id"], lists], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str = WORDS) -> DataFrame:
    """(doc_id, ids, decoded) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = token_names(tokenizer).__getitem__
        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                part = batch.slice(row, 512)
                flat = part["ids"].flatten().to_numpy().tolist()
                ends = np.cumsum(part["ids"].value_lengths().fill_null(0).to_numpy()).tolist()
                decoded = [" ".join(map(name, flat[a:b])) for a, b in zip([0, *ends], ends)]
                yield pa.record_batch([part["doc_id"], part["ids"], pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")

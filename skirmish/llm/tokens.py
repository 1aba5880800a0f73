"""Public tokenizers inside tasks: loaded once per worker process, by the path of their file."""

from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers

from skirmish.llm.fragments import FragmentEncoder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def rank_encoder(path: str):
    """The tiktoken library's encoder of a rank file."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})


@lru_cache(maxsize=2)
def rank_fragments(path: str) -> FragmentEncoder:
    encode = rank_encoder(path).encode_ordinary
    return FragmentEncoder(lambda fragments: [encode(f) for f in fragments])


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in byte-level vocabularies: itself if it prints, else the next one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in prints)
    return {b: b for b in prints} | {b: 256 + k for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def library_fragments(path: str) -> FragmentEncoder:
    """Ids of the tokenizers library for a byte-level file. Its own pipeline keeps the source of every character, which takes most of
    its time. Where the file's merges come in the order of their ids (checked here), merging by rank over the same vocabulary gives
    the same ids; tests hold both against each other for every code point and every token. Fragments that hold the content of an
    added token go to the library, which takes that out before the pattern is applied."""
    import json
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, signs = model["vocab"], {chr(s): b for b, s in _byte_signs().items()}
    merged = [vocab[a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    if odd or any(a >= b for a, b in zip(merged, merged[1:])) or len(vocab) != 256 + len(merged):
        raise ValueError(f"{path}: not a plain byte-level model with merges in the order of ids {odd}")
    tokenizer = Tokenizer.from_file(path)
    added = tokenizer.get_added_tokens_decoder().values()
    if any(t.rstrip or re.search(r"\s", t.content) for t in added):
        raise ValueError(f"{path}: an added token with white space in it or taken after it would be cut between fragments")
    holds_added = re.compile("|".join(re.escape(t.content) for t in added) or "(?!)").search
    names = {t.content for t in added}
    ranks = {bytes(map(signs.__getitem__, name)): i for name, i in vocab.items() if name not in names}
    plain, whole = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, tokenizer.encode
    return FragmentEncoder(lambda fragments: [whole(f, add_special_tokens=False).ids if holds_added(f) else plain(f) for f in fragments])

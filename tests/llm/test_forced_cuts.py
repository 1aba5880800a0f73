import hashlib
import random

import pytest
from helpers import empty, odd_rows
from tokenizers import Tokenizer

from skirmish.llm import forced_cuts, queries
from skirmish.llm.forced_cuts import WORDS, ForcedCuts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def cuts():
    return ForcedCuts(WORDS)


ODD = ["", "  ", "<|endoftext|>", "a<|endoftext|>b don't ''s %'s I'LL we'Re", "ΣΑΣ Σ σ́é ́x", "a\x1cb\x85c d e", "x" * 5000, "ab1cd22'", "<|endoftext|",
       "<|startoftext|><|endoftext|> x<|ENDOFTEXT|>", "İI ﬁ Å̊", "a'" * 3000, "日本語テキスト" * 50, "😀😁x", "ha" * 300 + "h", "'" * 100 + "s", "À ̀\nB\t\tC", "﻿x​y",
       "</w>", "a</w> b", "Ġ Ċ", "\x00\x01\x7f", "\ue000", "x\ue000y \ue000é", "é" * 200 + "-" * 90]


def lists(found):
    ids, counts = found
    ends = counts.cumsum()
    return [ids[e - n:e].tolist() for e, n in zip(ends, counts)]


def test_words_are_cut_and_merged_as_the_library_does(library, cuts):
    r = random.Random(1)
    signs = "abcABC'stremvld 129 \n\t!<|>%éÉ́Σ日😀 \x1c\x85ǅßẞ"
    texts = ODD + ["".join(r.choice(signs) for _ in range(r.randint(1, 60))) for _ in range(3000)]
    for text, ids in zip(texts, lists(cuts(texts))):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, text
        assert " ".join(map(cuts.names.__getitem__, ids)) == library.decode(want, skip_special_tokens=False)


def test_long_parts_merge_like_short_ones(cuts, library, monkeypatch):
    r = random.Random(2)
    words = ["".join(r.choice("theandngri") for _ in range(r.randrange(1, 60))) for _ in range(300)]
    short = lists(cuts.encode_words(words))
    monkeypatch.setattr(forced_cuts, "LONG", 3)
    assert short == lists(cuts.encode_words(words)) == [library.encode(w).ids for w in words]


def test_no_token_spans_a_cut(cuts, library):
    """A pair that is marked as a cut occurs in no token, and cutting there changes nothing."""
    assert not cuts.together[ord("q"), ord("7")] and cuts.together[ord("t"), ord("h")] and cuts.together[ord("t"), 256 + ord("h")]
    for word in ("zqxjkvb", "qqqqzzz", "xkcdqjx"):
        assert lists(cuts([word]))[0] == library.encode(word).ids


def test_documents_round_trip(spark, library):
    rows = odd_rows(spark).unionByName(spark.createDataFrame([(50 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    rows = rows.selectExpr("*", "'i' ids", "'d' decoded")
    got = forced_cuts.decode_documents(forced_cuts.encode_documents(rows)).collect()
    want = [library.encode(r["text"] or "", add_special_tokens=False).ids for r in rows.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r["doc_id"], list(r["ids"])) for r in got], key=key) == sorted([(r["doc_id"], w) for r, w in zip(rows.collect(), want)], key=key)
    assert all(r["decoded"] == library.decode(list(r["ids"]), skip_special_tokens=False) for r in got)
    assert forced_cuts.decode_documents(forced_cuts.encode_documents(empty(spark))).collect() == []


def test_query_gives_the_librarys_digests(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op13_forced_cuts(spark, sf).collect()
    assert len(rows) == len(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))

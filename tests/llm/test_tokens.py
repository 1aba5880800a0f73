import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import empty, odd_rows
from pyarrow import fs

from skirmish.llm import byte_pairs, edit_counts, packing, queries, token_files
from skirmish.llm.fragments import FragmentEncoder
from skirmish.llm.tokens import RANKS, TOKENIZER, library_fragments, rank_encoder, ranks_of
from skirmish.session import scratch_path

PARTS = [" ", "  ", "\n", "\t", "a", "bc", "é", "1", "23", "!", "..", "'s", "'re", " ", "　", "😀", "\r\n", "ß", "中", "the", "ing", "THE"]


def made(n, most, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(most))) for _ in range(n)]


LONG = ["a" * 3000, "ab" * 2000, "".join(random.Random(3).choice("etaoinsh") for _ in range(8000)), "=" * 1500, " " * 2000 + "x", "é" * 999]


def test_fragments_encode_like_whole_texts():
    encode = rank_encoder(RANKS).encode_ordinary
    for one in (FragmentEncoder(lambda x: [encode(t) for t in x]), library_fragments(TOKENIZER)):
        texts = made(3000, 30, 1)
        ids, counts = one(texts)
        for t, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
            assert got.tolist() == encode(t), t


def test_added_tokens_are_taken_out_like_in_whole_texts(spark):
    """The library takes the content of an added token out of a text before anything else, wherever it stands."""
    from tokenizers import Tokenizer

    tokenizer, end, r = Tokenizer.from_file(TOKENIZER), "<|endoftext|>", random.Random(12)
    texts = [end, f"end of one.{end}Start of two", f"{end}start", f"{end} start", f"stop{end}", f"stop {end}", f"wo{end}rd", f"a  {end}  b", f"{end}{end} {end}",
             f"a\n{end}\n b", f"<|endof{end}text|>", "<|endoftext|", "< |endoftext|>", "<|endoftext |>"]
    texts += ["".join(r.choice([*PARTS, end, "<|", "|>"]) for _ in range(r.randrange(30))) for _ in range(1000)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    ids, counts = library_fragments(TOKENIZER)(texts)
    for t, w, got in zip(texts, want, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == w, t
    folder = scratch_path(spark, "test-tokens")
    manifest = token_files.write_token_files(spark.createDataFrame(list(enumerate(texts[:14])), "doc_id long, text string"), folder)
    place = 0
    for r, w in zip(sorted(token_files.read_token_files(manifest, folder).collect(), key=lambda r: r["doc_id"]), want):
        assert (r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (place, [*w, 2])
        place += len(w) + 1


def test_matrix_merges_equal_the_library():
    pairs, encode = byte_pairs.byte_pairs(RANKS), rank_encoder(RANKS).encode_ordinary
    texts = made(2000, 60, 2) + LONG
    for t, got in zip(texts, pairs.encode(texts)):
        assert got.tolist() == encode(t), t[:80]
        assert pairs.decode(got).tobytes() == t.encode()


def test_bpe_query(spark, sf):
    encode = rank_encoder(RANKS).encode_ordinary
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op3_byte_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = encode(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
    assert byte_pairs.encode_documents(odd_rows(spark)).count() == 9 and byte_pairs.encode_documents(empty(spark)).count() == 0


def test_token_files(spark):
    """Many small shards: order, starts, ids and random access equal the library's own ids."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = made(200, 40, 5)
    texts[5], texts[90] = "end.<|endoftext|>Start", "<|endoftext|> x<|endoftext|>"
    rows = [(7 * i % 200, t) for i, t in enumerate(texts)] + [(None, "null id"), (500, None), (501, "twice"), (501, "twice")]
    rows += [(None, "null id")] * 60 + [(501, "twice")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = scratch_path(spark, "test-tokens")
    manifest = token_files.write_token_files(docs, folder, shard_ids=200)
    got = sorted(token_files.read_token_files(manifest, folder).collect(), key=lambda r: r["start"])
    want, place = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), 0
    assert manifest.count() > 3 and len(got) == len(want)
    for (key, text), r in zip(want, got):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"]) == (key, place) and np.frombuffer(r["ids"], "<u4").tolist() == ids
        place += len(ids)


def test_both_libraries_agree_on_the_vocabulary():
    """Merging by rank gives the library's ids for every token that is a text, and for every code point inside a word and alone."""
    from tokenizers import Tokenizer

    tokenizer, run = Tokenizer.from_file(TOKENIZER), library_fragments(TOKENIZER)
    texts = [t.decode() for t in ranks_of(RANKS) if t.decode(errors="ignore").encode() == t]
    texts += [f"a{chr(c)}1 {chr(c)}." for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    ids, counts = run(texts)
    ends = np.cumsum(counts)
    want = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert all(ids[e - n:e].tolist() == w.ids for e, n, w in zip(ends, counts, want))


@pytest.mark.parametrize("ids", [[], [5], [255, 256, 70000, 1 << 25, 0, 3], [i * 37 % 60000 for i in range(5000)]])
def test_shard_gives_any_token(tmp_path, ids):
    path = str(tmp_path / "s.dac")
    counts = np.array([0, len(ids) // 2, len(ids) - len(ids) // 2])
    with open(path, "wb") as f:
        f.write(b"".join(token_files.shard_bytes([3, None, 9], counts, np.array(ids, np.uint32))))
    with token_files.TokenShard(fs.LocalFileSystem(), path) as shard:
        assert [shard.token(i) for i in range(len(ids))] == ids
        for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2)):
            assert shard.slice(a, b).tolist() == ids[a:b]
        assert shard.document(1).tolist() == ids[:len(ids) // 2] and shard.keys(0, 3) == [3, None, 9]


def test_token_files_odd_rows(spark, sf):
    folder = scratch_path(spark, "test-tokens")
    assert token_files.read_token_files(token_files.write_token_files(odd_rows(spark), folder), folder).count() == 9
    folder = scratch_path(spark, "test-tokens")
    assert token_files.read_token_files(token_files.write_token_files(empty(spark), folder), folder).count() == 0
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    place = 0
    for r in sorted(queries.op5_token_files(spark, sf).collect(), key=lambda r: r["doc_id"]):
        ids = [*rank_encoder(RANKS).encode_ordinary(docs[r["doc_id"]]), 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        place += len(ids)


def plain_best_fit(sizes, costs):
    """Every open bin is looked at for every size; of those with equal room the last one used."""
    bins, left = [], sum(sizes)
    for step, s in enumerate(sizes):
        fits = [b for b in bins if b[0] - b[1] >= s]
        if fits:
            b = min(fits, key=lambda b: (b[0] - b[1], -b[2]))
        else:
            b = [min((n for n in costs if n >= s), key=lambda n: (costs[n] / min(n, left), n)), 0, 0]
            bins.append(b)
        b[1] += s
        b[2] = step
        left -= s
    return sorted(b[1] for b in bins)


def test_packing_equals_plain_best_fit():
    r = random.Random(8)
    for _ in range(30):
        sizes = sorted((r.choice([r.randrange(1, 100), r.randrange(1, 1025)]) for _ in range(r.randrange(1, 120))), reverse=True)
        costs = {n: n + 8 + n * n // 2048 for n in (128, 256, 512, 1024)}
        bins, offsets, lengths = packing.pack(sizes, costs)
        fill, spans = {}, {}
        for b, o, s in zip(bins, offsets, sizes):
            fill[b] = fill.get(b, 0) + s
            spans.setdefault(b, []).append((o, o + s))
        assert sorted(fill.values()) == plain_best_fit(sizes, costs)
        for b, f in fill.items():
            assert lengths[b] == min(n for n in costs if n >= f)
            assert sum(e - a for a, e in spans[b]) == f == max(e for _, e in spans[b])


def test_packing_places_every_token_once(spark):
    counts = spark.createDataFrame([(i % 50 if i % 7 else None, i * 97 % 3000) for i in range(500)], "doc_id long, n_tokens long")
    costs = {256: 300, 512: 560, 1024: 1200}
    got = packing.pack_documents(counts, costs, group=60).collect()
    assert sum(r["n_tokens"] for r in got) == sum(i * 97 % 3000 for i in range(500))
    by_bin = {}
    for r in got:
        assert (r["bin"] is None) == (r["n_tokens"] == 0)
        if r["bin"] is not None:
            by_bin.setdefault((r["bin"], r["bin_length"]), []).append((r["bin_offset"], r["n_tokens"]))
    assert len({b for b, _ in by_bin}) == len(by_bin)
    for (_, length), pieces in by_bin.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    assert sum(n for _, n in by_bin) / sum(r["n_tokens"] for r in got) < 1.1
    assert packing.pack_documents(packing.token_counts(odd_rows(spark))).filter("piece = 0").count() == 9
    assert packing.pack_documents(packing.token_counts(empty(spark))).count() == 0


def test_edits_equal_fresh_counts():
    split, count = edit_counts._tools(RANKS)
    r = random.Random(9)
    for t in made(300, 500, 11) + ["", "x", "".join(PARTS) * 60]:
        tree = edit_counts.CountTree(t, split, count)
        for _ in range(6):
            a = r.randrange(len(tree.text) + 1)
            b = min(len(tree.text), a + r.choice([0, 0, 1, 2, 5, 40, 900]))
            new = "".join(r.choice(PARTS) for _ in range(r.choice([0, 0, 1, 2, 3, 30])))
            want = tree.text[:a] + new + tree.text[b:]
            tree.edit(a, b, new)
            assert tree.text == want and tree.tokens == len(rank_encoder(RANKS).encode_ordinary(want)), (want, a, b, new)
            assert [c for leaf in tree.leaves for c, _ in leaf] == [len(w) for w in split(want, 0)]


def test_edit_recounts_only_what_it_touches():
    split, count = edit_counts._tools(RANKS)
    tree = edit_counts.CountTree("word and another " * 5000, split, count)
    tree.encoded = 0
    tree.edit(40_000, 40_004, "changed")
    assert tree.encoded < 10 and tree.tokens == len(rank_encoder(RANKS).encode_ordinary(tree.text))


def test_edit_query(spark, sf):
    import re

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = lambda t: len(rank_encoder(RANKS).encode_ordinary(t))
    rows = queries.op9_edit_counts(spark, sf).collect()
    assert len(rows) == len(docs) and any(r["n_edits"] for r in rows)
    for r in rows:
        t = docs[r["doc_id"]]
        new, n = re.subn("[0-9]{4,}", "<num>", t)
        assert (r["n_tokens"], r["n_edits"], r["n_tokens_edited"]) == (size(t), n, size(new))
    odd = odd_rows(spark).withColumn("edits", edit_counts.masked_numbers())
    assert edit_counts.count_with_edits(odd).count() == 9 and edit_counts.count_with_edits(empty(spark).withColumn("edits", edit_counts.masked_numbers())).count() == 0


def test_many_edits_in_one_walk():
    """Random edits, touching and overlapping ones included, against a fresh count of the text made plainly."""
    split, count = edit_counts._tools(RANKS)
    r = random.Random(12)
    for t in made(150, 400, 13) + ["", "x", "  \n ", "".join(PARTS) * 80]:
        tree = edit_counts.CountTree(t, split, count)
        for _ in range(3):
            n, old = len(tree.text), tree.text
            edits = [(a, a + r.choice([0, 0, 1, 3, 30, -2]), "".join(r.choice(PARTS) for _ in range(r.choice([0, 1, 2, 9])))) for a in (r.randrange(-3, n + 4) for _ in range(r.randrange(12)))]
            want, done, made_ = [], 0, 0
            for a, b, new in sorted((min(max(a, 0), n), min(max(b, a, 0), n), new) for a, b, new in edits):
                if a >= done:
                    want += [old[done:a], new]
                    done, made_ = b, made_ + 1
            want = "".join([*want, old[done:]])
            assert tree.edit_all(edits) == made_ and tree.text == want
            assert [c for leaf in tree.leaves for c, _ in leaf] == [len(w) for w in split(want, 0)], (old, edits)
            assert tree.tokens == sum(k for leaf in tree.leaves for _, k in leaf) == len(rank_encoder(RANKS).encode_ordinary(want))


def test_edits_do_not_copy_the_text():
    """As many edits as there are words of a long text, in about the time of one count."""
    import time

    split, count = edit_counts._tools(RANKS)
    tree = edit_counts.CountTree("word and another 12345 " * 40_000, split, count)
    start = time.time()
    assert tree.edit_all([(23 * i, 23 * i + 4, "changed") for i in range(40_000)]) == 40_000
    assert time.time() - start < 20 and tree.tokens == len(rank_encoder(RANKS).encode_ordinary(tree.text))


def test_edits_with_nulls(spark):
    rows = [(1, "one two three", [(0, 3, "1"), None, (None, 3, "x"), (4, None, "y"), (8, 99, None), (2, 5, "over")]), (2, None, [(0, 0, "new text")]), (3, "same", None), (None, "", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>")
    size = lambda t: len(rank_encoder(RANKS).encode_ordinary(t))
    got = {r["doc_id"]: (r["n_tokens"], r["n_edits"], r["n_tokens_edited"]) for r in edit_counts.count_with_edits(df).collect()}
    assert got == {1: (size("one two three"), 2, size("1 two ")), 2: (0, 1, size("new text")), 3: (size("same"), 0, size("same")), None: (0, 0, 0)}

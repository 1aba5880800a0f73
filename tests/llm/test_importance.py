import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import empty, odd_rows

from skirmish.llm import importance
from skirmish.llm.importance import Words, running, shift


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(docs, target, low, high, buckets, percent, least):
    grams = lambda t: [" ".join(w[i:i + n]) for w in [plain_words(t)] for n in range(low, high + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(bucket(g) for _, x in docs for g in grams(x)), Counter(bucket(g) for x in target for g in grams(x))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    rows = []
    for key, text in docs:
        weight = sum(gain(bucket(g)) for g in grams(text))
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(plain_words(text)), len(grams(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    for rank, r in enumerate(may[:percent * len(may) // 100], 1):
        r[5] = rank
    return rows


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_checksums_of_runs_follow_from_two_prefixes():
    """Against zlib, across lanes and blocks, with words longer than both."""
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abzAZ09éß日😀-_\n ") for _ in range(r.choice([1, 3, 9, 200]))) for _ in range(r.randrange(60))) for _ in range(200)]
    texts += ["", "x" * (importance.BLOCK + 777) + " y", "--", "a", "a b" * 5, "q" * importance.BLOCK, "tail"]
    words = Words([t.encode() for t in texts])
    for n in (1, 2, 3, 7):
        got, runs = words.crc(n)
        want = [[zlib.crc32(" ".join(w[i:i + n]).encode()) for i in range(len(w) - n + 1)] for w in map(plain_words, texts)]
        assert runs.tolist() == list(map(len, want)) and got.tolist() == [c for w in want for c in w]


def test_running_values_and_shifts():
    line = np.frombuffer(random.Random(1).randbytes(importance.BLOCK * 2 + 50), np.uint8)
    ends = np.array([1, 63, 64, 65, importance.BLOCK, importance.BLOCK + 1, len(line)])
    plain_crc = [zlib.crc32(line[:e].tobytes(), 0xFFFFFFFF) ^ 0xFFFFFFFF for e in ends]
    assert running(line, ends).tolist() == plain_crc
    assert shift(np.array([0xFFFFFFFF] * 3, np.uint32), np.array([0, 5, 100_000])).tolist() == [0xFFFFFFFF, *(zlib.crc32(bytes(n)) ^ 0xFFFFFFFF for n in (5, 100_000))]


@pytest.mark.parametrize("low,high,buckets", [(1, 1, 10_000), (1, 3, 97), (2, 2, 10)])
def test_draw_equals_a_plain_version(spark, low, high, buckets):
    docs = odd_rows(spark)
    extra = [(100 + i, " ".join(random.Random(i % 17).choice(["éa", "B2", "gamma7", "zeta9", "x"]) for _ in range(15 + i % 12))) for i in range(80)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    target = spark.createDataFrame([("Gamma7 zeta9, zeta9!",), (None,), ("",)], "text string")
    got = importance.resample(docs, target, low, high, buckets, percent=30).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain(rows, ["Gamma7 zeta9, zeta9!", None, ""], low, high, buckets, 30, 20)
    assert ordered(got) == ordered(want) and any(r["rank"] for r in got)


def test_no_documents_no_target(spark):
    none = empty(spark)
    assert importance.resample(none, none).collect() == []
    rows = importance.resample(odd_rows(spark), none).collect()
    assert len(rows) == 9 and all(r["n_features"] == r["n_words"] for r in rows)

import numpy as np
from pyspark.sql import functions as F

from skirmish.llm import hash_forest as hf


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'a' v", "'b' query")


def plain(rows, queries, k=10):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        out[q] = [(int(ids[i]), d[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return out


def test_small_and_odd_tables_are_exact(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).astype(float).tolist()) for i in range(40)] + [(50 + i, [1.0] * 8) for i in range(15)] + [(100, [1.0] * 8)]
    odd = [(200, None), (300, [0.0] * 8), (400, [float("nan")] * 8), (500, [None] + [1.0] * 7), (600, []), (700, [1.0, 2.0]), (None, [1.0] * 8), (800, [float("inf")] * 8)]
    got = {}
    for row in hf.search(table(spark, rows + odd), F.col("vec_id") % 10 == 0).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    want = plain(rows, [i for i, _ in rows if i % 10 == 0])
    assert set(got) == set(want)
    for q, found in got.items():
        assert [(v, round(s, 9)) for _, v, s in sorted(found)] == [(v, round(s, 9)) for v, s in want[q]], q
    few = table(spark, rows[:3])
    assert [r["vec_id"] for r in hf.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [v for v, _ in plain(rows[:3], [0])[0]]
    assert hf.search(few.limit(0), F.col("vec_id") == 0).count() == 0 and hf.search(few, F.col("vec_id") == 7).count() == 0


def test_recall_without_the_root(spark):
    """Random directions, the hardest case, with a hot group of near copies: the trees stop before the root."""
    r = np.random.default_rng(2)
    x = r.normal(size=(6000, 32))
    x[:1500] = x[0] + 0.05 * r.normal(size=(1500, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    queries = [i for i in range(6000) if i % 200 == 0]
    got = {}
    for row in hf.search(table(spark, rows), F.col("vec_id") % 200 == 0, candidates=2000).collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    want = plain(rows, queries)
    recall = np.mean([len(got[q] & {v for v, _ in want[q]}) / 10 for q in queries])
    assert recall >= 0.9, recall


def test_candidates_follow_the_index(spark):
    """A number of candidates that is small for the index: the trees still ascend as far as its size asks, to distinct vectors."""
    x = np.random.default_rng(3).normal(size=(6000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    got = {}
    for row in hf.search(table(spark, rows), F.col("vec_id") % 200 == 0, candidates=64).collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    want = plain(rows, [i for i in range(6000) if i % 200 == 0])
    recall = np.mean([len(got.get(q, set()) & {v for v, _ in found}) / 10 for q, found in want.items()])
    assert recall >= 0.9, recall


def test_descent_and_ascent_on_sorted_arrays():
    """Longest matches and the prefixes at which the ascent stops, against comparing all strings."""
    r = np.random.default_rng(5)
    strings, query = r.integers(0, 1 << 12, (700, 6)).astype(np.int32), r.integers(0, 1 << 12, (40, 6)).astype(np.int32)
    query[:5] = strings[:5]
    forest = hf.Forest(strings, 12)
    shared = lambda q: 12 - np.vectorize(lambda v: int(v).bit_length())(strings ^ q)  # noqa: E731 (vectors x trees)
    assert (forest.descend(query) == np.stack([shared(q).max(0) for q in query])).all()
    for need in (1, 30, 400, 700):
        found = dict(forest.search(query, need))
        assert set(found) == set(range(40))
        for i, at in found.items():
            best = shared(query[i]).max(1)  # of each vector, over the trees
            level = np.sort(best)[-need]
            assert at.tolist() == np.flatnonzero(best >= level).tolist()


def test_repeated_ids_and_several_blocks(spark, monkeypatch):
    """Rows of one id with different vectors each take part, whatever the number of blocks."""
    monkeypatch.setattr(hf, "BLOCK", 20)
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=6).tolist()) for i in range(90)] + [(5, [1.0] * 6), (5, [1.0] * 6), (6, [-1.0] * 6)]
    got = {}
    for row in hf.search(table(spark, rows), F.col("vec_id") == 40, candidates=1000).collect():
        got[row["rank"]] = (row["vec_id"], round(row["score"], 9))
    x = np.array([v for _, v in rows], np.float32).astype(float)
    pairs = sorted({(round(float(np.sqrt(((v - x[40]) ** 2).sum())), 9), i) for (i, _), v in zip(rows, x) if i != 40})[:10]
    assert [got[k + 1] for k in range(10)] == [(i, d) for d, i in pairs]

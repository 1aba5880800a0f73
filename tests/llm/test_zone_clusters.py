import hashlib
import itertools
import math
import random

import numpy as np

from skirmish.llm import zone_clusters
from skirmish.llm.zone_clusters import candidates, cluster, hilbert_keys, nearest


def plain(rows, k, rounds, dimensions, scale=64):
    kept = []
    for key, x in rows:
        if x is None or len(x) != dimensions or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [math.floor(scale * c) for c in x]
        if max(map(abs, v)) <= zone_clusters.LARGEST:
            kept.append((key, v))
    sha = lambda key: hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    stored = lambda v: np.array(v, "<i4").tobytes()
    centroids = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[0] is None, r[0] or 0, stored(r[1])))[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda v: min((far(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(c) // len(g) for c in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    found = [(key, *near(v)) for key, v in kept]
    own = [sum(d for _, d, i in found if i == j) for j in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(key, i, d, own[i], sum(own), names[i]) for key, d, i in found]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_curve_visits_neighbours():
    """Every cell once, and each step changes one coordinate by one."""
    for bits, n in ((2, 2), (3, 2), (2, 3), (1, 4)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        keys = [k.tobytes() for k in hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_boxes_never_lose_the_nearest():
    r = np.random.default_rng(3)
    for spread in (1, 30, 1 << 24):
        for _ in range(50):
            centroids = r.integers(-spread, spread + 1, (9, 4))
            vectors = r.integers(-spread, spread + 1, 4) + r.integers(-2, 3, (20, 4))
            low, high = vectors.min(0), vectors.max(0)
            want = [min((int(((v - c) ** 2).sum()), i) for i, c in enumerate(centroids)) for v in vectors]
            number, distance = nearest(vectors, low, high, centroids)
            assert list(zip(distance.tolist(), number.tolist())) == want
            assert set(number.tolist()) <= set(candidates(low, high, centroids).tolist())
    assert len(candidates(np.array([5, 5]), np.array([5, 5]), np.array([[5, 5], [90, 90], [4, 5]]))) == 1


def test_clusters_equal_a_plain_version(spark):
    r = random.Random(9)
    centre = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.05) for c in centre[i % 5]]) for i in range(700)]
    rows += [(1000 + i, [0.5, 0.25, -0.5, 0.0]) for i in range(600)]  # one hot vector
    rows += [(7, [0.1, 0.2, 0.3, 0.4]), (7, [0.1, 0.2, 0.3, 0.4]), (None, [9.0, -9.0, 0.0, 1.0]), (1, None), (2, []), (3, [1.0] * 5), (4, [1.0, None, 1.0, 1.0]),
             (5, [1.0, float("nan"), 0.0, 0.0]), (6, [float("inf")] * 4), (8, [1e300, 0.0, 0.0, 0.0]), (9, [1e6, -1e6, 1e5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' vector", "1 cluster", "2 low", "'p' place", "0 turn", "'h' hash")
    got = cluster(df.repartition(3), k=6, dimensions=4)
    assert ordered(got.collect()) == ordered(plain(rows, 6, 3, 4))


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.5])], "vec_id long, embedding array<double>")
    assert ordered(cluster(df, k=16, dimensions=2).collect()) == ordered(plain([(1, [1.0, 2.0]), (2, [1.0, 2.5])], 16, 3, 2))
    assert cluster(df, dimensions=3).collect() == [] and cluster(df.limit(0), dimensions=2).collect() == []

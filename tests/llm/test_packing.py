"""The joint choice of lengths: against every single length, against all partitions of small groups, and in the query."""

import random
from collections import defaultdict

import pytest

from skirmish.llm import packing, queries
from skirmish.llm.tokens import RANKS, rank_encoder


def cost_of(packed, costs):
    return sum(costs[n] for n in packed[2])


def single(sizes, costs, length):
    """Best fit, plainly, with bins of one length (longer pieces get the least that fits), each shrunk at the end."""
    bins = []
    for s in sizes:
        fits = [b for b in bins if b[0] - b[1] >= s]
        b = min(fits, key=lambda b: b[0] - b[1]) if fits else [max(length, min(n for n in costs if n >= s)), 0]
        if not fits:
            bins.append(b)
        b[1] += s
    return sum(costs[min(n for n in costs if n >= u)] for _, u in bins)


def least(sizes, costs):
    """The least cost of all partitions."""
    top, best = max(costs), [float("inf")]

    def place(i, fills):
        if i == len(sizes):
            best[0] = min(best[0], sum(costs[min(n for n in costs if n >= f)] for f in fills))
            return
        for k in range(len(fills)):
            if fills[k] + sizes[i] <= top:
                place(i + 1, [*fills[:k], fills[k] + sizes[i], *fills[k + 1:]])
        place(i + 1, [*fills, sizes[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("costs", [packing.COSTS, {n: n + 8 + n * n // 512 for n in (128, 256, 512, 1024, 8192)}, {n: 4 * n + 1000 for n in (512, 1024, 4096, 8192)}])
def test_never_worse_than_one_length(costs):
    r = random.Random(3)
    for draw in (lambda: r.randrange(1, 1500), lambda: r.choice([20, 600, 1100, 3000]), lambda: min(8192, int(r.paretovariate(0.8) * 60)), lambda: r.randrange(500, 700)):
        sizes = sorted((draw() for _ in range(600)), reverse=True)
        packed = packing.pack_jointly(sizes, costs)
        assert cost_of(packed, costs) <= min(single(sizes, costs, n) for n in costs)
        fill = defaultdict(int)
        for b, o, s in zip(packed[0], packed[1], sizes):
            assert o == fill[b]
            fill[b] += s
        assert all(packed[2][b] == min(n for n in costs if n >= f) for b, f in fill.items())


def test_several_lengths_are_opened():
    """Pieces just above a half of 1024 and of 2048: neither one length is best for both."""
    sizes = [1900] * 40 + [1000] * 40 + [500] * 40
    costs = {n: n + n * n // 4096 for n in (512, 1024, 2048, 4096, 8192)}
    packed = packing.pack_jointly(sizes, costs)
    assert sorted(set(packed[2])) == [512, 1024, 2048] and cost_of(packed, costs) < min(single(sizes, costs, n) for n in (2048, 4096, 8192))


def test_near_the_least_of_all_partitions():
    r = random.Random(5)
    gaps = []
    for _ in range(60):
        sizes = sorted((r.randrange(1, 5000) for _ in range(r.randrange(1, 8))), reverse=True)
        gaps.append(cost_of(packing.pack_jointly(sizes, packing.COSTS), packing.COSTS) / least(sizes, packing.COSTS))
    assert min(gaps) >= 1 and max(gaps) < 1.2 and sum(gaps) / len(gaps) < 1.02, (max(gaps), sum(gaps) / len(gaps))
    assert packing.pack_jointly([], packing.COSTS) == ([], [], [])


def test_query_packs_every_token_once(spark, sf):
    """Token counts by the library, bins within their length, and per group no single length costs less."""
    docs = {r["doc_id"]: len(rank_encoder(RANKS).encode_ordinary(r["text"] or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_best_fit(spark, sf).collect()
    placed, fill, length, groups = defaultdict(list), defaultdict(list), {}, defaultdict(list)
    for r in rows:
        placed[r["doc_id"]].append((r["start"], r["n_tokens"]))
        if r["bin"] is not None:
            fill[r["bin"]].append((r["bin_offset"], r["n_tokens"]))
            assert length.setdefault(r["bin"], r["bin_length"]) == r["bin_length"]
            groups[r["bin"] >> 32].append(r["n_tokens"])
    assert set(placed) == set(docs)
    for doc, n in docs.items():
        at = 0
        for start, size in sorted(placed[doc]):
            assert start == at and size <= max(packing.COSTS)
            at += size
        assert at == n
    for b, pieces in fill.items():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert length[b] == min(n for n in packing.COSTS if n >= at)
    for group, sizes in groups.items():
        total = sum(packing.COSTS[n] for b, n in length.items() if b >> 32 == group)
        assert total <= min(single(sorted(sizes, reverse=True), packing.COSTS, n) for n in packing.COSTS)

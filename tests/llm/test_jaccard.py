import random
import re

import pytest
from helpers import empty, odd_rows, prose

from skirmish.llm import jaccard_join as jj, shingles


def shingled(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain(rows):
    """Class and links of each row by comparing every two."""
    sets = [shingled(t) for _, t in rows]
    near = lambda a, b: a and b and len(a & b) >= 0.8 * len(a | b) - 1e-12
    linked = [[j for j in range(len(rows)) if j != i and near(sets[i], sets[j])] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in linked[i])]) for i in range(len(rows))]
    ids = {}
    for (k, _), c in zip(rows, root):
        if k is not None:
            ids[c] = min(ids.get(c, k), k)
    return [(k, ids.get(c), len(x), len({frozenset(sets[j]) for j in x} - {frozenset(sets[i])})) for i, ((k, _), c, x) in enumerate(zip(rows, root, linked))]


def near_copy(text, changes, seed):
    r = random.Random(seed)
    words = text.split()
    for _ in range(changes):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    hot = prose(150, 1)
    out = [near_copy(hot, c % 4, c) for c in range(60)] + [hot] * 30 + [hot.upper() + " \n"]
    out += [prose(120, 100 + i) for i in range(40)]
    for i in range(40):
        base = prose(60 + 5 * i, 500 + i)
        out += [base, near_copy(base, i % 6, i)]
    passage = prose(60, 77)
    out += [prose(60, 900 + i) + " " + passage for i in range(40)]
    out += ["one two", "One  two", "one", "", None, " \n", "a b c d e", "a b c d e"]
    random.Random(5).shuffle(out)
    return [(i if i % 41 else None, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("members", [256, 8])
def test_links_and_classes_equal_all_pairs(spark, rows, members, monkeypatch):
    """Also with buckets dealt into many blocks."""
    monkeypatch.setattr(jj, "MEMBERS", members)
    got = jj.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    have = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_text_links"]) for r in got.collect()), key=key)
    want = plain(rows)
    empties = {i for i, (_, t) in enumerate(rows) if not shingled(t)}
    want = sorted(((k, k, 0, 0) if i in empties else (k, c, n, m) for i, (k, c, n, m) in enumerate(want)), key=key)
    assert have == want


def test_one_row_of_each_class_stays(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'q' row", "'r' doc", "'k' k1")
    kept = jj.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    classes = {r["class_row"]: set() for r in jj.link(docs).select("class_row").collect()}
    texts = [r["text"] for r in kept.collect()]
    assert len(texts) == len(classes)
    sets = [shingled(t) for t in texts if shingled(t)]
    assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    again = jj.drop_near_duplicates(docs.unionAll(docs))
    assert sorted(r["text"] or "" for r in again.collect()) == sorted(t or "" for t in texts)


def test_odd_rows(spark):
    got = {(r["doc_id"], r["n_links"]) for r in jj.link(odd_rows(spark)).collect()}
    assert (1, 2) not in got and {(1, 2), (6, 2)} & got == set() or {(1, 2), (6, 2)} <= got
    assert jj.link(odd_rows(spark)).count() == 9 and jj.link(empty(spark)).count() == 0
    assert jj.drop_near_duplicates(empty(spark)).count() == 0


def test_components_join_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101)], "a long, b long")
    assert {(r["a"], r["b"]) for r in jj.components(edges).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100), (102, 100)}


def test_pruning_keeps_pairs_at_the_threshold():
    from math import comb

    for n, m in jj.least_matches(0.8, 1e-6).items():
        assert sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m)) < 1e-5
    sets = shingles.shingle_sets([prose(300, 1), prose(300, 2)])
    assert len(sets[0]) == len({w for w in shingled(prose(300, 1))})

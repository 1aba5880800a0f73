import random
import re
from collections import Counter

from helpers import empty, odd_rows, prose

from skirmish.llm import rules


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_measures_equal_plain_version(spark):
    r = random.Random(1)
    parts = ["a", "b", "c d", "é", "\n", " ", "\t", "#", "x\x0by", " ", "<&>", "\r\n", "long word"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(200))) for _ in range(300)] + ["a b c " * 100, prose(200, 1), None, "", "w", "w w w w", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' source")
    for row in rules.assess(df).collect():
        got = tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == plain(texts[row["doc_id"]]), texts[row["doc_id"]]


def test_host_verdicts(spark):
    """In a poor host one minor failure is enough; good documents stay in every host."""
    good = lambda i: prose(100, i)
    symbols = lambda i: prose(100, i).replace(" ", " # ", 20)
    rows = [(i, good(i) if i % 10 == 0 else "short", "poor") for i in range(200)] + [(1000 + i, good(i), f"h{i % 5}") for i in range(200)]
    rows += [(5000, symbols(1), "poor"), (5001, symbols(2), "h1")]
    got = {r["doc_id"]: r for r in rules.assess(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["kept"] == (i % 10 == 0) for i in range(200)) and all(got[1000 + i]["kept"] for i in range(200))
    assert not got[5000]["kept"] and got[5001]["kept"]
    assert 0.5 < got[0]["host_rate"] < 181 / 201 + 0.01 and got[1000]["host_rate"] < 0.1


def test_filter_keeps_columns_and_agrees(spark):
    docs = odd_rows(spark)
    kept = rules.filter_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == sorted((r["doc_id"] or 0) for r in rules.assess(docs).collect() if r["kept"])


def test_odd_rows(spark):
    got = rules.assess(odd_rows(spark)).collect()
    assert len(got) == 9 and all(not r["kept"] for r in got if r["n_words"] == 0)
    assert rules.assess(empty(spark)).count() == 0 and rules.filter_documents(empty(spark)).count() == 0

import hashlib
import random
import re

from helpers import empty, odd_rows
from pyspark.sql import functions as F

from skirmish.llm import pii, queries

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else None,
                  "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def texts():
    r = random.Random(4)
    parts = ["a@b.co", "x.y+z@", "@", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111111111111112", "+1 (301) 555-0346", "+", "é", "😀",
             " ", "-", "12", "7", "_d@e.f-g.h", "79927398713", "(555)", "\n", "q"]
    made = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(400)]
    return [*made, "1" * 20000, "a." * 20000, "1." * 9000, "x@" + "a." * 5000 + "b", "+1" + "2(" * 5000, "a@b.c " * 700]


def test_base_equals_plain_patterns(spark):
    rows = list(enumerate(texts()))
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select(
        "doc_id", F.expr("transform(filter(spans, s -> s.kind in ('email', 'ip', 'card', 'phone')), s -> (s.start, s.rank, s.end, s.kind))").alias("s")).collect()
    for r in got:
        assert [tuple(s) for s in r["s"]] == plain_spans(rows[r["doc_id"]][1]), rows[r["doc_id"]][1][:200]


def test_added_kinds_need_checks_and_context(spark):
    rows = [(0, "pay to DE89 3704 0044 0532 0130 00 now"), (1, "pay to DE89 3704 0044 0532 0130 01 now"), (2, "my SSN is 078-05-1120."), (3, "part 078-05-1120.")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] not in pii.BASE]
           for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: [("iban", 7, 34)], 1: [], 2: [("national_id", 10, 21)], 3: []}


def test_account_numbers_before_other_words(spark):
    """What follows a number, or starts like one before it, does not hide it, however it is written."""
    de, gb, no = "DE89370400440532013000", "GB82WEST12345698765432", "NO9386011117947"
    spaced = "DE89 3704 0044 0532 0130 00"
    made = [(f"IBAN {de} Please pay", [de]), (f"account {gb} 12 May", [gb]), (f"IBAN {spaced} BIC COBADEFF", [spaced]), (f"{gb} I paid", [gb]), (f"{de} {gb} {no}", [de, gb, no]),
            (f"NO12 3456789 {spaced} 1", [spaced]), (f"{de} 2024-05-12", [de]), (f"{de} ACME GMBH 77", [de]), (f"x{de} A", []), (f"{de}A", []), (f"DE88{de[4:]} PAY", []),
            ("A1 " * 20000 + de + " B", [de])]
    rows = [(i, t) for i, (t, _) in enumerate(made)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.find(docs).collect():
        text, want = made[r["doc_id"]]
        assert [text[s["start"]:s["end"]] for s in r["spans"] if s["kind"] == "iban"] == want, text[:80]
    assert [r["text"] for r in pii.redact(docs).orderBy("doc_id").limit(3).collect()] == ["IBAN <IBAN> Please pay", "account <IBAN> 12 May", "IBAN <IBAN> BIC COBADEFF"]


def test_redaction(spark):
    body = "é" * 5000
    rows = [(0, "mail a.b@c.de or +1 (301) 555-0346!"), (1, None), (2, body + " 1.2.3.4 " + body), (3, "x 1.2.3.4@a.b.co y 1.2.3.4"), (4, "+1 4111 1111 1111 1111")]
    df = pii.redact(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("own")))
    got = {r["doc_id"]: r["text"] for r in df.collect()}
    assert df.columns == ["doc_id", "text", "spans"]
    assert got[0] == "mail <EMAIL> or <PHONE>!" and got[1] is None and got[2] == f"{body} <IP> {body}"
    assert got[3] == "x <EMAIL> y <IP>" and got[4] == rows[4][1]  # 17 digits: neither phone nor card, and no second try


def test_query_digests(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain_spans(docs[r["doc_id"]] or "")
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(w[3] == k for w in want) for k in pii.BASE]


def test_odd_rows(spark):
    assert pii.find(odd_rows(spark)).count() == 9 and pii.find(empty(spark)).count() == 0
    assert pii.redact(odd_rows(spark)).columns == odd_rows(spark).columns


def test_scores_follow_the_words_around(spark):
    """Words before and after count, for and against; base kinds stay at any score."""
    de, ssn = "DE89370400440532013000", "078-05-1120"
    rows = [(0, f"pay {de}"), (1, f"IBAN {de}"), (2, f"sample {de}"), (3, f"sample IBAN {de}"), (4, f"{de} is my bank account"), (5, f"{ssn} (national id)"),
            (6, f"serial ssn {ssn}"), (7, "example 1.2.3.4"), (8, f"IBAN {'x' * 60} {de}"), (9, f"{de} {'x' * 30} account")]
    got = {r["doc_id"]: [(s["kind"], round(s["score"], 2)) for s in r["spans"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: [("iban", 0.8)], 1: [("iban", 1.0)], 2: [], 3: [("iban", 0.7)], 4: [("iban", 1.0)], 5: [("national_id", 0.6)], 6: [], 7: [("ip", 0.2)],
                   8: [("iban", 0.8)], 9: [("iban", 0.8)]}


def test_time_is_linear_in_the_spans_of_a_text(spark):
    """A text of one megabyte with 32,000 addresses and letters beyond ASCII."""
    import time

    def seconds(n):
        docs = spark.createDataFrame([(1, "é mail a.b@c.de, or write. " * n)], "doc_id long, text string")
        start = time.time()
        assert pii.find(docs).select(F.size("spans")).first()[0] == n
        return time.time() - start

    seconds(100)
    small, large = seconds(8000), seconds(32000)
    assert large < 10 * small + 5, (small, large)

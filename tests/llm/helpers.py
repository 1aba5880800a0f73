"""Rows that every operator must take: nulls, empty and long texts, repeated rows, clashing column names."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, source string, n_words string, spans string, row string, score string"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def odd_rows(spark):
    long = prose(30_000, 1) + "x" * 50_000
    rows = [(1, prose(80, 2), "a"), (1, prose(80, 2), "a"), (2, None, "a"), (3, "", None), (None, prose(60, 3), "b"), (4, long, "b"),
            (5, " \n\t ", "b"), (6, prose(80, 2), None), (None, None, None)]
    return spark.createDataFrame([(*r, "x", "y", "z", "s") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

from helpers import empty, odd_rows, prose
from pyspark.sql import functions as F

from skirmish.llm import classifier, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op10_neighbour_vote(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    poor = [r for r in rows if r["quality"] == 0]
    assert right >= 0.95 and sum(r["predicted"] == 0 for r in poor) / len(poor) >= 0.8, (right, len(poor))


def test_odd_rows_and_missing_labels(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = odd_rows(spark).unionByName(spark.createDataFrame([(i, prose(60, i) if i % 2 else "$$ ## " * 30, "s", "x", "y", "z", "s") for i in range(10, 40)], odd_rows(spark).schema))
    got = classifier.classify(docs, labels).collect()
    assert len(got) == 39 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] >= 10)
    assert {r["score"] for r in classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classifier.classify(empty(spark), labels).count() == 0
    kept = classifier.filter_documents(docs, labels)
    assert kept.columns == docs.columns and kept.filter(F.col("text").startswith("$$")).count() == 0


def test_shapes_cover_whole_words():
    assert classifier._shape("a" * 100 + "1") == "a0" and classifier._shape("Ab--c" * 40) == "Aa-a" + "Aa-a" * 39
    assert classifier._shape("ÉéÑ99_é") == "AaA0_a" and classifier._shape("x") == "a" and classifier._shape("\n") == "\n"
    long = ["q" * 70 + "!" * 30, "q" * 70 + "?" * 30]
    a, b = classifier.counted(long)
    assert (a != b).any()


def test_votes_equal_plain_cosines(spark, sf):
    """The query's scores against one loop over all labelled vectors per document."""
    import math

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = classifier.fit(docs, labels)
    near = [(v.astype(float), float(y)) for v, y in zip(model.vectors, model.labels)]
    scores = {r["doc_id"]: r["score"] for r in queries.op10_neighbour_vote(spark, sf).collect()}
    assert len(near) > classifier.NEIGHBOURS
    for r in docs.collect():
        (x,) = classifier.counted([r["text"] or ""])
        x = [math.log1p(c) * float(w) for c, w in zip(x, model.weights)]
        point = [float(p) for p in x @ model.space.astype(float)]
        size = math.sqrt(sum(p * p for p in point))
        votes = sorted(((sum(a * b for a, b in zip(point, v)) / size if size else 0.0, y) for v, y in near), key=lambda t: -t[0])[:classifier.NEIGHBOURS]
        weights = [max(c, 0) ** 4 for c, _ in votes]
        want = sum(w * y for w, (_, y) in zip(weights, votes)) / sum(weights) if sum(weights) else model.mean
        assert abs(scores[r["doc_id"]] - want) < 1e-3, r["doc_id"]

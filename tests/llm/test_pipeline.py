import random

import corpus_pipeline as pipeline
from helpers import prose

from skirmish.session import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near_copy(text, seed):
    words = text.split()
    words[random.Random(seed).randrange(len(words))] = "changed"
    return " ".join(words)


def test_stages_keep_columns_and_decide(spark, sf):
    good = [(i, prose(120, i)) for i in range(60)]
    junk = [(100 + i, "### $$$ %%% *** " * 40) for i in range(30)]
    copies = [(200 + i, prose(120, i)) for i in range(20)] + [(300 + i, near_copy(prose(120, i), i)) for i in range(20)]
    private = [(400, prose(120, 999) + " mail some.one@mail.example.com or +1 (301) 555-0346")]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in good + junk + copies + private] + [(500, None, None, None, None), (501, "", "en", "s1", 0)]
    folder = scratch_path(spark, "pipeline-test")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in [*range(60), *range(100, 130)]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, ids = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k + 1 < len(pipeline.STAGES):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = set(range(60)) | {400}
    assert not ids["quality_classifier"] & set(range(100, 130)) and clean <= ids["quality_classifier"]
    assert ids["quality_rules"] == ids["quality_classifier"] - {500, 501}
    assert ids["near_duplicates"] == clean == ids["personal_data"] == ids["best_fit_packing"]
    text = spark.read.parquet(f"{folder}/3").filter("doc_id = 400").first()
    assert "<EMAIL> or <PHONE>" in text["text"] and text["n_chars"] == len(text["text"])
    assert sorted(r["doc_id"] for r in pipeline.run(spark, folder).select("doc_id").distinct().collect()) == sorted(clean)


def test_empty_documents(spark, sf):
    folder = scratch_path(spark, "pipeline-test")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    assert pipeline.run(spark, folder).count() == 0

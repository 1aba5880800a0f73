from pyspark.sql import functions as F

from skirmish.operators.ordered import gap_segments
from skirmish.plans.fights import segment_spans
from skirmish.session import scratch_path
from skirmish.streaming.segments import stream_segments

SCHEMA = "match_id string, team_a long, team_b long, t double"
COLUMNS = ["match_id", "team_a", "team_b", "seg_start", "seg_end", "n_hits"]


def test_matches_in_separate_batches_equal_batch(spark):
    """One file per micro-batch: a match that begins an hour after another has reached t = 1800 loses nothing."""
    early = [("m", 1, 2, float(t)) for t in (0, 10, 20.5, 21, 50, 60, 71, 1800)] + [("m", 1, 3, 5.0)]
    later = [("n", 1, 2, 5.0), ("n", 1, 2, 14.0), ("n", 2, 3, 400.0)]
    # a last match far ahead moves the watermark past every open segment
    source, starts = scratch_path(spark, "stream"), spark.createDataFrame([("m", 0), ("n", 3600), ("end", 10**6)], "match_id string, s long").select(
        "match_id", F.timestamp_seconds("s").alias("started"))
    for rows in (early, later, [("end", 1, 2, 0.0)], [("end", 1, 2, 50.0)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = (stream_segments(stream, starts).writeStream.format("memory").queryName("segs").outputMode("append")
             .option("checkpointLocation", scratch_path(spark, "cp")).trigger(availableNow=True).start())
    query.awaitTermination(180)
    got = sorted(map(tuple, spark.table("segs").filter("match_id <> 'end'").select(*COLUMNS).collect()))
    batch = segment_spans(gap_segments(spark.createDataFrame(early + later, SCHEMA), ["match_id", "team_a", "team_b"], "t", 10.0))
    assert got == sorted(map(tuple, batch.select(*COLUMNS).collect()))

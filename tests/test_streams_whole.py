from pyspark.sql import functions as F

from pagemill.plans import q_streaming
from pagemill.streaming import logs


def test_streams_over_files_out_of_time_order_match_batch(spark, tmp_path, monkeypatch):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for n in (2, 0, 1):  # latest days first, one file a batch
        part = events.filter(F.floor(F.dayofmonth("ts") / 11) == n)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    stream = logs.event_stream
    monkeypatch.setattr(logs, "event_stream", lambda s, pattern: stream(s, pattern, files=1))
    zoned = events.withColumn("ts", F.col("ts").cast("timestamp"))
    windows = zoned.groupBy(F.window("ts", "1 day"), "event_type").count().select(F.col("window.start").cast("timestamp_ntz"), "event_type", "count")
    got = q_streaming.stream_windows(spark, str(tmp_path)).select("start", "event_type", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, windows.collect()))
    assert got.agg(F.sum("n")).first()[0] == events.count()
    beats = zoned.select("ts", F.floor(F.col("event_id") / 6).alias("job"))
    spans = logs.silent_spans(beats, ts="ts", by="job", late=None)
    lost = q_streaming.stream_lost_jobs(spark, str(tmp_path))
    assert sorted(map(tuple, lost.collect())) == sorted(map(tuple, q_streaming._local(spans).collect()))
    assert lost.agg(F.sum("beats")).first()[0] == events.count()

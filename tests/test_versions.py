"""Versioned tables: shared files, replays, retention; the log that keeps its newest rows."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators import logs as batch
from pagemill.operators.merge import ring_retention, upsert_pages
from pagemill.sources import sinks
from pagemill.sources.versions import RingTable, VersionedTable
from pagemill.streaming import logs


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def merge(old, new):
    return upsert_pages(old, new, keys=["k"])


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def test_untouched_parts_are_the_same_files(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), keys=["k"], parts=16)
    table.write(frame(spark, [(i, "old") for i in range(200)]), "1")
    table.upsert(frame(spark, [(7, "new"), (900, "new")]), "2", merge)
    one, two = table.manifest("1")["folders"], table.manifest("2")["folders"]
    changed = {n for n in two if one.get(n) != two[n]}
    assert len(one) == 16 and 1 <= len(changed) <= 2
    assert rows_of(table.read("1")) == [(i, "old") for i in range(200)]
    assert rows_of(table.read()) == sorted([(i, "new" if i == 7 else "old") for i in range(200)] + [(900, "new")])


def test_upsert_that_was_cut_off_is_done_again(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), keys=["k"], parts=4)
    table.upsert(frame(spark, [(i, "a") for i in range(20)]), "0", merge)

    def torn(old, new):
        raise RuntimeError("cut")

    with pytest.raises(RuntimeError):
        table.upsert(frame(spark, [(1, "b")]), "1", torn)
    (tmp_path / "t" / "data" / "1").mkdir(parents=True)
    (tmp_path / "t" / "data" / "1" / "left.txt").write_text("half")
    assert table.versions() == ["0"]
    for _ in range(3):  # replays leave the same
        table.upsert(frame(spark, [(1, "b"), (50, "b")]), "1", merge)
        assert rows_of(table.read()) == sorted([(i, "b" if i == 1 else "a") for i in range(20)] + [(50, "b")])


def test_retention_deletes_what_no_version_needs(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), keys=["k"], parts=4)
    table.write(frame(spark, [(i, "0") for i in range(40)]), "0")
    for v in range(1, 6):
        table.upsert(frame(spark, [(v, str(v))]), str(v), merge)
    before = {v: rows_of(table.read(v)) for v in table.versions()}
    assert table.retain(2, always=("1",)) == ["1", "4", "5"] == table.versions()
    assert {v: rows_of(table.read(v)) for v in table.versions()} == {v: before[v] for v in ("1", "4", "5")}
    used = {f for v in table.versions() for f in table.manifest(v)["folders"].values()}
    left = {str(p.relative_to(tmp_path / "t")) for p in (tmp_path / "t" / "data").glob("*/_part=*")}
    assert left == used
    assert table.retain(1) == ["5"] and rows_of(table.read()) == before["5"]


def test_versions_by_number_and_empty_tables(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), keys=["k"], parts=3)
    table.write(frame(spark, []), "9")
    assert table.read().count() == 0
    table.upsert(frame(spark, [(None, "x"), (1, None)]), "10", merge)
    table.upsert(frame(spark, []), "11", merge)
    assert table.versions() == ["9", "10", "11"] and table.read().count() == 2


def test_saving_one_book_leaves_files_of_others(spark, tmp_path):
    master = lambda *slugs: spark.createDataFrame([(s, "t", "c") for s in slugs], "slug string, title string, category string")
    pages = lambda *slugs: spark.createDataFrame([(s, n, f"{s}{n}") for s in slugs for n in range(5)], "book_slug string, page_num int, ocr_text string")
    books = [f"b{i}" for i in range(30)]
    sinks.save_corpus(master(*books), pages(*books), str(tmp_path), version="1")
    sinks.save_corpus(master("b3"), pages("b3").withColumn("ocr_text", F.lit("again")), str(tmp_path), version="2", before="1")
    for name, table in sinks.corpus_tables(spark, str(tmp_path)).items():
        one, two = table.manifest("1")["folders"], table.manifest("2")["folders"]
        assert len([n for n in two if one.get(n) != two[n]]) == 1, name
    saved = sinks.corpus_tables(spark, str(tmp_path))["book_pages"].read("2")
    assert saved.count() == 150 and saved.filter("ocr_text = 'again'").count() == 5


def test_streamed_upsert_over_files_and_a_replayed_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for n in range(4):
        events.filter(F.col("event_id") % 4 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    shape = lambda df: df.select((F.col("user_id") % 7).alias("ip"), F.col("event_type").alias("host"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("platform"))
    options = {"keys": ["ip", "host"], "ts": "ts", "platform": "platform"}
    want = rows_of(batch.worker_rollup(shape(events), **options))
    table = logs.upsert_workers(shape(logs.event_stream(spark, str(tmp_path / "e"), files=1)), str(tmp_path / "s"), parts=4, **options)
    assert table.versions() == ["2", "3"]
    assert rows_of(table.read().drop("platform_at")) == want
    last = batch.worker_marks(shape(events.filter("event_id % 4 = 3")), **options)
    table.upsert(last, "3", lambda old, new: batch.merge_marks(old, new, keys=options["keys"]))  # the batch of the last file once more
    assert rows_of(table.read().drop("platform_at")) == want


def test_ring_keeps_the_newest_in_few_files(spark, tmp_path):
    ring = RingTable(spark, str(tmp_path / "r"), id="id", keep=50, most=3)
    seen = []
    for n in range(12):
        ids = list(range(n * 20, n * 20 + 20)) if n != 6 else []
        for _ in range(2 if n in (5, 9) else 1):  # replayed
            ring.append(spark.createDataFrame([(i, f"r{i}") for i in ids], "id long, v string"), n)
        seen += ids
        want = ring_retention(spark.createDataFrame([(i, f"r{i}") for i in seen], "id long, v string"), id="id", keep=50)
        assert rows_of(ring.read()) == rows_of(want)
        assert len(list((tmp_path / "r" / "data").glob("*/*.parquet"))) <= 2 * 4
    assert len(list((tmp_path / "r" / "manifests").glob("*.json"))) == 2


def test_ring_of_a_stream_and_of_jumping_ids(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for n in (2, 0, 3, 1):
        events.filter(F.floor(F.col("event_id") / 250) == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    ring = logs.keep_ring(logs.event_stream(spark, str(tmp_path / "e"), files=1).select("event_id", "ts"), str(tmp_path / "s"), id="event_id", keep=300)
    want = ring_retention(events.select("event_id"), id="event_id", keep=300)
    assert rows_of(ring.read().select("event_id")) == rows_of(want)
    other = RingTable(spark, str(tmp_path / "o"), id="id", keep=10)
    other.append(spark.createDataFrame([], "id long"), 0)
    assert other.read().count() == 0
    other.append(spark.createDataFrame([(None,), (5,), (1000,)], "id long"), 1)
    assert rows_of(other.read()) == [(1000,)]

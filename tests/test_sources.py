from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagemill.operators import chapters as ch
from pagemill.operators import logs as batch
from pagemill.operators import reshape
from pagemill.sources import readers, sinks
from pagemill.streaming import logs, ordered


def test_page_texts_and_batches(spark, tmp_path):
    for book, page, text in (("b1", 1, "one\ntwo"), ("b1", 12, ""), ("b2", 3, "x")):
        (tmp_path / "t" / book / "ocr_text").mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / book / "ocr_text" / f"page_{page:03d}.txt").write_text(text)
    got = readers.read_page_texts(spark, str(tmp_path / "t"))
    assert {(r.book, r.page, r.text) for r in got.collect()} >= {("b1", 1, "one\ntwo"), ("b2", 3, "x")}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "b1.json").write_text('[{"num": 3, "summary": "c"}, {"num": 1, "summary": "a"}]')
    (tmp_path / "j" / "b2.json").write_text('{"num": 3}')
    (tmp_path / "j" / "b3.json").write_text("broken")
    good, bad = readers.read_batches(spark, str(tmp_path / "j"))
    assert {(r.file, r.pos, r.num) for r in good.collect()} == {("b1.json", 0, 3), ("b1.json", 1, 1)}
    assert {r.file for r in bad.collect()} == {"b2.json", "b3.json"}
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "b1.json").write_text("[]")
    with pytest.raises(ValueError):
        readers.read_batches(spark, str(tmp_path / "e"))


def test_images_ledger_feed(spark, tmp_path):
    for name in ("a/source_raws/raw_1.png", "a/page_001.png", "b/page_001.png"):
        (tmp_path / "i" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "i" / name).write_bytes(b"x")
    assert {(r.book, r.file) for r in readers.read_image_files(spark, str(tmp_path / "i")).collect()} == {("a", "raw_1.png"), ("b", "page_001.png")}
    rows = spark.createDataFrame([("ocr", "m", 10, 2, "0.1234", None)], "stage string, model string, tokens_in long, tokens_out long, usd string, ts string")
    sinks.append_ledger(rows, str(tmp_path / "l"))
    sinks.append_ledger(rows, str(tmp_path / "l"))
    (tmp_path / "l" / "part-x.txt").write_text("too\tshort\n")
    ledger = readers.read_ledger(spark, str(tmp_path / "l"))
    assert ledger.count() == 2 and float(ledger.agg(F.sum("usd")).first()[0]) == 0.2468
    (tmp_path / "f.json").write_text('{"title": "T", "x": 1}\n{"title": "U"}\nbad\n')
    feed = readers.read_feed(spark, str(tmp_path / "f.json"), known=["title"])
    assert {(r.title, r.meta) for r in feed.collect() if r.title} == {("T", '{"x":"1"}'), ("U", None)}


def test_versions_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "book string, n int")
    sinks.write_version(df, str(tmp_path / "v"), "1")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_version(df, str(tmp_path / "v"), "1")
    sinks.overwrite_books(df, str(tmp_path / "p"))
    sinks.overwrite_books(spark.createDataFrame([("a", 9)], "book string, n int"), str(tmp_path / "p"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).select("book", "n").collect()} == {("a", 9), ("b", 2)}


def test_streamed_limiter_equals_batch_over_several_files(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=7 * i), i % 3, "error", 0.0, "{}") for i in range(300)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    build = lambda rows: ordered.limiter(rows.select("event_id", "user_id", "ts"), ip="user_id", ts="ts", order="event_id")
    got = ordered.drain_to_end(spark, str(tmp_path / "e"), str(tmp_path / "out"), build, files=1)
    want = batch.rate_limited(spark.createDataFrame(rows, schema).select("event_id", "user_id", "ts"), ip="user_id", ts="ts", order="event_id")
    assert {(r.event_id, r.blocked) for r in got.collect()} == {(r.event_id, r.blocked) for r in want.collect()}


def test_snapshot_names(spark):
    assert sinks.snapshot_name(spark, "20240101_000000", "요약 v1!/x_-½" + "y" * 40) == "20240101_000000_요약v1x_-½" + "y" * 19
    assert sinks.snapshot_name(spark, "20240101_000000", " !") == "20240101_000000"


def test_empty_feed_is_refused(spark, tmp_path):
    (tmp_path / "f.json").write_text("\n[]\n{}\n")
    with pytest.raises(ValueError, match="empty"):
        readers.read_feed(spark, str(tmp_path / "f.json"), known=["title"])


def test_files_are_worked_through_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(7):
        (tmp_path / "in" / f"page_{n}.txt").write_text(f"text {n}\nmore")
    work = lambda rows: rows.select(F.length("value").alias("n"), F.monotonically_increasing_id().alias("i"))
    first = logs.drain_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), work)
    assert first.count() == 7 and first.select("batch").distinct().count() == 2
    (tmp_path / "in" / "page_9.txt").write_text("late")
    again = logs.drain_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), work)
    assert again.count() == 8 and again.filter("batch = 2").count() == 1


def test_chapter_request_keeps_a_line_end_at_the_limit(spark):
    pages = spark.createDataFrame([("b", 1, "x" * 5993), ("b", 2, "y")], "book string, page long, text string")
    chapters = spark.createDataFrame([("b", 1, "t", 1, 2, None)], "book string, num int, title string, start long, end long, summary string")
    got = reshape.chapter_requests(chapters, ch.chapter_texts(pages, chapters, text="text"), title="book").first().request
    assert got.endswith("pages:\n[p.1] " + "x" * 5993 + "\n")


def test_files_are_written_by_name_and_replaced(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x.png", "1"), ("b/c", "x.png", "2"), (None, "y.png", None)], "book string, file string, value string")
    for _ in range(2):
        sinks.write_files(rows, f"file://{tmp_path}/f", named=["book", "file"], value="value")
    found = {str(p.relative_to(tmp_path / "f")): p.read_text() for p in (tmp_path / "f").rglob("*") if p.is_file()}
    assert found == {"a/x.png": "1\n", "b%2Fc/x.png": "2\n", "__HIVE_DEFAULT_PARTITION__/y.png": "\n"}


def test_image_contents_are_read_once(spark, tmp_path):
    for name in ("a/source_raws/raw_1.png", "a/page_001.png", "b/page_001.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    plan = readers.read_image_files(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_books_of_page_data_share_files(spark, tmp_path):
    rows = spark.createDataFrame([(b, p, "", "") for b in range(40) for p in (1, 2)], "book long, num long, sid string, title string")
    tree = ch.chapter_tree(ch.chapter_rows(rows, book="book", page="num", section="sid", title="title"))
    sinks.write_pages_data(tree, rows.select("book", "num", F.lit("s").alias("summary")), str(tmp_path / "d"))
    assert 0 < len(list((tmp_path / "d").rglob("*.json"))) < 40
    back = reshape.read_pages_data(spark.read.text(str(tmp_path / "d")), json="value")
    assert {(int(r.book), len(r.pages)) for r in back.select(F.get_json_object("value", "$.book").alias("book"), "pages").collect()} == {(b, 2) for b in range(40)}


def test_a_batch_is_one_file(spark, tmp_path):
    pages = spark.createDataFrame([("a", n, f"s{n}") for n in range(1, 8)] + [("b", 3, None)], "book string, num int, summary string")
    sinks.write_batches(pages, f"file://{tmp_path}/b", book="book", page="num")
    assert {str(p.relative_to(tmp_path / "b")) for p in (tmp_path / "b").rglob("*.json") if p.is_file()} == {"a/batch_001.json", "a/batch_006.json", "b/batch_003.json"}
    good, bad = readers.read_batches(spark, str(tmp_path / "b"))
    assert good.count() == 8 and bad.count() == 0

"""Contract queries on sources and sinks: rows of a table go out through a sink to a new folder on
shared storage and come back through a reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as fx
from pagemill.operators import chapters as ch
from pagemill.operators import costs, listing, merge, reshape
from pagemill.plans.contract import register
from pagemill.plans.q_chapters import _ENDS, _RANGE_SQL, _TEXT_SQL, _TREE_SQL, _ranges, chapter_rows, texts_of_chapters
from pagemill.sources import readers, sinks
from pagemill.sources.storage import shared_folder
from pagemill.sources.tables import table
from pagemill.sources.versions import VersionedTable
from pagemill.streaming import logs


def _files(df, folder, *named):
    """One text file a row of (named columns, value), in folders of those columns."""
    sinks.write_files(df, folder, named=list(named), value="value")


def _line(column):
    """A file's text without the line end that the sink sets."""
    return F.regexp_replace(column, r"\n$", "")


def _page_files(spark, d):
    items = table(spark, d, "benchmark")
    folder = shared_folder(spark, "page-texts")
    _files(items.select(F.concat(F.lit("b"), F.col("item_id") % 4).alias("book"), F.concat(fx.page_path(F.col("item_id")), F.lit(".txt")).alias("file"), F.coalesce("text", F.lit("")).alias("value")), folder, "book", "file")
    return folder


@register("page_texts", "SELECT 'b' || item_id % 4 AS book, CAST(item_id AS INTEGER) AS page, coalesce(text, '') AS text FROM benchmark")
def page_texts(spark, d):
    return readers.read_page_texts(spark, _page_files(spark, d)).withColumn("text", _line("text"))


@register("transcripts", "SELECT CAST(item_id AS INTEGER) AS page, length(coalesce(text, '')) AS n_chars, (SELECT ceil(count(*) / 5) FROM benchmark) AS batches FROM benchmark")
def transcripts(spark, d):
    page = F.regexp_extract("path", r"page_(\d+)\.txt", 1).cast("int")
    work = lambda rows: rows.select(page.alias("page"), fx.n_chars(_line("value")).alias("n_chars"))
    done = logs.drain_files(spark, _page_files(spark, d), shared_folder(spark, "transcripts"), work)
    return done.crossJoin(F.broadcast(done.agg(F.countDistinct("batch").cast("double").alias("batches")))).select("page", "n_chars", "batches")


@register(
    "summary_batches",
    """WITH n AS (SELECT s_nationkey % 4 AS book, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey % 4 ORDER BY s_suppkey) - 1 AS nth FROM supplier),
b AS (SELECT *, min(s_suppkey) OVER (PARTITION BY book, nth // 5) AS first FROM n)
SELECT 'batch_' || lpad(CAST(first AS VARCHAR), CAST(greatest(3, length(CAST(first AS VARCHAR))) AS INTEGER), '0') || '.json' AS file, CAST(nth % 5 AS INTEGER) AS pos, CAST(s_suppkey AS INTEGER) AS num, s_name AS summary FROM b""",
)
def summary_batches(spark, d):
    pages = table(spark, d, "supplier").select((F.col("s_nationkey") % 4).alias("book"), F.col("s_suppkey").cast("int").alias("num"), F.col("s_name").alias("summary"))
    folder = shared_folder(spark, "batches")
    sinks.write_batches(pages, folder, book="book", page="num")
    return readers.read_batches(spark, folder)[0].select("file", "pos", "num", "summary")


def _images(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.concat(F.lit("n"), "s_nationkey").alias("book"), "s_nationkey", "s_suppkey", F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("n"), F.col("s_name").alias("value"))


@register("image_files", "WITH f AS (SELECT 'n' || s_nationkey AS book, s_nationkey % 2 AS odd, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS n, s_name || chr(10) AS value FROM supplier) SELECT book, CASE WHEN odd = 0 THEN 'raw_' ELSE 'page_' END || n || '.png' AS file, strlen(value) AS bytes, md5(value) AS digest FROM f")
def image_files(spark, d):
    images, folder = _images(spark, d), shared_folder(spark, "images")
    _files(images.select("book", F.concat(F.lit("page_"), "n", F.lit(".png")).alias("file"), "value"), f"{folder}/pages", "book", "file")
    raw = images.filter("s_nationkey % 2 = 0").select("book", F.lit("source_raws").alias("kind"), F.concat(F.lit("raw_"), "n", F.lit(".png")).alias("file"), "value")
    _files(raw, f"{folder}/raws", "book", "kind", "file")
    return readers.read_image_files(spark, folder)


@register("page_image_files", "SELECT 'n' || s_nationkey AS book, CAST(s_suppkey AS INTEGER) AS page, 'page_' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || '.png' AS file, CASE WHEN s_nationkey % 3 = 0 THEN strlen(s_name) + 1 ELSE 6 END AS bytes FROM supplier")
def page_image_files(spark, d):
    images, folder = _images(spark, d), shared_folder(spark, "images")
    file = F.concat(F.lit("page_"), "n", F.lit(".png")).alias("file")
    _files(images.filter("s_nationkey % 3 = 0").select("book", file, "value"), f"{folder}/pages", "book", "file")
    _files(images.select("book", F.lit("thumbs").alias("kind"), file, F.lit("thumb").alias("value")), f"{folder}/thumbs", "book", "kind", "file")
    return readers.read_page_images(spark, folder)


@register("finished_books", "SELECT 'n' || n_nationkey AS book, CASE n_nationkey % 3 WHEN 0 THEN (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) ELSE 0 END AS pages, 'books/n' || n_nationkey || '/summary/index.html' AS url FROM (SELECT DISTINCT s_nationkey AS n_nationkey FROM supplier) WHERE n_nationkey % 4 <> 1")
def finished_books(spark, d):
    books = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("s_suppkey").alias("num"))).alias("pages"))).alias("json"))
    book, k, folder = F.concat(F.lit("n"), "s_nationkey").alias("book"), F.col("s_nationkey"), shared_folder(spark, "books")
    summary = F.lit("summary").alias("dir")
    _files(books.filter("s_nationkey % 4 <> 1").select(book, summary, F.lit("index.html").alias("file"), F.lit("<html>").alias("value")), folder, "book", "dir", "file")
    _files(books.filter("s_nationkey % 3 <> 2").select(book, summary, F.lit("pages_data.json").alias("file"), F.when(k % 3 == 0, F.col("json")).otherwise("broken").alias("value")), folder, "book", "dir", "file")
    return readers.read_finished(spark, folder)


@register("added_books", "SELECT 'Book ' || item_id % 4 AS name, 'Book_' || item_id % 4 AS slug, count(*) AS files FROM benchmark GROUP BY item_id % 4")
def added_books(spark, d):
    files = readers.read_page_texts(spark, _page_files(spark, d)).select(F.concat(F.lit("Book "), F.regexp_extract("book", r"(\d+)", 1)).alias("name"))
    return listing.added_books(files, name="name", slug=fx.slug(F.col("name")))


_LINES = "l AS (SELECT l_orderkey % 50 AS book, l_returnflag AS stage, l_linestatus AS model, CAST(l_quantity AS BIGINT) AS tokens_in, CAST(l_linenumber AS BIGINT) AS tokens_out, l_orderkey % 1000 / 8 AS usd FROM lineitem)"


def _lines(spark, d):
    n = F.col("l_orderkey")
    return table(spark, d, "lineitem").select((n % 50).alias("book"), F.col("l_returnflag").alias("stage"), F.col("l_linestatus").alias("model"), F.col("l_quantity").cast("bigint").alias("tokens_in"), F.col("l_linenumber").cast("bigint").alias("tokens_out"), (n % 1000 / 8).cast(costs.USD).alias("usd"), F.lit(None).cast("string").alias("ts"))


@register("ledger_lines", f"WITH {_LINES} SELECT stage, model, count(*) AS n, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(CAST(usd AS DECIMAL(18, 4))) AS DOUBLE) AS usd FROM l GROUP BY 1, 2")
def ledger_lines(spark, d):
    folder, lines = shared_folder(spark, "ledger"), _lines(spark, d)
    sinks.append_ledger(lines.filter("stage = 'A'"), folder)
    sinks.append_ledger(lines.filter("stage <> 'A'"), folder)
    back = readers.read_ledger(spark, folder)
    return back.groupBy("stage", "model").agg(F.count("*").alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("usd").cast("double").alias("usd"))


@register("ledger_restart", f"WITH {_LINES} SELECT CAST(book AS INTEGER) AS book, CASE WHEN book IN (SELECT book FROM l WHERE tokens_in = 50 AND stage = 'R') THEN count(*) FILTER (WHERE tokens_in = 50 AND stage = 'R') ELSE count(*) END AS n FROM l GROUP BY book")
def ledger_restart(spark, d):
    folder, lines = shared_folder(spark, "ledger"), _lines(spark, d)
    sinks.restart_ledger(lines, folder)
    sinks.restart_ledger(lines.filter("tokens_in = 50 and stage = 'R'"), folder)
    return spark.read.text(folder).groupBy("book").agg(F.count("*").alias("n"))


@register("chapter_files", f"WITH {_RANGE_SQL} SELECT book, num, CAST(start AS INTEGER) AS start, CAST(\"end\" AS INTEGER) AS \"end\" FROM r")
def chapter_files(spark, d):
    folder = shared_folder(spark, "chapters")
    sinks.write_chapters(_ranges(spark, d), folder)
    sinks.write_chapters(_ranges(spark, d).filter("num = 1"), folder, scaffold=True)
    back = readers.read_chapters(spark, f"{folder}/chapters.json")
    return back.select(F.regexp_extract("file", r"/book=([^/]+)/", 1).alias("book"), "num", "start", "end")


@register("pages_data_files", f"WITH {_TREE_SQL} SELECT book, CAST(page AS INTEGER) AS num, kind AS form FROM t, (SELECT unnest(['object', 'list']) AS kind)")
def pages_data_files(spark, d):
    rows, folder = chapter_rows(spark, d), shared_folder(spark, "pages-data")
    pages = rows.select("book", F.col("page").alias("num"), F.col("label").alias("summary"))
    sinks.write_pages_data(ch.chapter_tree(rows), pages, f"{folder}/object")
    pages.groupBy("book").agg(F.to_json(F.array_sort(F.collect_list(F.struct("num", "summary", "book")))).alias("value")).select("value").write.text(f"{folder}/list")
    flat = lambda form, book: reshape.read_pages_data(spark.read.text(f"{folder}/{form}"), json="value").select(F.get_json_object("value", book).cast("bigint").alias("book"), F.explode("pages").alias("p"), F.lit(form).alias("form")).select("book", "p.num", "form")
    return flat("object", "$.book").union(flat("list", "$[0].book"))


@register("request_files", f"SELECT doc_id, 'page ' || doc_id || chr(10) || coalesce(nullif(regexp_replace(text, '{_ENDS}', '', 'g'), ''), '(empty)') AS request FROM documents")
def request_files(spark, d):
    folder = shared_folder(spark, "requests")
    sinks.write_requests(reshape.page_requests(table(spark, d, "documents").withColumn("hint", F.lit(None).cast("string")), page="doc_id", text="text", hint="hint"), folder)
    return spark.read.schema("doc_id bigint, request string").json(folder)


@register("appended_rows", "SELECT event_type, count(*) AS n, count(*) AS n_ids FROM events GROUP BY 1")
def appended_rows(spark, d):
    folder, rows = shared_folder(spark, "log"), table(spark, d, "events").select("event_id", "event_type", "ts")
    sinks.append_rows(rows.filter("event_type = 'error'"), folder, key=["event_id"])
    sinks.append_rows(rows.filter("event_type <> 'error'"), folder, key=["event_id"])
    return spark.read.parquet(folder).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


@register("analysis_history", "SELECT o_custkey, o_orderkey, o_orderkey % 1000 / 8 AS cost_usd, CAST(sum(CAST(o_orderkey % 1000 / 8 AS DECIMAL(18, 4))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cost_usd_total FROM orders")
def analysis_history(spark, d):
    runs = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderkey") % 1000 / 8).alias("cost_usd"))
    folder = shared_folder(spark, "history")
    sinks.append_history(runs, folder, by="o_custkey", order=["o_orderdate", "o_orderkey"])
    return spark.read.parquet(folder).drop("o_orderdate")


@register(
    "corpus_versions",
    """WITH a AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1), p AS (SELECT source, doc_id, CASE WHEN q IS NULL THEN coalesce(text, '') ELSE 'again ' || q || coalesce(text, '') END AS t, q FROM documents LEFT JOIN a USING (doc_id)),
n AS (SELECT source, count(*) AS every, count(q) AS again FROM p GROUP BY 1) SELECT source AS book_slug, doc_id AS page_num, length(t) AS char_count, CASE WHEN again > 0 THEN again ELSE every END AS page_count, CASE WHEN again > 0 THEN 'second' ELSE 'first' END AS title, 'kept' AS category FROM p JOIN n USING (source)""",
)
def corpus_versions(spark, d):
    docs, folder = table(spark, d, "documents"), shared_folder(spark, "corpus")
    texts = docs.select(F.col("source").alias("book_slug"), F.col("doc_id").alias("page_num"), F.col("text").alias("ocr_text"))
    marks = table(spark, d, "labels").groupBy(F.col("doc_id").alias("page_num")).agg(F.max("quality").alias("q")).filter("q is not null")
    again = texts.join(marks, "page_num").withColumn("ocr_text", F.concat(F.lit("again "), F.col("q"), F.coalesce("ocr_text", F.lit("")))).select(texts.columns)
    books = lambda rows, title, category: rows.select(F.col("book_slug").alias("slug")).distinct().select("slug", F.lit(title).alias("title"), F.lit(category).cast("string").alias("category"))
    sinks.save_corpus(books(texts, "first", "kept"), texts, folder, version="1")
    sinks.save_corpus(books(again, "second", None), again, folder, version="2", before="1")
    saved = sinks.corpus_tables(spark, folder)
    master = saved["book_master"].read("2").withColumnRenamed("slug", "book_slug")
    return saved["book_pages"].read("2").join(master, "book_slug").select("book_slug", "page_num", "char_count", "page_count", "title", "category")


@register("version_folders", "SELECT v AS version, count(*) AS n, CAST(sum(CASE WHEN c_custkey % 6 = v THEN 1 ELSE 0 END) AS BIGINT) AS fresh FROM customer, (SELECT unnest([1, 3, 4, 5]) AS v) WHERE c_custkey % 6 <= v GROUP BY v")
def version_folders(spark, d):
    """Six versions of a table, of which retention leaves the newest three and one that is named."""
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    saved = VersionedTable(spark, shared_folder(spark, "versions"), keys=["c_custkey"], parts=8)
    for v in range(6):
        rows = customers.filter(F.col("c_custkey") % 6 == v).withColumn("since", F.lit(v))
        saved.upsert(rows, str(v), lambda old, new: merge.upsert_pages(old, new, keys=["c_custkey"]))
    left = saved.retain(3, always=("1",))
    counts = [saved.read(v).agg(F.lit(int(v)).alias("version"), F.count("*").alias("n"), F.count_if(F.col("since") == int(v)).alias("fresh")) for v in left]
    return merge.all_batches(counts)


@register("feed_rows", "SELECT c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS author, CASE WHEN c_custkey % 3 = 0 THEN '{\"extra\":\"' || c_nationkey || '\"}' WHEN c_custkey % 3 = 1 THEN 'given' END AS meta FROM customer")
def feed_rows(spark, d):
    k = F.col("c_custkey")
    item = F.struct(F.col("c_name").alias("title"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("author"), F.when(k % 3 == 0, F.col("c_nationkey")).alias("extra"), F.when(k % 3 < 2, "given").alias("meta_json"))
    folder = shared_folder(spark, "feed")
    table(spark, d, "customer").select(F.to_json(item).alias("value")).write.text(folder)
    return readers.read_feed(spark, folder, known=["title", "author"])


@register("chapter_requests", f"WITH {_TEXT_SQL} SELECT book, num, 'book: ' || book || chr(10) || 'chapter ' || num || ': part ' || num || ' (p.' || start || '-' || \"end\" || ')' || chr(10) || 'about: ' || chr(10) || 'pages:' || chr(10) || coalesce(text, '') AS request FROM r LEFT JOIN t USING (book, num)")
def chapter_requests(spark, d):
    ranges = _ranges(spark, d).withColumn("title", F.concat(F.lit("part "), "num")).withColumn("summary", F.lit(None).cast("string"))
    return reshape.chapter_requests(ranges.withColumn("name", F.col("book")), texts_of_chapters(spark, d), title="name")


@register("book_requests", f"WITH {_RANGE_SQL} SELECT book, 'book: ' || book || chr(10) || 'chapters:' || chr(10) || string_agg(num || '. part ' || num || ' (p.' || start || '-' || \"end\" || '): s', chr(10) ORDER BY start) AS request FROM r GROUP BY book")
def book_requests(spark, d):
    ranges = _ranges(spark, d).withColumn("title", F.concat(F.lit("part "), "num")).withColumn("summary", F.lit("s")).withColumn("name", F.col("book"))
    return reshape.book_requests(ranges, title="name")

"""Contract queries on ordered pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import ordered, pages
from pagemill.plans.contract import register
from pagemill.sources.tables import table

_DENSE = r"length(regexp_replace(coalesce(text, ''), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g'))"


def _pages(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text")


def _events(spark, d):
    return table(spark, d, "events")


@register(
    "divider_scaffold",
    f"""
WITH RECURSIVE p AS (SELECT source AS book, doc_id AS page, {_DENSE} < 40 AS divider FROM documents),
b AS (SELECT book, min(page) AS first, max(page) AS last FROM p GROUP BY book),
k AS (SELECT book, min(page) AS page FROM p WHERE divider GROUP BY book
      UNION ALL SELECT k.book, (SELECT min(page) FROM p WHERE divider AND p.book = k.book AND p.page > k.page + 2) FROM k WHERE k.page IS NOT NULL),
s AS (SELECT book, page AS start FROM k WHERE page IS NOT NULL UNION ALL SELECT book, first FROM b WHERE book NOT IN (SELECT book FROM p WHERE divider))
SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY start) AS INTEGER) AS num, start,
       coalesce(lead(start) OVER (PARTITION BY book ORDER BY start) - 1, last) AS "end" FROM s JOIN b USING (book)
""",
)
def divider_scaffold(spark, d):
    return pages.divider_scaffold(_pages(spark, d), book="book", page="page", text="text")


@register("divider_pages", f"SELECT source AS book, doc_id AS page FROM documents WHERE {_DENSE} < 40")
def divider_pages(spark, d):
    return _pages(spark, d).filter(pages.is_divider(F.col("text"))).select("book", "page")


@register("keep_first_page", "SELECT book, num, page FROM (SELECT source AS book, doc_id % 37 AS num, doc_id AS page, row_number() OVER (PARTITION BY source, doc_id % 37 ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def keep_first_page(spark, d):
    return ordered.keep_first(_pages(spark, d).select("book", (F.col("page") % 37).alias("num"), "page"), ["book", "num"], ["page"])


@register("chapter_ends", "SELECT o_custkey AS book, o_orderkey AS start, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, (SELECT max(o_orderkey) FROM orders)) AS \"end\" FROM orders")
def chapter_ends(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("start"))
    last = orders.agg(F.max("start").alias("last"))
    return ordered.range_ends(orders.crossJoin(F.broadcast(last)), ["book"], "start", F.col("last")).drop("last")


@register("drop_false_chapters", "SELECT user_id, event_id, num FROM (SELECT user_id, event_id, num, coalesce(max(num) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM (SELECT user_id, event_id, event_id % 11 AS num FROM events)) WHERE num = 0 OR num > m")
def drop_false_chapters(spark, d):
    seen = _events(spark, d).select("user_id", "event_id", (F.col("event_id") % 11).alias("num"))
    return ordered.drop_regressions(seen, ["user_id"], ["event_id"], "num")


@register("renumber_chapters", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS num FROM orders")
def renumber_chapters(spark, d):
    return ordered.renumber(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@register("number_or_position", "SELECT o_custkey, o_orderkey, coalesce(nullif(o_orderkey % 3, 0), row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS num FROM orders")
def number_or_position(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 3).alias("num"))
    return ordered.number_or_position(rows, ["o_custkey"], ["o_orderkey"], "num")


@register("take_until_repeat", "SELECT user_id, event_id, event_type FROM (SELECT *, sum(same) OVER (PARTITION BY user_id ORDER BY event_id) AS stop FROM (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS same FROM events)) WHERE stop = 0")
def take_until_repeat(spark, d):
    return ordered.take_until_repeat(_events(spark, d).select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


_RUNS = """r0 AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r1 AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r0),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1 AS nth FROM r1)"""


@register("take_until_second_repeat", f"WITH {_RUNS} SELECT user_id, event_id, event_type FROM (SELECT *, sum(CASE WHEN nth >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS stop FROM r) WHERE stop = 0 AND nth = 0")
def take_until_second_repeat(spark, d):
    return ordered.take_until_kth_repeat(_events(spark, d).select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


@register("stable_runs", f"WITH {_RUNS} SELECT user_id, any_value(event_type) AS event_type, min(event_id) AS start, count(*) AS length FROM r GROUP BY user_id, run HAVING count(*) >= 3")
def stable_runs(spark, d):
    return ordered.stable_runs(_events(spark, d).select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


@register(
    "trim_duplicate_tail",
    f"""WITH {_RUNS}, t AS (SELECT user_id, count(*) AS n, list(event_id ORDER BY event_id) AS l FROM r WHERE run = (SELECT max(run) FROM r x WHERE x.user_id = r.user_id) GROUP BY user_id)
SELECT user_id, n AS tail_run, CASE WHEN n >= 2 THEN n - 1 ELSE 0 END AS trimmed, CASE WHEN n >= 2 THEN l[1] ELSE l[-1] END AS last_kept, CASE WHEN n >= 2 THEN array_to_string(l[2:], ',') ELSE '' END AS rows FROM t""",
)
def trim_duplicate_tail(spark, d):
    cut = ordered.trim_tail(_events(spark, d).select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")
    return cut.withColumn("rows", F.array_join("rows", ","))


@register("page_links", "SELECT source AS book, doc_id AS page, lag(doc_id) OVER w AS prev, lead(doc_id) OVER w AS next FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def page_links(spark, d):
    return ordered.neighbours(_pages(spark, d).select("book", "page"), ["book"], "page")


@register("cumulative_cost", "SELECT o_custkey, o_orderkey, CAST(round(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE), 2) AS DOUBLE) AS spent FROM orders")
def cumulative_cost(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("cost"))
    summed = ordered.running_sum(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "cost", "spent")
    return summed.select("o_custkey", "o_orderkey", F.round(F.col("spent").cast("double"), 2).alias("spent"))


@register(
    "flag_runs",
    "SELECT user_id, min(k) AS start, max(k) AS \"end\" FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY k) AS run FROM (SELECT user_id, event_id AS k, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) <= 41 THEN 0 ELSE 1 END AS new FROM events WHERE value > 20)) GROUP BY user_id, run",
)
def flag_runs(spark, d):
    return ordered.flag_runs(_events(spark, d), ["user_id"], "event_id", F.col("value") > 20, 40)


@register("first_last_pages", "SELECT source AS book, doc_id AS page FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 6 OR row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 2")
def first_last_pages(spark, d):
    return ordered.first_and_last(_pages(spark, d).select("book", "page"), ["book"], ["page"], 6, 2)


_CRAWL = "c AS (SELECT o_custkey AS feed, o_orderkey // 25 AS page, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1 AS is_new FROM orders), n AS (SELECT feed, page, count(*) FILTER (WHERE is_new) AS added FROM c GROUP BY 1, 2)"


def _crawl(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("feed"), F.floor(F.col("o_orderkey") / 25).alias("page"), "o_orderpriority")
    return ordered.crawl_new(rows, F.struct("feed", "o_orderpriority"), ["o_orderkey"]).groupBy("feed", "page").agg(F.count_if("is_new").alias("added"))


@register("crawl_added", f"WITH {_CRAWL} SELECT * FROM n")
def crawl_added(spark, d):
    return _crawl(spark, d)


@register(
    "crawl_stop",
    f"""WITH {_CRAWL}, e AS (SELECT *, CASE WHEN added = 0 AND lag(added, 1) OVER w = 0 AND lag(added, 2) OVER w = 0 AND lag(added, 3) OVER w = 0 THEN 1 ELSE 0 END AS hit FROM n WINDOW w AS (PARTITION BY feed ORDER BY page))
SELECT feed, page, added FROM (SELECT *, sum(hit) OVER (PARTITION BY feed ORDER BY page) AS stop FROM e) WHERE stop = 0""",
)
def crawl_stop(spark, d):
    return ordered.crawl_stop(_crawl(spark, d), ["feed"], "page", "added")


@register("stop_after_error", "SELECT user_id, event_id, event_type FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM events) WHERE f = 0")
def stop_after_error(spark, d):
    return ordered.take_until_error(_events(spark, d).select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type") == "error")

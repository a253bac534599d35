"""Contract queries on costs, counts, jobs, workers and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions.text import json_setting
from pagemill.operators import chapters, costs, filters, listing, logs, merge, ordered, pages
from pagemill.plans.contract import register
from pagemill.sources.tables import table


def _prices(spark, d):
    n = table(spark, d, "nation")
    return n.filter("n_nationkey < 1").select(F.lit("F").alias("name"), F.lit(1.0).alias("price_in"), F.lit(5.0).alias("price_out"))


def _ledger(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("stage"), F.col("l_linestatus").alias("model"), (F.col("l_quantity") * 100).cast("bigint").alias("tokens_in"), F.floor("l_extendedprice").alias("tokens_out"))
    return costs.ledger(li, _prices(spark, d), model="model", tokens_in="tokens_in", tokens_out="tokens_out")


_LEDGER_SQL = """l AS (SELECT l_orderkey, l_linenumber, l_returnflag AS stage, l_linestatus AS model, CAST(l_quantity * 100 AS BIGINT) AS tokens_in, CAST(floor(l_extendedprice) AS BIGINT) AS tokens_out FROM lineitem),
c AS (SELECT *, CAST(round((tokens_in * CASE WHEN model = 'F' THEN 1 ELSE 3 END + tokens_out * CASE WHEN model = 'F' THEN 5 ELSE 15 END) / 100) / 10000 AS DECIMAL(18, 4)) AS usd FROM l)"""


@register("cost_report", f"WITH {_LEDGER_SQL}, s AS (SELECT stage, arg_min(model, (l_orderkey, l_linenumber)) AS model, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, sum(usd) AS usd FROM c GROUP BY stage) SELECT stage, model, tokens_in, tokens_out, CAST(usd AS DOUBLE) AS usd, CAST(sum(usd) OVER () AS DOUBLE) AS total_usd, round(CAST(sum(usd) OVER () AS DOUBLE) / (SELECT count(*) FROM documents), 5) AS per_page_usd FROM s")
def cost_report(spark, d):
    return costs.cost_report(_ledger(spark, d), stage="stage", model="model", order=["l_orderkey", "l_linenumber"], pages=table(spark, d, "documents"))


@register("run_totals", f"WITH {_LEDGER_SQL} SELECT count(*) FILTER (WHERE stage = 'A') AS done, count(*) FILTER (WHERE stage = 'R') AS errors, count(*) FILTER (WHERE stage = 'N') AS skipped, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(usd) AS DOUBLE) AS usd FROM c")
def run_totals(spark, d):
    status = F.when(F.col("stage") == "A", "done").when(F.col("stage") == "R", "error").otherwise("skipped")
    return costs.run_totals(_ledger(spark, d).withColumn("status", status), status="status")


@register("corpus_stats", "SELECT count(DISTINCT source) AS books, count(*) AS pages, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars FROM documents")
def corpus_stats(spark, d):
    return pages.corpus_stats(table(spark, d, "documents"), book="source", chars="n_chars")


_QUALITY = """WITH i AS (SELECT source AS book, doc_id AS seq, md5(text) AS digest, CASE WHEN doc_id % 97 = 0 THEN '1920x1080' WHEN lang = 'de' THEN '1500x2100' ELSE '1400x2000' END AS dim, n_chars * 400 // 1024 AS kb FROM documents),
g AS (SELECT book, CAST(sum(n) AS BIGINT) AS n_images, count(*) AS n_distinct, count(*) FILTER (WHERE n > 1) AS dup_groups, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS dup_images FROM (SELECT book, digest, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY book),
m AS (SELECT book, count(*) AS n_dims, arg_max(dim, (n, -first)) AS main_dim, max(n) AS n_main, list(dim || ': ' || n ORDER BY first) AS dims FROM (SELECT book, dim, count(*) AS n, min(seq) AS first FROM i GROUP BY 1, 2) GROUP BY book),
s AS (SELECT book, count(*) FILTER (WHERE dim = '1920x1080') AS n_screen, count(*) FILTER (WHERE kb < 80) AS n_blank, array_to_string((list(seq || ' ' || dim ORDER BY seq) FILTER (WHERE dim = '1920x1080'))[1:3], ', ') AS fs, array_to_string((list(seq || ' ' || kb || 'KB' ORDER BY seq) FILTER (WHERE kb < 80))[1:3], ', ') AS fb FROM i GROUP BY book),
o AS (SELECT *, n_images - n_main AS n_off, n_images - n_main > greatest(3, n_images * 0.05) AS many_off FROM g JOIN m USING (book) JOIN s USING (book)),
q AS (SELECT *, list_filter([CASE WHEN n_screen > 0 THEN 'screen size: ' || n_screen || ' images, first ' || fs END, CASE WHEN n_blank > 0 THEN 'blank: ' || n_blank || ' images below 80KB, first ' || fb END, CASE WHEN dup_groups > 0 THEN 'duplicates: ' || dup_images || ' images in ' || dup_groups || ' groups' END, CASE WHEN many_off THEN 'off size: ' || n_off || ' images off ' || main_dim END], lambda x: x IS NOT NULL) AS flags FROM o)"""


@register("quality_report", f"{_QUALITY} SELECT book, n_images, n_distinct, dup_groups, dup_images, n_dims, dims, main_dim, n_off, many_off, n_screen, n_blank, flags, len(flags) = 0 AS ok FROM q")
def quality_report(spark, d):
    key = F.col("doc_id")
    dim = F.when(key % 97 == 0, "1920x1080").when(F.col("lang") == "de", "1500x2100").otherwise("1400x2000")
    images = table(spark, d, "documents").select(F.col("source").alias("book"), key.alias("seq"), F.md5("text").alias("digest"), dim.alias("dim"), (F.col("n_chars") * 400).alias("bytes"))
    return pages.quality_report(images, book="book", seq="seq", digest="digest", dim="dim", n_bytes="bytes")


@register("quality_text", f"{_QUALITY} SELECT book, 'book ' || book || ': ' || n_images || ' images, ' || n_distinct || ' distinct, main dimension ' || main_dim || chr(10) || 'dimensions: ' || array_to_string(dims, ', ') || chr(10) || CASE WHEN len(flags) = 0 THEN 'ok: no screen sizes, blanks, duplicates or other sizes' ELSE array_to_string(flags, chr(10)) END AS report FROM q")
def quality_text(spark, d):
    return pages.report_text(quality_report(spark, d), book="book")


@register("duplicate_pages", "SELECT source AS book, md5(text) AS digest, count(*) AS n_pages, min(doc_id) AS first_page FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_pages(spark, d):
    return pages.duplicate_groups(table(spark, d, "documents"), book="source", page="doc_id", text="text")


_MARKS = "SELECT doc_id, CASE WHEN contains(text, 'zzz') THEN 'zzz' WHEN contains(text, ' the ') THEN ' the ' WHEN contains(text, 'token') THEN 'token' WHEN regexp_matches(text, '[0-9]{3}-[0-9]{3}') THEN '[0-9]{3}-[0-9]{3}' WHEN regexp_matches(text, '%%%') THEN '%%%' END AS evidence FROM documents"


@register("contamination_evidence", f"SELECT doc_id, evidence, evidence IS NOT NULL AS contaminated FROM ({_MARKS})")
def contamination_evidence(spark, d):
    n = table(spark, d, "nation").filter("n_nationkey < 5")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), F.col("n_nationkey") + 1)
    patterns = n.select(pick(2, 0, 1, 3, 4).alias("prio"), pick("literal", "literal", "literal", "regex", "regex").alias("kind"), pick("token", "zzz", " the ", "[0-9]{3}-[0-9]{3}", "%%%").alias("pattern"))
    return pages.contamination(table(spark, d, "documents"), patterns, keys=["doc_id"], text="text").select("doc_id", "evidence", "contaminated")


@register("clean_pages", f"SELECT count(*) FILTER (WHERE evidence IS NULL) AS clean, count(*) FILTER (WHERE evidence IS NOT NULL) AS skipped FROM ({_MARKS})")
def clean_pages(spark, d):
    return pages.clean_counts(contamination_evidence(spark, d))


@register("resolution_gate", "SELECT p_partkey, list_filter([CASE WHEN w >= h THEN 'landscape' END, CASE WHEN w < 1400 THEN 'low resolution' END], lambda x: x IS NOT NULL) AS warnings, w < h AND w >= 1400 AS ok, (w, h) IN ((1500, 1450), (1200, 1700)) AS suspect FROM (SELECT p_partkey, p_size * 50 AS w, CASE WHEN p_partkey % 2 = 0 THEN 1450 ELSE 1700 END AS h FROM part)")
def resolution_gate(spark, d):
    sized = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 50).alias("w"), F.when(F.col("p_partkey") % 2 == 0, 1450).otherwise(1700).alias("h"))
    suspects = table(spark, d, "nation").filter("n_nationkey < 2").select(F.when(F.col("n_nationkey") == 0, 1500).otherwise(1200).alias("w"), F.when(F.col("n_nationkey") == 0, 1450).otherwise(1700).alias("h"))
    warned = pages.suspect_sizes(sized, suspects, width="w", height="h").withColumn("warnings", pages.resolution_warnings(F.col("w"), F.col("h")))
    return warned.select("p_partkey", "warnings", (F.size("warnings") == 0).alias("ok"), "suspect")


@register("blank_suspects", "SELECT doc_id FROM documents WHERE floor(n_chars * 40 / 1024) < 80")
def blank_suspects(spark, d):
    return table(spark, d, "documents").filter(pages.is_blank_image(F.col("n_chars") * 40)).select("doc_id")


@register("page_ranges", "SELECT doc_id FROM documents WHERE doc_id BETWEEN 24 AND 333 OR doc_id IN (5, 7, 9)")
def page_ranges(spark, d):
    page = F.col("doc_id")
    return table(spark, d, "documents").filter(filters.in_page_range(page, 24, 333) | filters.in_page_list(page, "5,7-9")).select("doc_id")


@register("titles_kept", "SELECT p_partkey, title FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE p_name || ' ' || p_type || ' ' || repeat('i', p_size) END AS title FROM part) WHERE trim(title) <> '' AND length(title) <= 40")
def titles_kept(spark, d):
    title = F.when(F.col("p_partkey") % 9 == 0, " ").otherwise(F.concat_ws(" ", "p_name", "p_type", F.expr("repeat('i', p_size)")))
    return table(spark, d, "part").select("p_partkey", title.alias("title")).filter(chapters.good_title(F.col("title")))


@register("end_phrases", "SELECT doc_id FROM documents WHERE contains(regexp_replace(text, '\\s', '', 'g'), 'License,Version') OR contains(regexp_replace(text, '\\s', '', 'g'), 'token=')")
def end_phrases(spark, d):
    dense = pages.dense_text(F.col("text"))
    return table(spark, d, "documents").filter(dense.contains("License,Version") | dense.contains("token=")).select("doc_id")


@register("status_filter", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW' ORDER BY coalesce(CAST(o_orderdate AS VARCHAR), '') DESC, o_orderkey DESC LIMIT 200")
def status_filter(spark, d):
    wanted = {"o_orderstatus": "P", "o_orderpriority": "5-LOW", "o_custkey": None}
    return filters.newest(filters.matching(table(spark, d, "orders"), wanted), date="o_orderdate", id="o_orderkey", limit=200).select("o_orderkey", "o_orderdate")


@register("oldest_pending", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def oldest_pending(spark, d):
    waiting = F.expr("o_orderstatus = 'P' and o_orderpriority <> '1-URGENT'")
    return filters.oldest(table(spark, d, "orders"), waiting=waiting, date="o_orderdate", id="o_orderkey").select("o_orderkey")


@register("catalogue_order", "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_nationkey DESC, lower(c_name), c_custkey) AS place FROM customer")
def catalogue_order(spark, d):
    view = filters.columns_of(table(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "no_such_column"])
    return ordered.place_overall(view, [F.desc("c_nationkey"), F.lower("c_name"), "c_custkey"]).select("c_custkey", "c_name", "place")


@register("log_tail", "SELECT event_id, rpad(event_type, 10, ' ') || ' ' || user_id AS line FROM events ORDER BY event_id DESC LIMIT 500")
def log_tail(spark, d):
    return filters.log_tail(table(spark, d, "events"), id="event_id", limit=9_999, most=500).select("event_id", filters.log_line(F.col("event_type"), F.col("user_id")).alias("line"))


@register("web_view_split", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS yes, count(*) FILTER (WHERE o_orderstatus <> 'F') AS no FROM orders")
def web_view_split(spark, d):
    return filters.split_counts(table(spark, d, "orders"), F.col("o_orderstatus") == "F")


_PINGS = "p AS (SELECT user_id % 40 AS ip, event_type AS host, ts, CASE WHEN event_id % 3 = 0 THEN 'os' || (event_id % 5) END AS platform FROM events), w AS (SELECT ip, host, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS ping_count, arg_max(platform, ts) FILTER (WHERE platform IS NOT NULL) AS platform FROM p GROUP BY 1, 2)"


def _workers(spark, d):
    pings = table(spark, d, "events").select((F.col("user_id") % 40).alias("ip"), F.col("event_type").alias("host"), "ts", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("os"), F.col("event_id") % 5)).alias("platform"))
    return logs.worker_rollup(pings, keys=["ip", "host"], ts="ts", platform="platform")


@register("worker_rollup", f"WITH {_PINGS} SELECT * FROM w")
def worker_rollup(spark, d):
    return _workers(spark, d)


@register("workers_alive", f"WITH {_PINGS}, a AS (SELECT *, round(date_diff('microsecond', last_seen, (SELECT max(ts) FROM events)) / 1e6, 1) AS age FROM w) SELECT ip, host, age, age < 36000 AS alive FROM a")
def workers_alive(spark, d):
    latest = table(spark, d, "events").agg(F.max("ts").alias("as_of"))
    return logs.alive_workers(_workers(spark, d).crossJoin(F.broadcast(latest)), as_of=F.col("as_of"), within=36_000).select("ip", "host", "age", "alive")


@register("recent_workers", f"WITH {_PINGS} SELECT ip, host, last_seen FROM w ORDER BY last_seen DESC LIMIT 20")
def recent_workers(spark, d):
    return filters.recently_seen(_workers(spark, d), seen="last_seen").select("ip", "host", "last_seen")


@register("worker_of_requester", f"WITH {_PINGS} SELECT c_custkey, host FROM customer LEFT JOIN (SELECT ip, arg_max(host, last_seen) AS host FROM w GROUP BY ip) ON ip = c_nationkey * 2")
def worker_of_requester(spark, d):
    newest = ordered.keep_newest(_workers(spark, d), ["ip"], ["last_seen"])
    return table(spark, d, "customer").join(newest, F.col("ip") == F.col("c_nationkey") * 2, "left").select("c_custkey", "host")


@register("worker_versions", "SELECT event_id, regexp_extract(props, '(\\d+)', 1) = (SELECT max(regexp_extract(props, '(\\d+)', 1)) FROM events) AS current FROM events")
def worker_versions(spark, d):
    v = table(spark, d, "events").select("event_id", F.regexp_extract("props", r"(\d+)", 1).alias("version"))
    return merge.current_versions(v, version="version").select("event_id", "current")


_JOBS = "j AS (SELECT event_id // 6 AS job, ts, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'heartbeat' WHEN 'error' THEN 'cancel' ELSE CASE WHEN event_id % 2 = 0 THEN 'finish' ELSE 'fail' END END AS kind FROM events), f AS (SELECT job, max(ts) FILTER (WHERE kind = 'claim') AS cl, max(ts) FILTER (WHERE kind = 'cancel') AS ca, max(ts) FILTER (WHERE kind IN ('finish', 'fail')) AS en, arg_max(kind, ts) FILTER (WHERE kind IN ('finish', 'fail')) AS how, max(ts) AS last_seen FROM j GROUP BY job), s AS (SELECT job, last_seen, CASE WHEN en IS NOT NULL AND cl IS NOT NULL THEN CASE WHEN ca < en THEN 'cancelled' WHEN how = 'finish' THEN 'done' ELSE 'failed' END WHEN ca IS NOT NULL AND cl IS NOT NULL AND cl < ca THEN 'cancelling' WHEN ca IS NOT NULL THEN 'cancelled' WHEN cl IS NOT NULL THEN 'running' ELSE 'pending' END AS status FROM f)"


def job_kind():
    return F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "click", "heartbeat").when(F.col("event_type") == "error", "cancel").when(F.col("event_id") % 2 == 0, "finish").otherwise("fail")


def _jobs(spark, d):
    rows = table(spark, d, "events").select(F.floor(F.col("event_id") / 6).alias("job"), "ts", "event_id", job_kind().alias("kind"))
    return logs.latest_jobs(rows, job="job", ts=["ts", "event_id"], kind="kind")


@register("job_states", f"WITH {_JOBS} SELECT job, status, last_seen FROM s")
def job_states(spark, d):
    return _jobs(spark, d)


@register("reaped_jobs", f"WITH {_JOBS} SELECT job, 'failed' AS status, CASE WHEN job % 2 = 0 THEN 'out of memory' ELSE 'heartbeat lost' END AS error FROM s WHERE status IN ('running', 'cancelling') AND last_seen < (SELECT max(ts) FROM events) - INTERVAL 600 SECONDS")
def reaped_jobs(spark, d):
    latest = table(spark, d, "events").agg(F.max("ts").alias("as_of"))
    jobs = _jobs(spark, d).crossJoin(F.broadcast(latest)).withColumn("error", F.when(F.col("job") % 2 == 0, "out of memory").otherwise(""))
    return logs.reap_lost(jobs, status="status", heartbeat="last_seen", error="error", as_of=F.col("as_of")).select("job", "status", "error")


@register("failures_in_window", "SELECT event_id, recent, recent >= 8 AS blocked FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 599999999999 PRECEDING AND 1 PRECEDING) AS recent FROM events WHERE event_type = 'error')")
def failures_in_window(spark, d):
    tries = table(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id", "ts")
    return logs.failures_in_window(tries, ip="user_id", ts="ts", window=600_000).select("event_id", "recent", "blocked")


_LIMITED = """WITH RECURSIVE t AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
r AS (SELECT event_id, user_id, ts, n, false AS blocked, [us] AS kept FROM t WHERE n = 1
 UNION ALL SELECT event_id, user_id, ts, n, len(k) >= 8, CASE WHEN len(k) >= 8 THEN k ELSE list_append(k, us) END FROM (SELECT t.*, list_filter(r.kept, lambda x: t.us - x < 600000000000) AS k FROM r JOIN t ON t.user_id = r.user_id AND t.n = r.n + 1))
SELECT event_id, user_id, ts, blocked FROM r"""


@register("rate_limited", _LIMITED)
def rate_limited(spark, d):
    tries = table(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id", "ts")
    return logs.rate_limited(tries, ip="user_id", ts="ts", order="event_id", window=600_000)


_THROTTLED = """WITH RECURSIVE t AS (SELECT user_id, event_id, ts, event_type, epoch_us(ts) AS us, event_type IN ('signup', 'purchase') AS sure, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, ts, event_type, n, us AS last, true AS sent FROM t WHERE n = 1
 UNION ALL SELECT t.user_id, t.event_id, t.ts, t.event_type, t.n, CASE WHEN t.sure OR t.us - r.last >= 86400000000 THEN t.us ELSE r.last END, t.sure OR t.us - r.last >= 86400000000 FROM r JOIN t ON t.user_id = r.user_id AND t.n = r.n + 1)
SELECT user_id, event_id, ts, event_type FROM r WHERE sent"""


@register("throttled_progress", _THROTTLED)
def throttled_progress(spark, d):
    lines = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return logs.throttled(lines, by="user_id", ts="ts", order="event_id", always=F.col("event_type").isin("signup", "purchase"), gap=86_400.0)


@register("login_status", "SELECT user_id, arg_max(event_type, event_id) AS status, round(date_diff('microsecond', max(ts), (SELECT max(ts) FROM events)) / 1e6, 1) AS age FROM events GROUP BY user_id")
def login_status(spark, d):
    latest = table(spark, d, "events").agg(F.max("ts").alias("as_of"))
    return logs.login_status(table(spark, d, "events").crossJoin(F.broadcast(latest)), user="user_id", status="event_type", order="event_id", ts="ts", as_of=F.col("as_of"))


@register("valid_sessions", "SELECT event_id, ts + CASE WHEN event_type = 'view' THEN INTERVAL 600 SECONDS ELSE INTERVAL 28800 SECONDS END >= (SELECT max(ts) FROM events) AS valid FROM events")
def valid_sessions(spark, d):
    latest = table(spark, d, "events").agg(F.max("ts").alias("as_of"))
    life = F.when(F.col("event_type") == "view", 600).otherwise(28_800)
    return logs.expired(table(spark, d, "events").crossJoin(F.broadcast(latest)), ts="ts", lifetime=life, as_of=F.col("as_of")).select("event_id", "valid")


@register("running_heartbeats", f"WITH {_JOBS} SELECT event_id FROM events JOIN s ON job = event_id // 6 WHERE event_type = 'click' AND status = 'running'")
def running_heartbeats(spark, d):
    beats = table(spark, d, "events").filter("event_type = 'click'").select("event_id", F.floor(F.col("event_id") / 6).alias("job"))
    return logs.beats_of_running(beats, _jobs(spark, d), job="job").select("event_id")


@register("table_sizes", "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents")
def table_sizes(spark, d):
    return logs.table_sizes({name: table(spark, d, name) for name in ("events", "orders", "documents")})


@register("merge_report", "SELECT source AS book, count(*) AS pages, min(doc_id) AS first, max(doc_id) AS last, count(DISTINCT lang) AS chapters, 'batch_' || lpad(CAST(min(doc_id) AS VARCHAR), 3, '0') AS label FROM documents GROUP BY source")
def merge_report(spark, d):
    return listing.merge_report(table(spark, d, "documents"), book="source", page="doc_id", chapter="lang")


@register("colliding_pages", "SELECT source, doc_id % 40 AS num FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def colliding_pages(spark, d):
    return listing.colliding(table(spark, d, "documents").select("source", (F.col("doc_id") % 40).alias("num")), by=["source", "num"])


@register("page_numbers_seen", "SELECT p_brand, max(p_partkey % 1000) AS last, count(DISTINCT p_partkey % 1000) AS n FROM part WHERE p_partkey % 7 <> 0 GROUP BY p_brand")
def page_numbers_seen(spark, d):
    key = F.col("p_partkey")
    name = F.when(key % 7 == 0, "cover.png").otherwise(F.concat(F.lit("raw_"), F.lpad((key % 1000).cast("string"), 4, "0"), F.lit(".png")))
    return listing.numbers_seen(table(spark, d, "part").select("p_brand", name.alias("name")), by="p_brand", name="name")


@register("settings_json", "SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS BIGINT), -1) AS k FROM events")
def settings_json(spark, d):
    raw = F.when(F.col("event_id") % 4 == 0, "{broken").otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", json_setting(raw, "k", "bigint", -1).alias("k"))


_RULE_JSON = "CASE doc_id % 3 WHEN 0 THEN '{\"MIN_PAGE_KB\": 40, \"OTHER\": 1}' WHEN 1 THEN 'broken' ELSE '{\"DIVIDER_MAX_OCR_CHARS\": 700}' END"


@register("ruled_pages", f"SELECT doc_id, floor(n_chars * 40 / 1024) < CASE WHEN doc_id % 3 = 0 THEN 40 ELSE 80 END AS blank, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) < CASE WHEN doc_id % 3 = 2 THEN 700 ELSE 40 END AS divider FROM documents")
def ruled_pages(spark, d):
    k = F.col("doc_id")
    json = F.when(k % 3 == 0, '{"MIN_PAGE_KB": 40, "OTHER": 1}').when(k % 3 == 1, "broken").otherwise('{"DIVIDER_MAX_OCR_CHARS": 700}')
    ruled = table(spark, d, "documents").withColumn("rules", pages.quality_rules(json))
    return ruled.select(k, pages.is_blank_image(F.col("n_chars") * 40, F.col("rules.MIN_PAGE_KB")).alias("blank"), pages.is_divider(F.col("text"), F.col("rules.DIVIDER_MAX_OCR_CHARS")).alias("divider"))


@register(
    "patched_jobs",
    f"WITH {_JOBS}, p AS (SELECT job, CASE WHEN job % 2 = 0 THEN 'done' WHEN job % 3 = 0 THEN 'running' END AS st, CASE WHEN job % 5 = 0 THEN TIMESTAMP '2024-01-01' END AS fin FROM s WHERE status <> 'pending'), m AS (SELECT max(ts) AS latest FROM events) SELECT s.job, coalesce(p.st, s.status) AS status, coalesce(p.fin, CASE WHEN p.st = 'done' THEN latest END) AS finished_at, s.last_seen FROM s LEFT JOIN p ON p.job = s.job, m",
)
def patched_jobs(spark, d):
    jobs = _jobs(spark, d).withColumn("finished_at", F.lit(None).cast("timestamp_ntz"))
    k = F.col("job")
    patches = jobs.filter("status <> 'pending'").select("job", F.when(k % 2 == 0, "done").when(k % 3 == 0, "running").alias("status"), F.when(k % 5 == 0, F.lit("2024-01-01").cast("timestamp_ntz")).alias("finished_at"), F.lit("ignored").alias("last_seen"))
    latest = table(spark, d, "events").agg(F.max("ts").alias("as_of"))
    return filters.patched(jobs.crossJoin(F.broadcast(latest)), patches, key="job", as_of=F.col("as_of")).select("job", "status", "finished_at", "last_seen")

"""Contract queries on scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as fx
from pagemill.functions import web
from pagemill.operators import pages
from pagemill.plans.contract import register
from pagemill.sources.tables import table


@register("normal_title", "SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]+', '', 'g')) AS title FROM documents")
def normal_title(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.normal_title(F.col("text")).alias("title"))


@register("slugs", "SELECT p_partkey, regexp_replace(trim(regexp_replace('[' || p_brand || '] ' || p_name, '^\\s*\\[[^\\]]*\\]\\s*', '')), '\\s+', '_', 'g') AS slug, replace(regexp_replace(p_name, '\\s+', '_', 'g'), '_', ' ') AS title FROM part")
def slugs(spark, d):
    part = table(spark, d, "part")
    tagged = F.concat(F.lit("["), F.col("p_brand"), F.lit("] "), F.col("p_name"))
    return part.select("p_partkey", fx.slug(tagged).alias("slug"), fx.slug_title(F.regexp_replace("p_name", r"\s+", "_")).alias("title"))


@register(
    "chapter_ids",
    """WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || '장' WHEN 1 THEN '제' || p_size || '장' WHEN 2 THEN 'Part ' || p_size WHEN 3 THEN '' ELSE p_size || '.1' END AS sid,
CASE p_partkey % 3 WHEN 0 THEN p_size || '장 ' || p_name WHEN 1 THEN 'Part ' || p_size || ' ' || p_name ELSE p_name END AS title FROM part)
SELECT p_partkey, CASE WHEN starts_with(sid, 'Part') AND regexp_matches(sid, 'Part\\s*\\d+') THEN 'chs-part-' || regexp_extract(sid, 'Part\\s*(\\d+)', 1)
WHEN ends_with(sid, '장') AND regexp_matches(sid, '^\\d+') THEN 'chs-chapter-' || regexp_extract(sid, '^(\\d+)', 1)
WHEN regexp_matches(title, '^\\d+장') THEN 'chs-chapter-' || regexp_extract(title, '^(\\d+)장', 1)
WHEN regexp_matches(title, '^Part\\s*\\d+') THEN 'chs-part-' || regexp_extract(title, '^Part\\s*(\\d+)', 1) ELSE '' END AS id FROM s""",
)
def chapter_ids(spark, d):
    n, name = F.col("p_size").cast("string"), F.col("p_name")
    key = F.col("p_partkey")
    sid = F.when(key % 5 == 0, F.concat(n, F.lit("장"))).when(key % 5 == 1, F.concat(F.lit("제"), n, F.lit("장"))).when(key % 5 == 2, F.concat(F.lit("Part "), n)).when(key % 5 == 3, "").otherwise(F.concat(n, F.lit(".1")))
    title = F.when(key % 3 == 0, F.concat(n, F.lit("장 "), name)).when(key % 3 == 1, F.concat(F.lit("Part "), n, F.lit(" "), name)).otherwise(name)
    return table(spark, d, "part").select("p_partkey", fx.chapter_id(sid, title).alias("id"))


@register(
    "file_numbers",
    """WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name || '.png' WHEN p_partkey % 4 = 1 THEN 'page_000.jpg' ELSE 'page_' || lpad(CAST(p_partkey AS VARCHAR), 4, '0') || '.png' END AS name FROM part)
SELECT p_partkey, coalesce(nullif(TRY_CAST(regexp_extract(name, '_(\\d{3,5})\\.(?:png|jpg|jpeg)$', 1) AS BIGINT), 0), p_partkey + 1) AS page FROM f""",
)
def file_numbers(spark, d):
    key = F.col("p_partkey")
    name = F.when(key % 4 == 0, F.concat("p_name", F.lit(".png"))).when(key % 4 == 1, "page_000.jpg").otherwise(F.concat(F.lit("page_"), F.lpad(key.cast("string"), 4, "0"), F.lit(".png")))
    return table(spark, d, "part").select("p_partkey", fx.page_number(name, key + 1).alias("page"))


@register("reading_positions", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_partkey % 500 END AS page FROM part")
def reading_positions(spark, d):
    key = F.col("p_partkey")
    page = F.concat((key % 500).cast("string"), F.lit("/508p"))
    shown = F.when(key % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("%("), page, F.lit(")"))).when(key % 3 == 1, page).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", fx.reading_position(shown).alias("page"))


@register(
    "progress_lines",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS cur, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE CAST(50 AS BIGINT) END AS total, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE round((2 + CAST(l_quantity AS BIGINT) / 50) / 7 * 100, 1) END AS percent FROM lineitem",
)
def progress_lines(spark, d):
    done, n = F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit("/50")), F.col("l_linenumber") % 4
    line = F.when(n == 0, F.concat(F.lit("[ocr]  "), done, F.lit(" done"))).when(n == 1, F.concat(F.lit("[summarize] "), done)).when(n == 2, F.concat(F.lit("["), done, F.lit("] 캡처"))).otherwise("nothing")
    read = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fx.progress(line).alias("p"))
    return read.select("l_orderkey", "l_linenumber", "p.cur", "p.total", fx.percent_done(F.lit(3), F.lit(7), F.col("p.cur"), F.col("p.total")).alias("percent"))


@register("masked_names", "SELECT c_custkey, CASE WHEN length(s) > 12 THEN left(s, 7) || '...' || right(s, 4) ELSE '***' END AS masked, regexp_replace(left('요약 ' || c_name || ' v½!' || c_mktsegment, 30), '[^\\p{L}\\p{N}_-]', '', 'g') AS tag FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS s FROM customer)")
def masked_names(spark, d):
    value = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", fx.masked_secret(value).alias("masked"), fx.safe_tag(F.concat(F.lit("요약 "), "c_name", F.lit(" v½!"), "c_mktsegment")).alias("tag"))


@register(
    "page_markup",
    "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, trim(regexp_replace(html, '<[^>]+>', ' ', 'g'), ' ') AS plain, trim(regexp_replace(html, '\\s+', ' ', 'g'), ' ') AS squeezed FROM pages",
)
def page_markup(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", fx.html_escaped(html).alias("escaped"), fx.without_tags(html).alias("plain"), fx.squeezed(html).alias("squeezed"))


@register(
    "link_ids",
    "SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]id=([^&#]+)', 1), ''), nullif(regexp_extract(url, '[?&]page=([^&#]+)', 1), ''), nullif(regexp_extract(url, '/([A-Za-z0-9_-]+)/?(?:[?#].*)?$', 1), '')) AS id, nullif(regexp_extract(url, '/en/([^/?#]+)', 1), '') AS after FROM pages",
)
def link_ids(spark, d):
    return table(spark, d, "pages").select("page_id", fx.link_id(F.col("url"), ("id", "page")).alias("id"), fx.path_after(F.col("url"), "en").alias("after"))


@register(
    "text_numbers",
    "SELECT doc_id, length(coalesce(text, '')) AS n_chars, left(text, 300) AS head, 'page_' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(3, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS path, CASE WHEN len(regexp_extract_all(text, '\\p{L}')) > 0 THEN len(regexp_extract_all(text, '[à-ÿ]')) / len(regexp_extract_all(text, '\\p{L}')) ELSE 0 END AS accents FROM documents",
)
def text_numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.n_chars(F.col("text")).alias("n_chars"), fx.cut_text(F.col("text"), 300).alias("head"), fx.page_path(F.col("doc_id")).alias("path"), fx.script_ratio(F.col("text"), "à-ÿ").alias("accents"))


@register("number_texts", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 101 ELSE 0 END AS shown, CASE WHEN c_custkey % 3 = 1 THEN c_custkey % 101 END AS strict FROM customer")
def number_texts(spark, d):
    n = (F.col("c_custkey") % 101).cast("string")
    shown = F.when(F.col("c_custkey") % 3 == 0, F.concat(n, F.lit("%"))).otherwise(F.col("c_name"))
    strict = F.when(F.col("c_custkey") % 3 == 1, n).otherwise(F.concat(n, F.lit("%")))
    return table(spark, d, "customer").select("c_custkey", fx.leading_int(shown).alias("shown"), fx.int_or_null(strict).alias("strict"))


@register("code_labels", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)python|py|s') THEN 'Python' ELSE 'C#' END AS lang FROM (SELECT p_partkey, CASE WHEN contains(p_name, 's') THEN 'PyS' ELSE 'net' END AS p_name FROM part)")
def code_labels(spark, d):
    label = F.when(F.col("p_name").contains("s"), "my PYthon").otherwise("net")
    return table(spark, d, "part").select("p_partkey", fx.code_language(label).alias("lang"))


@register("event_ages", "SELECT event_id, round(date_diff('microsecond', ts, (SELECT max(ts) FROM events)) / 1e6, 1) AS age FROM events")
def event_ages(spark, d):
    events = table(spark, d, "events")
    latest = events.agg(F.max("ts").alias("as_of"))
    return events.crossJoin(F.broadcast(latest)).select("event_id", fx.seconds_ago(F.col("ts"), F.col("as_of")).alias("age"))


_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64) Chrome/120.0 Safari/537.36 Edg/120.0",
    "Mozilla/5.0 (Windows NT 6.1) Firefox/115.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) Version/17.0 Safari/605.1",
    "Mozilla/5.0 (Macintosh) Chrome/119.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17) Mobile Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14) Chrome/121.0 Mobile Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64) Chromium/118.0 Chrome/118.0",
    "Opera/9.80",
]
_IPS = ["10.1.2.3", "172.16.9.9", "172.32.0.1", "192.168.0.7", "8.8.8.8", "127.0.0.1", "169.254.1.1", "fe80::1", "300.1.1.1", "2001:db8::1"]


def _agent(key):
    return F.element_at(F.array(*map(F.lit, _AGENTS)), (key % len(_AGENTS) + 1).cast("int"))


def _ip(key):
    return F.element_at(F.array(*map(F.lit, _IPS)), (key % len(_IPS) + 1).cast("int"))


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_UA_SQL = f"""SELECT *, {_sql_list(_AGENTS)}[event_id % {len(_AGENTS)} + 1] AS ua, {_sql_list(_IPS)}[event_id % {len(_IPS)} + 1] AS ip FROM events"""


@register(
    "client_info",
    f"""WITH u AS ({_UA_SQL}) SELECT event_id,
CASE WHEN contains(ua, 'Windows NT 10') THEN 'Windows 10/11' WHEN contains(ua, 'Windows NT') THEN 'Windows' WHEN contains(ua, 'Mac OS X') OR contains(ua, 'Macintosh') THEN 'macOS ' || replace(regexp_extract(ua, 'Mac OS X (\\d+[_.]\\d+)', 1), '_', '.')
WHEN contains(ua, 'iPhone') THEN 'iOS/iPadOS' WHEN contains(ua, 'Android') THEN 'Android' WHEN contains(ua, 'Linux') THEN 'Linux' ELSE 'unknown' END AS os,
CASE WHEN contains(ua, 'Edg/') THEN 'Edge' WHEN contains(ua, 'OPR/') OR contains(ua, 'Opera') THEN 'Opera' WHEN contains(ua, 'Chrome/') AND NOT contains(ua, 'Chromium') THEN 'Chrome' WHEN contains(ua, 'Firefox/') THEN 'Firefox' WHEN contains(ua, 'Safari/') AND NOT contains(ua, 'Chrome') THEN 'Safari' ELSE 'unknown' END AS browser,
CASE WHEN regexp_matches(ua, 'iPhone|iPad|Android|Mobile') THEN 'mobile' ELSE 'desktop' END AS device,
CASE WHEN event_id % 3 = 0 THEN ip WHEN event_id % 3 = 1 THEN '10.0.0.9' ELSE '172.17.0.1' END AS real_ip, 'ko-KR' AS lang,
ip IN ('10.1.2.3', '172.16.9.9', '192.168.0.7', '127.0.0.1', '169.254.1.1', 'fe80::1') AS lan FROM u""",
)
def client_info(spark, d):
    key = F.col("event_id")
    ua, ip = _agent(key), _ip(key)
    forwarded = F.when(key % 3 == 0, F.concat(ip, F.lit(", 10.9.9.9"))).otherwise("")
    real = F.when(key % 3 == 1, "10.0.0.9")
    return table(spark, d, "events").select(
        "event_id", web.operating_system(ua).alias("os"), web.browser(ua).alias("browser"), web.device(ua).alias("device"), web.real_ip(forwarded, real, F.lit("172.17.0.1")).alias("real_ip"), web.first_language(F.lit("ko-KR,ko;q=0.9")).alias("lang"), web.is_local(ip).alias("lan")
    )


@register("error_messages", "SELECT event_id, coalesce(nullif(CASE WHEN event_type = 'error' THEN props ELSE '' END, ''), 'heartbeat lost') AS error FROM events")
def error_messages(spark, d):
    given = F.when(F.col("event_type") == "error", F.col("props")).otherwise("")
    return table(spark, d, "events").select("event_id", fx.message_or(given, "heartbeat lost").alias("error"))


@register(
    "code_pages",
    "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'import numpy' || chr(10) || 'def run(x): print(x)' WHEN doc_id % 7 = 1 THEN text || ' using  OpenCvSharp;' ELSE text END AS t FROM documents) SELECT doc_id, CAST(len(regexp_extract_all(t, 'Cv2\\.|using\\s+OpenCvSharp|Console\\.|new\\s+Mat|videoWriter\\.|namespace\\s|ColorConversion')) + len(regexp_extract_all(t, 'cv2\\.|import\\s+cv2|import\\s+numpy|np\\.|def\\s+\\w+\\(|print\\(|plt\\.')) AS INTEGER) AS score FROM t WHERE score >= 2",
)
def code_pages(spark, d):
    key = F.col("doc_id")
    extra = F.when(key % 7 == 0, "\nimport numpy\ndef run(x): print(x)").when(key % 7 == 1, " using  OpenCvSharp;").otherwise("")
    made = table(spark, d, "documents").select("doc_id", F.concat("text", extra).alias("t"))
    return made.select("doc_id", pages.code_score(F.col("t")).alias("score")).filter("score >= 2")


@register(
    "progress_records",
    """SELECT l_orderkey, l_linenumber, json_object('stage', l_linenumber % 4 + 1, 'stage_total', 4, 'stage_name', 'ocr', 'current', CAST(l_quantity AS BIGINT), 'total', CASE WHEN l_linenumber % 4 = 3 THEN 0 ELSE 50 END,
'pct', round((l_linenumber % 4 + CASE WHEN l_linenumber % 4 = 3 THEN 0 ELSE CAST(l_quantity AS BIGINT) / 50 END) / 4 * 100, 1), 'msg', left(repeat(l_returnflag || ' page ', 40), 200)) AS record FROM lineitem""",
)
def progress_records(spark, d):
    n, cur = F.col("l_linenumber") % 4, F.col("l_quantity").cast("bigint")
    record = fx.progress_record(n + 1, F.lit(4), F.lit("ocr"), cur, F.when(n == 3, 0).otherwise(50), F.repeat(F.concat("l_returnflag", F.lit(" page ")), F.lit(40)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", record.alias("record"))


@register(
    "client_records",
    f"""WITH u AS ({_UA_SQL}) SELECT event_id, json_object('ip', CASE WHEN event_id % 3 = 0 THEN ip ELSE '172.17.0.1' END, 'peer_ip', '172.17.0.1', 'x_forwarded_for', CASE WHEN event_id % 3 = 0 THEN ip || ', 10.9.9.9' ELSE '' END,
'os', CASE WHEN contains(ua, 'Windows NT 10') THEN 'Windows 10/11' WHEN contains(ua, 'Windows NT') THEN 'Windows' WHEN contains(ua, 'Mac OS X') OR contains(ua, 'Macintosh') THEN 'macOS ' || replace(regexp_extract(ua, 'Mac OS X (\\d+[_.]\\d+)', 1), '_', '.') WHEN contains(ua, 'iPhone') THEN 'iOS/iPadOS' WHEN contains(ua, 'Android') THEN 'Android' WHEN contains(ua, 'Linux') THEN 'Linux' ELSE 'unknown' END,
'browser', CASE WHEN contains(ua, 'Edg/') THEN 'Edge' WHEN contains(ua, 'Opera') THEN 'Opera' WHEN contains(ua, 'Chrome/') AND NOT contains(ua, 'Chromium') THEN 'Chrome' WHEN contains(ua, 'Firefox/') THEN 'Firefox' WHEN contains(ua, 'Safari/') AND NOT contains(ua, 'Chrome') THEN 'Safari' ELSE 'unknown' END, 'lang', 'ko-KR', 'mac', NULL, 'user_agent', left(ua || repeat(' more', 60), 300)) AS record FROM u""",
)
def client_records(spark, d):
    key = F.col("event_id")
    forwarded = F.when(key % 3 == 0, F.concat(_ip(key), F.lit(", 10.9.9.9"))).otherwise("")
    agent = F.concat(_agent(key), F.lit(" more" * 60))
    return table(spark, d, "events").select(key, web.client_record(forwarded=forwarded, real=F.lit(None).cast("string"), peer=F.lit("172.17.0.1"), agent=agent, language=F.lit("ko-KR,ko;q=0.9")).alias("record"))

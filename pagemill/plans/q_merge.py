"""Contract queries on merges, overlays, set operations and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as fx
from pagemill.operators import filters, listing, merge, ordered
from pagemill.plans.contract import register
from pagemill.sources.tables import table


def _catalogue(spark, d):
    c = table(spark, d, "customer")
    odd = F.col("c_custkey") % 2 == 1
    return c.select(F.col("c_custkey").alias("id"), F.when(~odd, F.concat(F.lit("K"), F.col("c_custkey"))).alias("kid"), F.when(odd, F.concat(F.lit("S"), F.col("c_custkey"))).alias("sid"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"), (F.col("c_custkey") % 90).alias("progress"))


def _feed(spark, d):
    o = table(spark, d, "orders")
    k, n = F.col("o_custkey"), F.col("o_orderkey")
    return o.select(
        n.alias("seq"), F.when(k % 2 == 0, F.concat(F.lit("K"), k)).alias("kid"), F.when((k % 2 == 1) & (k % 4 == 1), F.concat(F.lit("S"), k)).alias("sid"), F.concat(F.lit("Customer#"), F.lpad((k + F.when(n % 5 == 0, 100000).otherwise(0)).cast("string"), 9, "0")).alias("title"), F.col("o_orderpriority").alias("author"), F.when(n % 4 == 0, n % 100).alias("progress")
    )


_FEED_SQL = """cat AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'K' || c_custkey END AS kid, CASE WHEN c_custkey % 2 = 1 THEN 'S' || c_custkey END AS sid, c_name AS title, c_mktsegment AS author, c_custkey % 90 AS progress FROM customer),
feed AS (SELECT o_orderkey AS seq, CASE WHEN o_custkey % 2 = 0 THEN 'K' || o_custkey END AS kid, CASE WHEN o_custkey % 4 = 1 THEN 'S' || o_custkey END AS sid,
 'Customer#' || lpad(CAST(o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 100000 ELSE 0 END AS VARCHAR), 9, '0') AS title, o_orderpriority AS author, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 100 END AS progress FROM orders),
m AS (SELECT f.*, coalesce((SELECT min(id) FROM cat WHERE cat.kid = f.kid), (SELECT min(id) FROM cat WHERE cat.sid = f.sid), (SELECT min(id) FROM cat WHERE cat.title = f.title AND cat.author = f.author)) AS matched FROM feed f),
t AS (SELECT *, coalesce('id' || matched, 'k' || kid, 's' || sid, 't' || title || chr(1) || author) AS target FROM m),
b AS (SELECT target, any_value(matched) AS matched, count(*) AS n, min(seq) AS first, arg_max(CASE WHEN kid IS NULL THEN '' ELSE kid END, seq) AS kid, arg_max(sid, seq) AS sid, arg_max(title, seq) AS title, arg_max(author, seq) AS author, arg_max(progress, seq) FILTER (WHERE progress IS NOT NULL) AS progress FROM t GROUP BY target)"""


@register(
    "catalogue_upsert",
    f"""WITH {_FEED_SQL} SELECT id, cat.kid, coalesce(b.sid, cat.sid) AS sid, coalesce(b.title, cat.title) AS title, coalesce(b.author, cat.author) AS author, coalesce(b.progress, cat.progress) AS progress FROM cat LEFT JOIN b ON id = matched
UNION ALL SELECT (SELECT max(id) FROM cat) + first + 1, nullif(kid, ''), sid, title, author, progress FROM b WHERE matched IS NULL""",
)
def catalogue_upsert(spark, d):
    return merge.upsert_catalogue(_catalogue(spark, d), _feed(spark, d), id="id", keys=[["kid"], ["sid"], ["title", "author"]], order="seq", keep_old=["sid", "progress"], never=["kid"], blank=["author"])[0]


@register("upsert_counts", f"WITH {_FEED_SQL} SELECT count(*) FILTER (WHERE matched IS NULL) AS inserted, CAST(sum(n) - count(*) FILTER (WHERE matched IS NULL) AS BIGINT) AS updated FROM b")
def upsert_counts(spark, d):
    return merge.upsert_catalogue(_catalogue(spark, d), _feed(spark, d), id="id", keys=[["kid"], ["sid"], ["title", "author"]], order="seq", keep_old=["sid", "progress"], never=["kid"], blank=["author"])[1]


@register(
    "clean_feed",
    "SELECT c_custkey, trim(n) AS title, TRY_CAST(p AS INTEGER) AS progress, coalesce(f, false) AS web, coalesce(nullif(trim(s), ''), 'available') AS status, coalesce(k, c) AS kid FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '  ' ELSE ' ' || c_name || ' ' END AS n, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 50) || '%' ELSE CAST(c_custkey % 50 AS VARCHAR) END AS p, CASE WHEN c_custkey % 3 = 0 THEN true END AS f, CASE WHEN c_custkey % 5 = 0 THEN 'lent' ELSE '' END AS s, CASE WHEN c_custkey % 2 = 0 THEN 'K' || c_custkey END AS k, 'S' || c_custkey AS c FROM customer) WHERE trim(n) <> ''",
)
def clean_feed(spark, d):
    k = F.col("c_custkey")
    raw = table(spark, d, "customer").select(
        k, F.when(k % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" "))).alias("title"), F.concat((k % 50).cast("string"), F.when(k % 4 == 0, "%").otherwise("")).alias("progress"), F.when(k % 3 == 0, True).alias("web"), F.when(k % 5 == 0, "lent").otherwise("").alias("status"), F.when(k % 2 == 0, F.concat(F.lit("K"), k)).alias("kid"), F.concat(F.lit("S"), k).alias("sid")
    )
    clean = merge.clean_feed(raw, texts=["title", "kid", "sid"], ints=["progress"], flags=["web"], title="title", status="status", default_status="available")
    return clean.withColumn("kid", filters.first_given(F.col("kid"), F.col("sid"))).drop("sid")


@register("book_master", "SELECT coalesce(n.s_suppkey, o.s_suppkey) AS s_suppkey, CASE WHEN n.s_suppkey IS NOT NULL THEN n.s_name ELSE o.s_name END AS s_name, coalesce(n.s_nationkey, o.s_nationkey) AS s_nationkey FROM (SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_acctbal > 0) o FULL JOIN (SELECT s_suppkey, upper(s_name) AS s_name, CASE WHEN s_nationkey > 12 THEN s_nationkey END AS s_nationkey FROM supplier WHERE s_acctbal < 5000) n ON n.s_suppkey = o.s_suppkey")
def book_master(spark, d):
    s, columns = table(spark, d, "supplier"), ["s_suppkey", "s_name", "s_nationkey"]
    new = s.filter("s_acctbal < 5000").select("s_suppkey", F.upper("s_name").alias("s_name"), F.when(F.col("s_nationkey") > 12, F.col("s_nationkey")).alias("s_nationkey"))
    return merge.merge_master(s.filter("s_acctbal > 0").select(columns), new, key="s_suppkey", keep_old=["s_nationkey"])


@register("page_upsert", "SELECT source, doc_id, CASE WHEN q IS NOT NULL THEN 'reviewed ' || q || ': ' || text ELSE text END AS text FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id)")
def page_upsert(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).filter("q is not null")
    new = docs.join(marks, "doc_id").select("source", "doc_id", F.concat(F.lit("reviewed "), F.col("q"), F.lit(": "), F.col("text")).alias("text"))
    return merge.upsert_pages(docs, new, keys=["source", "doc_id"])


@register("pages_to_do", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 500))")
def pages_to_do(spark, d):
    docs = table(spark, d, "documents")
    return merge.to_do(docs.select("doc_id"), table(spark, d, "labels"), docs.filter("n_chars > 500"), key="doc_id")


@register("done_and_wanted", "SELECT count(*) AS n FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 500)")
def done_and_wanted(spark, d):
    return merge.count_in_both(table(spark, d, "labels"), table(spark, d, "documents").filter("n_chars > 500"), key="doc_id")


@register("resume_summaries", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 1000) THEN 'redone' ELSE 'kept ' || quality END AS summary FROM labels UNION ALL SELECT doc_id, 'redone' FROM documents WHERE n_chars > 1000 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_summaries(spark, d):
    old = table(spark, d, "labels").select("doc_id", F.concat(F.lit("kept "), F.col("quality")).alias("summary"))
    new = table(spark, d, "documents").filter("n_chars > 1000").select("doc_id", F.lit("redone").alias("summary"))
    return merge.upsert_pages(old, new, keys=["doc_id"])


@register("extras_without_page", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 1000)")
def extras_without_page(spark, d):
    cards = table(spark, d, "documents").filter("n_chars > 1000")
    return merge.without_page(table(spark, d, "labels").select("doc_id", "quality"), cards, key="doc_id")


@register("digest_reuse", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'digest ' || quality END), ''), 'new') AS body FROM labels")
def digest_reuse(spark, d):
    chapters = table(spark, d, "labels").select("doc_id")
    old = table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("digest "), F.col("quality"))).alias("body"))
    return merge.reused(chapters, old, key="doc_id", body="body", fresh="new")


@register("settings_overlay", "SELECT coalesce(a.n_nationkey, b.c_nationkey) AS nation, CASE WHEN coalesce(a.n_nationkey, b.c_nationkey) % 2 = 0 THEN coalesce(nullif(v, ''), n_name) ELSE coalesce(v, n_name) END AS value FROM nation a FULL JOIN (SELECT c_nationkey, min(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END) AS v FROM customer WHERE c_nationkey < 20 GROUP BY 1) b ON n_nationkey = c_nationkey")
def settings_overlay(spark, d):
    defaults = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("value"))
    value = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment"))
    saved = table(spark, d, "customer").filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nation")).agg(F.min(value).alias("value"))
    return merge.overlay(defaults, saved, keys=["nation"], value="value", secret=F.col("nation") % 2 == 0)


@register("catalogue_enrich", "SELECT o_orderkey, c_custkey FROM orders LEFT JOIN (SELECT c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY 1) ON c_mktsegment = CASE o_orderkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'none' END")
def catalogue_enrich(spark, d):
    n = F.col("o_orderkey")
    books = table(spark, d, "orders").select(n, F.when(n % 3 == 0, "BUILDING").when(n % 3 == 1, "MACHINERY").otherwise("none").alias("title"))
    return merge.first_match(books, table(spark, d, "customer"), on="title", key="c_mktsegment", order=["c_custkey"]).select("o_orderkey", "c_custkey")


@register(
    "external_ids",
    "WITH s AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'E00000' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') WHEN 1 THEN 'K' || c_custkey WHEN 2 THEN replace(c_name, '#', '_') ELSE 'none' || c_custkey END AS slug FROM customer) SELECT slug, CASE WHEN starts_with(slug, 'E') AND length(slug) > 10 THEN slug WHEN c_custkey % 4 IN (1, 2) THEN 'K' || c_custkey END AS external_id FROM s",
)
def external_ids(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    named = F.when(k % 4 == 0, F.concat(F.lit("E00000"), F.lpad(k.cast("string"), 6, "0"))).when(k % 4 == 1, F.concat(F.lit("K"), k)).when(k % 4 == 2, F.translate("c_name", "#", "_")).otherwise(F.concat(F.lit("none"), k))
    books = c.select(F.concat(F.lit("K"), k).alias("kid"), F.translate("c_name", "#", " ").alias("title"))
    return merge.external_ids(c.select(named.alias("slug")), books, slug="slug", id="kid", title_slug=fx.slug(F.col("title")))


@register("containing_titles", "WITH x AS (SELECT DISTINCT a, lower(regexp_replace(a, '[^A-Za-z0-9]', '', 'g')) AS na FROM (SELECT p_name AS a FROM part UNION SELECT ' - ')), y AS (SELECT DISTINCT b, lower(regexp_replace(b, '[^A-Za-z0-9]', '', 'g')) AS nb FROM (SELECT upper(split_part(p_name, ' ', 1)) AS b FROM part UNION SELECT p_name || ': ' || p_type FROM part UNION SELECT '!')) SELECT a, b FROM x JOIN y ON nb <> '' AND (contains(na, nb) OR contains(nb, na))")
def containing_titles(spark, d):
    part = table(spark, d, "part")
    one = table(spark, d, "region").agg(F.count("*").alias("n"))
    other = part.select(F.upper(F.split("p_name", " ")[0]).alias("b")).union(part.select(F.concat_ws(": ", "p_name", "p_type"))).union(one.select(F.lit("!")))
    return merge.containing_titles(part.select(F.col("p_name").alias("a")).union(one.select(F.lit(" - "))), other, a="a", b="b")


@register("log_ring", "SELECT event_id FROM events WHERE event_id >= (SELECT max(event_id) FROM events) - 5000")
def log_ring(spark, d):
    return merge.ring_retention(table(spark, d, "events").select("event_id"), id="event_id")


@register("snapshot_retention", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 30")
def snapshot_retention(spark, d):
    return merge.newest_snapshots(table(spark, d, "orders"), by=["o_custkey"], order=[F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@register("delete_orders", "SELECT count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) AS stayed, count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) AS removed FROM orders")
def delete_orders(spark, d):
    gone = table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    stayed, removed = merge.delete_key(table(spark, d, "orders"), gone, key="o_custkey")
    return stayed.agg(F.count("*").alias("stayed")).crossJoin(removed)


@register("setting_lookup", "SELECT CAST(c AS BIGINT) AS c_custkey, coalesce(c_name, 'unknown') AS c_name FROM (SELECT 7 AS c) LEFT JOIN customer ON c_custkey = c UNION ALL SELECT -1, 'unknown'")
def setting_lookup(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    found = [merge.point_lookup(c, key="c_custkey", value=v, defaults={"c_name": "unknown"}) for v in (7, -1)]
    return found[0].union(found[1]).select(F.col("c_custkey").cast("bigint"), "c_name")


@register("insert_if_absent", "SELECT doc_id, quality AS mark, 'label' AS why FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 9, 'short' FROM documents WHERE n_chars < 600 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def insert_if_absent(spark, d):
    color = table(spark, d, "labels").filter("toxic = 1").select("doc_id", F.col("quality").alias("mark"), F.lit("label").alias("why"))
    low = table(spark, d, "documents").filter("n_chars < 600").select("doc_id", F.lit(9).alias("mark"), F.lit("short").alias("why"))
    return merge.union_if_absent(color, low, keys=["doc_id"])


@register("batch_union", "SELECT count(*) AS n, count(DISTINCT doc_id) AS n_pages FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)")
def batch_union(spark, d):
    both = merge.all_batches([table(spark, d, name).select("doc_id") for name in ("documents", "labels")])
    return both.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_pages"))


@register("natural_order", "SELECT p_partkey, row_number() OVER (ORDER BY coalesce(TRY_CAST(nullif(regexp_extract(n, '(\\d+)', 1), '') AS BIGINT), 999999), n, p_partkey) AS place FROM (SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_size || '.png' END AS n FROM part)")
def natural_order(spark, d):
    key = F.col("p_partkey")
    name = F.concat("p_name", F.when(key % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.col("p_size"), F.lit(".png"))))
    number, whole = fx.natural_rank(name)
    return ordered.place_overall(table(spark, d, "part").select("p_partkey", number.alias("number"), whole.alias("name")), ["number", "name", "p_partkey"]).select("p_partkey", "place")


_FILES = "f AS (SELECT p_brand, p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '.txt' WHEN 1 THEN 'scan' || p_size || p_name || '.JPG' WHEN 2 THEN p_size || '_' || p_partkey || '.webp' WHEN 3 THEN p_name || '.png' ELSE 'no name ' || p_partkey END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'image/png' ELSE 'text/plain' END AS type FROM part)"


def _files(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    named = F.when(k % 5 == 0, F.concat(name, F.lit(".txt"))).when(k % 5 == 1, F.concat(F.lit("scan"), "p_size", name, F.lit(".JPG"))).when(k % 5 == 2, F.concat("p_size", F.lit("_"), k, F.lit(".webp"))).when(k % 5 == 3, F.concat(name, F.lit(".png"))).otherwise(F.concat(F.lit("no name "), k))
    return table(spark, d, "part").select("p_brand", k, named.alias("name"), F.when(k % 2 == 0, "image/png").otherwise("text/plain").alias("type"))


@register(
    "upload_manifest",
    f"WITH {_FILES}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(TRY_CAST(nullif(regexp_extract(name, '(\\d+)', 1), '') AS BIGINT), 999999), name, p_partkey) AS INTEGER) AS num FROM f), k AS (SELECT *, lower(regexp_extract(name, '\\.([A-Za-z]+)$', 1)) AS ext FROM n) SELECT p_brand, p_partkey, name, num, 'page_' || lpad(CAST(num AS VARCHAR), CAST(greatest(3, length(CAST(num AS VARCHAR))) AS INTEGER), '0') || CASE WHEN ext IN ('jpg', 'jpeg') THEN '.jpg' WHEN ext = 'webp' THEN '.webp' ELSE '.png' END AS file FROM k WHERE type LIKE 'image/%' OR ext IN ('png', 'jpg', 'jpeg', 'webp')",
)
def upload_manifest(spark, d):
    return listing.upload_manifest(_files(spark, d), by=["p_brand"], name="name", content_type="type", then=["p_partkey"]).select("p_brand", "p_partkey", "name", "num", "file")


@register("image_lists", f"WITH {_FILES}, k AS (SELECT *, list_position(['png', 'jpg', 'jpeg', 'webp'], lower(regexp_extract(name, '\\.([A-Za-z]+)$', 1))) AS r FROM f) SELECT p_brand, p_partkey, name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY r, name, p_partkey) AS INTEGER) AS place FROM k WHERE r > 0")
def image_lists(spark, d):
    return listing.files_by_kind(_files(spark, d).drop("type"), by=["p_brand"], name="name", then=["p_partkey"])


@register("distinct_customers", "SELECT o_custkey, list_aggregate(list_sort(list_distinct(list(o_orderpriority))), 'string_agg', ',') AS kinds FROM orders GROUP BY 1")
def distinct_customers(spark, d):
    return merge.sorted_distinct(table(spark, d, "orders"), by="o_custkey", value="o_orderpriority", out="kinds")


@register("placeholder_pages", "SELECT d.doc_id, l.doc_id IS NOT NULL AS has_text FROM documents d LEFT JOIN labels l USING (doc_id)")
def placeholder_pages(spark, d):
    return merge.with_text_marks(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), key="doc_id")


@register("price_lookup", "SELECT p_partkey, p_type, CASE p_type WHEN 'ECONOMY' THEN 1.0 WHEN 'STANDARD' THEN 2.0 ELSE 3.0 END AS price_in, CASE p_type WHEN 'ECONOMY' THEN 5.0 WHEN 'STANDARD' THEN 10.0 ELSE 15.0 END AS price_out FROM (SELECT p_partkey, p_type FROM part)")
def price_lookup(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type")
    prices = part.select("p_type").distinct().filter("p_type in ('ECONOMY', 'STANDARD')").select(F.col("p_type").alias("model"), F.when(F.col("p_type") == "ECONOMY", 1.0).otherwise(2.0).alias("price_in"), F.when(F.col("p_type") == "ECONOMY", 5.0).otherwise(10.0).alias("price_out"))
    return merge.lookup(part, prices, on="p_type", key="model", values={"price_in": 3.0, "price_out": 15.0})

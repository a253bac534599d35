"""Contract queries on signatures, devices, markup and nested data."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions.text import code_language
from pagemill.operators import devices, markup, ordered, reshape, signatures
from pagemill.plans.contract import register
from pagemill.plans.q_chapters import _ENDS
from pagemill.sources.tables import table

_GREY = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 0.5) * 255) AS DOUBLE)) AS v FROM embeddings)"


def _grey(spark, d):
    scaled = F.transform("embedding", lambda x: F.floor((x.cast("double") + 0.5) * 255).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", "label", scaled.alias("v"))


@register("grey_statistics", f"WITH {_GREY} SELECT vec_id, round(list_avg(v), 6) AS mean, len(list_filter(v, lambda x: x < 110)) / len(v) AS dark, list_avg(v) > 235 AND len(list_filter(v, lambda x: x < 120)) / len(v) < 0.02 AS white, list_avg(v) < 125 AS review, md5(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS digest FROM e")
def grey_statistics(spark, d):
    v = F.col("v")
    whole = F.transform("v", lambda x: x.cast("bigint"))
    return _grey(spark, d).select("vec_id", F.round(signatures.mean(v), 6).alias("mean"), signatures.dark_share(v).alias("dark"), signatures.is_near_white(v).alias("white"), signatures.needs_review(v).alias("review"), signatures.signature_digest(whole).alias("digest"))


_HASH = f"{_GREY}, m AS (SELECT *, list_avg(v) AS a FROM e), h AS (SELECT vec_id, label, list_transform(v, lambda x: x >= a) AS b FROM m)"


@register("frame_distances", f"WITH {_HASH} SELECT vec_id, label, CAST(len(list_filter(b, lambda x: x)) AS INTEGER) AS ones, CASE WHEN lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) IS NOT NULL THEN CAST(len(list_filter(list_zip(b, lag(b) OVER (PARTITION BY label ORDER BY vec_id)), lambda z: z[1] <> z[2])) AS INTEGER) END AS moved FROM h")
def frame_distances(spark, d):
    from pyspark.sql import Window as W

    hashed = signatures.average_hashes(_grey(spark, d), values="v")
    before = F.lag("hash").over(W.partitionBy("label").orderBy("vec_id"))
    return hashed.select("vec_id", "label", F.bit_count("hash").alias("ones"), signatures.hamming(F.col("hash"), before).alias("moved"))


@register("same_page_signatures", f"WITH {_GREY}, p AS (SELECT vec_id, label, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM e), f AS (SELECT vec_id, label, list_avg(list_transform(list_zip(v, u), lambda z: abs(z[1] - z[2]))) AS diff FROM p) SELECT vec_id, label, CASE WHEN diff IS NOT NULL THEN round(diff, 6) END AS diff, coalesce(diff < 40, false) AS same FROM f")
def same_page_signatures(spark, d):
    marked = ordered.same_as_previous(_grey(spark, d), ["label"], "vec_id", "v", 40.0)
    return marked.select("vec_id", "label", F.round("diff", 6).alias("diff"), "same")


@register(
    "distinct_frames",
    f"""WITH RECURSIVE {_HASH}, t AS (SELECT label, vec_id, b, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM h),
r AS (SELECT label, vec_id, n, b AS last, true AS keep FROM t WHERE n = 1
 UNION ALL SELECT label, vec_id, n, CASE WHEN d > 28 THEN b ELSE last END, d > 28 FROM (SELECT t.*, r.last, len(list_filter(list_zip(t.b, r.last), lambda z: z[1] <> z[2])) AS d FROM r JOIN t ON t.label = r.label AND t.n = r.n + 1))
SELECT label, vec_id FROM r WHERE keep""",
)
def distinct_frames(spark, d):
    hashed = signatures.average_hashes(_grey(spark, d), values="v").select("label", "vec_id", "hash")
    return ordered.distinct_frames(hashed, ["label"], "vec_id", "hash", 28).select("label", "vec_id")


_PIXELS = "x AS (SELECT l_partkey AS image, l_linenumber AS x, l_suppkey % 10 AS y, l_orderkey * 7 % 256 AS r, l_orderkey * 13 % 256 AS g, l_orderkey * 29 % 256 AS b FROM lineitem)"


def _pixels(spark, d):
    n = F.col("l_orderkey")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("image"), F.col("l_linenumber").alias("x"), (F.col("l_suppkey") % 10).alias("y"), (n * 7 % 256).alias("r"), (n * 13 % 256).alias("g"), (n * 29 % 256).alias("b"))


_COLOUR = f"{_PIXELS}, c AS (SELECT image, CASE WHEN NOT (least(r, g, b) > 225 OR greatest(r, g, b) < 55) THEN (r // 24 * 24 + 12, g // 24 * 24 + 12, b // 24 * 24 + 12) END AS colour, count(*) AS n FROM x GROUP BY 1, 2), t AS (SELECT image, coalesce(max(n) FILTER (WHERE colour IS NOT NULL) / sum(n), 0) AS share, max((n, colour)) FILTER (WHERE colour IS NOT NULL) AS top FROM c GROUP BY image)"


@register("dominant_colours", f"WITH {_COLOUR} SELECT image, share, CAST(top[2][1] AS BIGINT) AS r, CAST(top[2][2] AS BIGINT) AS g, CAST(top[2][3] AS BIGINT) AS b FROM t")
def dominant_colours(spark, d):
    return signatures.dominant_colour(_pixels(spark, d), image="image").select("image", "share", "colour.r", "colour.g", "colour.b")


@register(
    "cover_candidates",
    f"WITH {_COLOUR}, i AS (SELECT image % 20 AS book, image AS page, share * 4 AS share, image % 97 / 5000 AS density FROM t), a AS (SELECT book, page, 'color' AS why FROM i WHERE share >= 0.30), l AS (SELECT book, page, 'low-density' AS why FROM i WHERE density BETWEEN 0.0002 AND 0.010 QUALIFY row_number() OVER (PARTITION BY book ORDER BY density, page) <= 25) SELECT * FROM a UNION ALL SELECT * FROM l WHERE page NOT IN (SELECT page FROM a)",
)
def cover_candidates(spark, d):
    shares = signatures.dominant_colour(_pixels(spark, d), image="image")
    images = shares.select((F.col("image") % 20).alias("book"), F.col("image").alias("page"), (F.col("share") * 4).alias("share"), (F.col("image") % 97 / 5000).alias("density"))
    return signatures.cover_candidates(images, book="book", page="page", share="share", density="density")


@register(
    "content_boxes",
    f"""WITH {_PIXELS}, k AS (SELECT image, x, y, CASE WHEN greatest(r, g, b) - least(r, g, b) > 100 OR greatest(r, g, b) < 90 THEN 1 ELSE 0 END AS k FROM x),
k2 AS (SELECT image, x, y, CASE WHEN greatest(r, g, b) - least(r, g, b) > 18 OR greatest(r, g, b) < 155 OR least(r, g, b) >= 245 THEN 1 ELSE 0 END AS k FROM x),
cx AS (SELECT image, min(x) FILTER (WHERE s >= 0.3) AS x0, max(x) FILTER (WHERE s >= 0.3) AS x1, min(x) AS xl, max(x) AS xh FROM (SELECT image, x, avg(k) AS s FROM k2 GROUP BY 1, 2) GROUP BY image),
cy AS (SELECT image, min(y) FILTER (WHERE s >= 0.3) AS y0, max(y) FILTER (WHERE s >= 0.3) AS y1, min(y) AS yl, max(y) AS yh FROM (SELECT image, y, avg(k) AS s FROM k2 GROUP BY 1, 2) GROUP BY image)
SELECT image, CASE WHEN x0 IS NULL OR y0 IS NULL THEN xl ELSE x0 END AS x0, CASE WHEN x0 IS NULL OR y0 IS NULL THEN xh ELSE x1 END AS x1, CASE WHEN x0 IS NULL OR y0 IS NULL THEN yl ELSE y0 END AS y0, CASE WHEN x0 IS NULL OR y0 IS NULL THEN yh ELSE y1 END AS y1 FROM cx JOIN cy USING (image)""",
)
def content_boxes(spark, d):
    return signatures.content_box(_pixels(spark, d), image="image")


_DISPLAY = "s AS (SELECT s_suppkey AS id, s_nationkey AS room, 900 + s_suppkey * 37 % 1700 AS width, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS scale, s_suppkey % 2 = 0 AS builtin FROM supplier), v AS (SELECT *, width * scale // 2 AS page_px, width * scale AS single_px FROM s)"


def _displays(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("room"), (900 + k * 37 % 1700).alias("width"), F.when(k % 3 == 0, 2).otherwise(1).alias("scale"), (k % 2 == 0).alias("builtin"))
    return devices.evaluate_displays(s, width="width", scale="scale")


@register("display_specs", f"WITH {_DISPLAY} SELECT id, CAST(width * scale AS INTEGER) AS backing, CAST(page_px AS INTEGER) AS page_px, CAST(single_px AS INTEGER) AS single_px, page_px >= 1400 AS meets, single_px >= 1400 AS meets_single, CASE WHEN page_px >= 1400 THEN 'spread' WHEN single_px >= 1400 THEN 'single' END AS best_layout FROM v")
def display_specs(spark, d):
    return _displays(spark, d).select("id", "backing", "page_px", "single_px", "meets", "meets_single", "best_layout")


@register(
    "display_plan",
    f"WITH {_DISPLAY}, p AS (SELECT room, max(id) FILTER (WHERE page_px >= 1400 AND id = room * 4) AS pref, arg_max(id, (page_px, CAST(builtin AS INT), -id)) FILTER (WHERE page_px >= 1400) AS wide, bool_or(page_px >= 1400) AS any_meets, bool_or(single_px >= 1400) AS any_single FROM v GROUP BY room) SELECT room, any_meets, coalesce(pref, wide) AS chosen, CASE WHEN pref IS NOT NULL THEN 'preferred' WHEN wide IS NOT NULL THEN 'widest' END AS reason, NOT any_meets AS override, NOT any_meets AND any_single AS single_page FROM p",
)
def display_plan(spark, d):
    wanted = _displays(spark, d).withColumn("prefer", F.col("room") * 4)
    return devices.plan_display(wanted, group="room", id="id", builtin="builtin", prefer="prefer")


@register(
    "window_preflight",
    """WITH w AS (SELECT p_partkey, p_size * 50 AS w, 900 AS h, 1900 AS dw, 950 AS dh, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS scale, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END AS pages, CASE WHEN p_partkey % 3 = 0 THEN p_size * 40 END AS m FROM part),
x AS (SELECT *, w >= dw * 0.95 AND h >= dh * 0.90 AS maximised, w * scale // pages AS page_px, CAST(ceil(1400 * pages / scale) AS INTEGER) AS need_pt FROM w),
z AS (SELECT *, round(m / nullif(page_px, 0), 4) AS zoom, coalesce(nullif(m, 0), page_px) >= 1400 AS meets FROM x)
SELECT p_partkey, maximised, CAST(page_px AS INTEGER) AS page_px, need_pt, meets, list_filter([CASE WHEN NOT maximised THEN 'maximise' END, CASE WHEN pages >= 2 THEN 'single page' END, CASE WHEN zoom < 0.845 THEN 'zoom in' END, CASE WHEN NOT meets THEN CASE WHEN need_pt > dw THEN 'larger display' ELSE 'wider window' END END], lambda a: a IS NOT NULL) AS advice, maximised AND meets AND coalesce(zoom >= 0.845, true) AS ok FROM z""",
)
def window_preflight(spark, d):
    k = F.col("p_partkey")
    w = table(spark, d, "part").select(k, (F.col("p_size") * 50).alias("w"), F.lit(900).alias("h"), F.lit(1900).alias("dw"), F.lit(950).alias("dh"), F.when(k % 2 == 0, 2).otherwise(1).alias("scale"), F.when(k % 5 == 0, 2).otherwise(1).alias("pages"), F.when(k % 3 == 0, F.col("p_size") * 40).alias("m"))
    checked = devices.preflight(w, win_w="w", win_h="h", disp_w="dw", disp_h="dh", scale="scale", pages="pages", measured="m")
    return checked.select("p_partkey", "maximised", "page_px", "need_pt", "meets", "advice", "ok")


@register("catalogue_cards", "SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, nullif(trim(regexp_extract(c, 'href=\"([^\"]*)\"', 1)), '') AS link, nullif(trim(regexp_replace(regexp_extract(c, '<a[^>]*>(.*?)</a>', 1), '<[^>]+>', ' ', 'g')), '') AS title, 'first' AS \"by\" FROM (SELECT page_id, l[i] AS c, i FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li>.*?</li>') AS l FROM pages)))")
def catalogue_cards(spark, d):
    fields = {"link": r'href="([^"]*)"', "title": r"(?s)<a[^>]*>(.*?)</a>"}
    other = (r"(?s)<article>.*?</article>", {"link": r'href="([^"]*)"', "title": r"(?s)<h1>(.*?)</h1>"})
    return markup.cards_with_fallback(table(spark, d, "pages"), id="page_id", html="html", first=(r"(?s)<li>.*?</li>", fields), second=other)


@register("article_cards", "SELECT page_id, 0 AS pos, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>.*?<h1>(.*?)</h1>.*?</article>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '') AS title, 'second' AS \"by\" FROM pages WHERE regexp_matches(html, '(?s)<article>.*?</article>')")
def article_cards(spark, d):
    second = (r"(?s)<article>.*?</article>", {"title": r"(?s)<h1>(.*?)</h1>"})
    return markup.cards_with_fallback(table(spark, d, "pages"), id="page_id", html="html", first=(r"<card>.*?</card>", {"title": "(x)"}), second=second)


@register("element_histogram", "SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '(?:class=\"|<)([a-z][a-z0-9]*)', 1)) AS name FROM pages) GROUP BY name HAVING count(*) >= 5 ORDER BY n DESC, name LIMIT 20")
def element_histogram(spark, d):
    return markup.name_histogram(table(spark, d, "pages"), html="html", pattern='(?:class="|<)([a-z][a-z0-9]*)')


@register("long_lists", "SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, CAST(len(regexp_extract_all(l[i], '<li\\b')) AS INTEGER) AS items FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<(?:ul|ol)\\b.*?</(?:ul|ol)>') AS l FROM pages)) WHERE items >= 5 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) <= 10")
def long_lists(spark, d):
    return markup.long_lists(table(spark, d, "pages"), id="page_id", html="html")


@register("selector_vote", "WITH c AS (SELECT CAST(sum(len(regexp_extract_all(html, '<li>'))) AS BIGINT) AS a, CAST(sum(len(regexp_extract_all(html, '<p>'))) AS BIGINT) AS b, CAST(sum(len(regexp_extract_all(html, '<card>'))) AS BIGINT) AS c FROM pages), r AS (SELECT '<li>' AS pattern, a AS n FROM c UNION ALL SELECT '<p>', b FROM c UNION ALL SELECT '<card>', c FROM c) SELECT pattern, n, n = (SELECT max(n) FROM r) AS won FROM r WHERE n > 0")
def selector_vote(spark, d):
    return markup.selector_vote(table(spark, d, "pages"), html="html", patterns=["<li>", "<p>", "<card>"])


@register("page_requests", f"SELECT doc_id, 'page ' || doc_id || chr(10) || coalesce(nullif(regexp_replace(CASE WHEN doc_id % 9 = 0 THEN chr(10) || chr(9) || chr(12288) ELSE text END, '{_ENDS}', '', 'g'), ''), '(empty)') || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'intro: ' || source ELSE '' END AS request FROM documents")
def page_requests(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select(k, F.when(k % 9 == 0, "\n\t\u3000").otherwise(F.col("text")).alias("text"), F.when(k % 5 == 0, F.col("source")).alias("hint"))
    return reshape.page_requests(docs, page="doc_id", text="text", hint="hint")


@register("book_blobs", "SELECT source, left(string_agg('[p.' || doc_id || ']' || chr(10) || left(text, 1200), chr(10) || chr(10) ORDER BY doc_id), 9000) AS blob FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 6 OR row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 2) GROUP BY source")
def book_blobs(spark, d):
    return reshape.book_blob(table(spark, d, "documents").select("source", "doc_id", "text"), book="source", page="doc_id", text="text")


def _replies(spark, d):
    k = F.col("c_custkey")
    body = F.concat(F.lit('{"num": 1, "summary": "'), F.col("c_name"), F.lit('", "topics": ["'), F.col("c_mktsegment"), F.lit('"]}'))
    fenced = F.concat(F.lit("```json\n"), body, F.when(k % 2 == 0, "\n```").otherwise(""))
    return table(spark, d, "customer").select(k, F.when(k % 5 == 0, "sorry").when(k % 5 == 1, F.concat(F.lit("Here: "), body, F.lit(" ok"))).otherwise(fenced).alias("reply"))


@register("page_replies", "SELECT c_custkey AS num, c_name AS summary, c_mktsegment AS topics FROM customer WHERE c_custkey % 5 <> 0")
def page_replies(spark, d):
    good, _ = reshape.page_replies(_replies(spark, d), page="c_custkey", reply="reply")
    return good.select("num", "summary", F.array_join("topics", ",").alias("topics"))


@register("rejected_replies", "SELECT c_custkey, 'sorry' AS reply FROM customer WHERE c_custkey % 5 = 0")
def rejected_replies(spark, d):
    return reshape.page_replies(_replies(spark, d), page="c_custkey", reply="reply")[1]


def _code_map(spark, d):
    p = table(spark, d, "part")
    block = F.struct(F.when(F.col("p_size") % 2 == 0, "python").otherwise("C#").alias("lang"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.concat(F.lit("x = "), F.col("p_size"))).alias("code"))
    per_page = p.groupBy("p_brand", F.floor(F.col("p_partkey") / 100).alias("page")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", block.alias("b")))).alias("l"))
    entry = F.struct(F.col("page").cast("string").alias("key"), F.transform("l", lambda x: x["b"]).alias("value"))
    return per_page.groupBy("p_brand").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))


_BLOCKS = "b AS (SELECT p_brand, CAST(p_partkey // 100 AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY p_brand, p_partkey // 100 ORDER BY p_partkey) - 1 AS INTEGER) AS idx, CASE WHEN p_size % 2 = 0 THEN 'python' ELSE 'C#' END AS lang, p_name AS title, CASE WHEN p_size % 7 = 0 THEN ' ' ELSE 'x = ' || p_size END AS code FROM part)"


@register("code_blocks", f"WITH {_BLOCKS} SELECT * FROM b WHERE trim(code) <> ''")
def code_blocks(spark, d):
    return reshape.code_map_rows(_code_map(spark, d), book="p_brand", json="json")


@register("page_languages", f"WITH {_BLOCKS}, l AS (SELECT p_brand, page, CASE WHEN lang = 'python' THEN 'Python' ELSE 'C#' END AS l, min(idx) AS i FROM b WHERE trim(code) <> '' GROUP BY ALL) SELECT p_brand, page, string_agg(l, ' · ' ORDER BY i) AS langs FROM l GROUP BY 1, 2")
def page_languages(spark, d):
    return reshape.languages_of_pages(code_blocks(spark, d), by=["p_brand", "page"], label=code_language(F.col("lang")))


@register("code_totals", f"WITH {_BLOCKS} SELECT p_brand, count(DISTINCT page) AS pages, count(*) AS blocks FROM b WHERE trim(code) <> '' GROUP BY 1")
def code_totals(spark, d):
    return reshape.code_totals(code_blocks(spark, d), book="p_brand", page="page")


def _overview(spark, d):
    n, chars = F.col("doc_id"), F.col("n_chars")
    body = F.struct(F.array(F.col("lang"), F.lit(" ")).alias("key_topics"), F.array(F.struct(F.col("source").alias("term"), F.lit("d").alias("desc")), F.struct(F.lit("").alias("term"), F.lit("e").alias("desc"))).alias("key_terms"), F.array(F.struct(F.when(chars > 1000, n).alias("page"), F.lit("w").alias("why"))).alias("must_read_pages"), F.array(F.struct(n.alias("num"), F.lit("t").alias("title"), F.lit(1).alias("start"), F.lit(2).alias("end"), F.when(chars > 500, "b").otherwise("").alias("body"))).alias("chapter_digests"))
    return table(spark, d, "documents").select(n, F.to_json(body).alias("json"))


@register("overview_clean", "SELECT doc_id, lang AS topics, source AS terms, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS must_read, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS digests FROM documents")
def overview_clean(spark, d):
    o = reshape.clean_overview(_overview(spark, d), book="doc_id", json="json")
    return o.select("doc_id", F.array_join("topics", ",").alias("topics"), F.array_join(F.transform("terms", lambda t: t["term"]), ",").alias("terms"), F.size("must_read").alias("must_read"), F.size("digests").alias("digests"))


@register("table_cells", "SELECT doc_id, 0 AS \"row\", c AS col, CASE c WHEN 0 THEN 'name' WHEN 1 THEN 'region' END AS header, CASE c WHEN 0 THEN lang WHEN 1 THEN source ELSE 'x' END AS value FROM documents, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS c)")
def table_cells(spark, d):
    payload = F.struct(F.array(F.lit("name"), F.lit("region")).alias("headers"), F.array(F.array("lang", "source", F.lit("x"))).alias("rows"))
    return reshape.table_cells(table(spark, d, "documents").select("doc_id", F.to_json(payload).alias("json")), id="doc_id", json="json")


@register(
    "section_items",
    """WITH p AS (SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part)
SELECT p_partkey, 0 AS section, p_brand AS title, CAST(NULL AS VARCHAR) AS sub, 'point' AS kind, 0 AS pos, p_name AS text, false AS core FROM p
UNION ALL SELECT p_partkey, 0, p_brand, NULL, 'tag', i, CASE i WHEN 0 THEN p_type ELSE 'second' END, i = 0 AND p_size > 20 FROM p, (SELECT CAST(unnest(range(0, 2)) AS INTEGER) AS i)
UNION ALL SELECT p_partkey, 0, p_brand, 'more', 'point', 0, 'deep ' || p_name, false FROM p""",
)
def section_items(spark, d):
    tags = F.array(F.struct(F.col("p_type").alias("text"), F.when(F.col("p_size") > 20, True).alias("core")), F.struct(F.lit("second").alias("text"), F.lit(False).alias("core")))
    subs = F.array(F.struct(F.lit("more").alias("heading"), F.array(F.concat(F.lit("deep "), "p_name")).alias("points")))
    sections = F.array(F.struct(F.col("p_brand").alias("title"), F.array("p_name").alias("points"), tags.alias("tags"), subs.alias("subsections")))
    return reshape.section_items(table(spark, d, "part").select("p_partkey", F.to_json(sections).alias("json")), id="p_partkey", json="json")


@register("block_replies", "SELECT c_custkey, CAST(i AS INTEGER) AS idx, CASE WHEN i = 0 THEN 'python' ELSE 'C#' END AS lang, c_name AS title, CASE WHEN i = 0 THEN 'x = 1' ELSE 'y' END AS code FROM customer, (SELECT unnest(range(0, 2)) AS i) WHERE c_custkey % 5 > 0")
def block_replies(spark, d):
    block = lambda lang, code: F.struct(F.lit(lang).alias("lang"), F.col("c_name").alias("title"), F.lit(code).alias("code"))
    body = F.to_json(F.struct(F.array(block("python", "x = 1"), block("C#", "y"), block("C#", " ")).alias("blocks")))
    reply = F.when(F.col("c_custkey") % 5 == 0, "no code here").when(F.col("c_custkey") % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Blocks: "), body))
    return reshape.block_replies(table(spark, d, "customer").select("c_custkey", reply.alias("reply")), page="c_custkey", reply="reply")


@register("topic_tags", "SELECT c_mktsegment AS topic, count(*) AS n FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1")
def topic_tags(spark, d):
    good, _ = reshape.page_replies(_replies(spark, d), page="c_custkey", reply="reply")
    return reshape.topic_counts(good)


@register("publish_gate", "SELECT source, count(*) >= 40 AS enough_cards, max(lang) <> 'es' AS has_overview, min(n_chars) > 100 AS full_digests, count(*) >= 40 AND max(lang) <> 'es' AND min(n_chars) > 100 AS published FROM documents GROUP BY source")
def publish_gate(spark, d):
    books = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("cards"), F.when(F.max("lang") != "es", "text").otherwise(" ").alias("overview"), F.array(F.struct(F.lit("t").alias("title"), F.when(F.min("n_chars") > 100, "b").otherwise("").alias("body"))).alias("digests"), F.lit(False).alias("panel"), F.lit(False).alias("code"))
    return reshape.publish_gate(books, cards="cards", overview="overview", digests="digests", panel="panel", code="code").select("source", "enough_cards", "has_overview", "full_digests", "published")

"""Contract queries on chapters and contents pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import chapters as ch
from pagemill.operators import ordered, pages
from pagemill.plans.contract import register
from pagemill.sources.tables import table


def _marked(spark, d):
    """Pages of a book per customer: some chapter pages, some section pages, most plain."""
    o, n = table(spark, d, "orders"), F.col("o_orderkey")
    sid = F.when(n % 7 == 0, F.concat((n % 50).cast("string"), F.lit("장"))).when(n % 11 == 0, F.concat(F.lit("Part "), (n % 9).cast("string"))).when(n % 3 == 0, F.concat((n % 50).cast("string"), F.lit(".1"))).otherwise("")
    title = F.when(n % 14 == 0, F.concat(F.lit("Title "), n.cast("string"))).when((n % 3 == 0) & (n % 2 == 0), F.concat(F.lit("Intro "), n.cast("string")))
    return o.select(F.col("o_custkey").alias("book"), n.alias("page"), sid.alias("sid"), title.alias("title"))


_TREE_SQL = """p AS (SELECT o_custkey AS book, o_orderkey AS page, CASE WHEN n % 7 = 0 THEN (n % 50) || '장' WHEN n % 11 = 0 THEN 'Part ' || (n % 9) WHEN n % 3 = 0 THEN (n % 50) || '.1' ELSE '' END AS sid,
 CASE WHEN n % 14 = 0 THEN 'Title ' || n WHEN n % 6 = 0 THEN 'Intro ' || n END AS title FROM (SELECT *, o_orderkey AS n FROM orders)),
k AS (SELECT *, CASE WHEN (contains(sid, '장') AND NOT contains(sid, '.')) OR contains(sid, 'Part') THEN 'C' WHEN title IS NOT NULL AND contains(sid, '.') THEN 'S' ELSE 'P' END AS kind FROM p),
b AS (SELECT *, lag(kind) OVER (PARTITION BY book ORDER BY page) AS before FROM k),
o AS (SELECT *, kind = 'C' OR (kind = 'P' AND before IS NULL) AS opens, kind = 'S' OR (kind = 'P' AND (before IS NULL OR before = 'C')) AS starts FROM b),
s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w AS cn, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER w AS sn, bool_or(opens) OVER (PARTITION BY book) AS known,
 last_value(CASE WHEN opens THEN CASE WHEN kind = 'C' THEN coalesce(title, sid) ELSE sid END END IGNORE NULLS) OVER w AS chapter, last_value(CASE WHEN opens THEN CASE WHEN kind = 'C' THEN sid ELSE '' END END IGNORE NULLS) OVER w AS csid,
 last_value(CASE WHEN starts THEN CASE WHEN kind = 'S' THEN title ELSE coalesce(nullif(sid, ''), '기타') END END IGNORE NULLS) OVER w AS section FROM o WINDOW w AS (PARTITION BY book ORDER BY page)),
t AS (SELECT book, page, CAST(CASE WHEN known THEN cn ELSE 1 END AS BIGINT) AS chapter_no, CASE WHEN known THEN chapter ELSE '' END AS chapter,
 CASE WHEN NOT known OR csid = '' THEN '' WHEN starts_with(csid, 'Part') THEN 'chs-part-' || regexp_extract(csid, '(\\d+)', 1) ELSE 'chs-chapter-' || regexp_extract(csid, '^(\\d+)', 1) END AS chapter_id,
 CAST(CASE WHEN NOT known THEN 1 WHEN kind <> 'C' THEN sn END AS BIGINT) AS section_no, CASE WHEN NOT known THEN '전체 페이지' WHEN kind <> 'C' THEN section END AS section, CASE WHEN known THEN coalesce(nullif(sid, ''), 'p.' || page) ELSE 'p.' || page END AS label, known AND kind = 'C' AS is_intro FROM s WHERE NOT known OR cn > 0)"""


@register("chapter_rows", f"WITH {_TREE_SQL} SELECT * FROM t")
def chapter_rows(spark, d):
    return ch.chapter_rows(_marked(spark, d), book="book", page="page", section="sid", title="title")


@register("chapter_tree_flat", f"WITH {_TREE_SQL} SELECT book, chapter, CASE WHEN section <> chapter THEN section END AS section, page, label FROM t WHERE section_no IS NOT NULL")
def chapter_tree_flat(spark, d):
    return ch.flat_tree(ch.chapter_tree(chapter_rows(spark, d)))


_RANGE_SQL = "r AS (SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY start) AS INTEGER) AS num, start, coalesce(lead(start) OVER (PARTITION BY book ORDER BY start) - 1, (SELECT max(doc_id) FROM documents)) AS \"end\" FROM (SELECT source AS book, doc_id AS start FROM documents WHERE n_chars > 900))"


def _ranges(spark, d):
    starts = table(spark, d, "documents").filter("n_chars > 900").select(F.col("source").alias("book"), F.col("doc_id").alias("start"))
    last = table(spark, d, "documents").agg(F.max("doc_id").alias("last"))
    ended = ordered.range_ends(starts.crossJoin(F.broadcast(last)), ["book"], "start", F.col("last")).drop("last")
    return ordered.renumber(ended, ["book"], ["start"])


_ENDS = r"^[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+|[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+$"


def _bare(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '<[^>]+>', ' ', 'g'), '{_ENDS}', '', 'g')"


_TEXT_SQL = f"""{_RANGE_SQL}, l AS (SELECT book, num, doc_id, '[p.' || doc_id || '] ' || {_bare("coalesce(text, '')")} || CASE WHEN doc_id % 3 = 0 THEN ' / 핵심: ' || lang || '; of  ' || {_bare("source")} ELSE '' END AS line FROM r JOIN documents ON source = book AND doc_id BETWEEN start AND "end"),
t AS (SELECT book, num, left(string_agg(line, chr(10) ORDER BY doc_id), 6000) AS text FROM l GROUP BY 1, 2)"""


def texts_of_chapters(spark, d):
    points = F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("<b>"), "lang", F.lit("</b>")), F.concat(F.lit("of <i>"), "source", F.lit("</i>\u3000")))).otherwise(F.array().cast("array<string>"))
    docs = table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text", points.alias("points"))
    return ch.chapter_texts(docs, _ranges(spark, d), text="text", points="points")


@register("chapter_texts", f"WITH {_TEXT_SQL} SELECT * FROM t")
def chapter_texts(spark, d):
    return texts_of_chapters(spark, d)


@register("pages_of_chapters", f'WITH {_RANGE_SQL}, f AS (SELECT book, min(start) AS first FROM r GROUP BY book) SELECT source AS book, doc_id AS page, num FROM documents JOIN r ON source = book AND doc_id BETWEEN start AND "end" UNION ALL SELECT source, doc_id, 0 FROM documents JOIN f ON source = book AND doc_id < first AND doc_id >= 1')
def pages_of_chapters(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"))
    return ch.chapters_of_pages(docs, _ranges(spark, d), front=True)


@register("chapter_report", f"WITH {_TREE_SQL} SELECT book, chapter_no, chapter, chapter_id, count(*) AS pages, count(DISTINCT section_no) AS sections, min(page) FILTER (WHERE is_intro) AS intro_page FROM t GROUP BY ALL")
def chapter_report(spark, d):
    return ch.chapter_report(chapter_rows(spark, d))


@register("chapter_pages", "WITH r AS (SELECT o_custkey AS book, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS num, o_orderkey % 1000 AS start, o_orderkey % 1000 + 5 AS \"end\" FROM orders) SELECT book, num, unnest(range(start, \"end\" + 1)) AS page FROM r UNION ALL SELECT book, 0, unnest(range(1, first)) FROM (SELECT book, min(start) AS first FROM r GROUP BY book) WHERE first > 1")
def chapter_pages(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("book"), "o_orderkey", (F.col("o_orderkey") % 1000).alias("start"), (F.col("o_orderkey") % 1000 + 5).alias("end"))
    return ch.pages_in_chapters(ordered.renumber(o, ["book"], ["o_orderkey"]).drop("o_orderkey"))


def _contents(spark, d):
    titles = table(spark, d, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderpriority").alias("title")).distinct()
    return ordered.renumber(titles, ["book"], ["title"], "pos").select("book", "pos", F.when(F.col("pos") % 3 == 0, 0).otherwise(F.col("pos")).alias("num"), "title")


_LOCATED = """WITH RECURSIVE p AS (SELECT o_custkey AS book, o_orderkey AS page, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 5 END AS head, lower(regexp_replace('about ' || o_orderpriority, '[^A-Za-z0-9]', '', 'g')) AS norm FROM orders),
c AS (SELECT *, CASE WHEN pos % 3 = 0 THEN 0 ELSE pos END AS num, lower(regexp_replace(title, '[^A-Za-z0-9]', '', 'g')) AS norm FROM (SELECT book, title, CAST(row_number() OVER (PARTITION BY book ORDER BY title) AS INTEGER) AS pos FROM (SELECT DISTINCT o_custkey AS book, o_orderpriority AS title FROM orders))),
h AS (SELECT c.book, c.pos, p.page, CASE WHEN c.num > 0 AND p.head = c.num THEN 2 ELSE 0 END + CASE WHEN contains(p.norm, c.norm) THEN 1 ELSE 0 END AS score FROM c JOIN p ON c.book = p.book),
r AS (SELECT DISTINCT book, 0 AS pos, CAST(1 AS BIGINT) AS bound, CAST(NULL AS BIGINT) AS start, CAST(NULL AS INTEGER) AS score FROM c
 UNION ALL SELECT book, CAST(pos AS INTEGER), coalesce(b.page + 1, bound), b.page, b.score FROM (SELECT r.book, r.pos + 1 AS pos, r.bound, arg_max({'page': h.page, 'score': CAST(h.score AS INTEGER)}, (h.score, -h.page)) AS b FROM r JOIN c ON c.book = r.book AND c.pos = r.pos + 1 LEFT JOIN h ON h.book = r.book AND h.pos = r.pos + 1 AND h.score > 0 AND h.page >= r.bound GROUP BY 1, 2, 3))
SELECT r.book, r.pos, CAST(num AS INTEGER) AS num, title, start, score FROM r JOIN c USING (book, pos) WHERE start IS NOT NULL"""


@register("located_chapters", _LOCATED)
def located_chapters(spark, d):
    n = F.col("o_orderkey")
    head = F.when(n % 4 == 0, F.concat(F.lit("Chapter 0"), n % 5, F.lit("\n"))).otherwise("")
    texts = table(spark, d, "orders").select(F.col("o_custkey").alias("book"), n.alias("page"), F.concat(head, F.lit("about "), F.col("o_orderpriority")).alias("text"))
    return ch.locate_chapters(texts, _contents(spark, d))


@register("distinct_contents", "WITH c AS (SELECT o_custkey AS book, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 5 END AS num, CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE o_orderpriority END AS title FROM orders) SELECT book, pos, num, title FROM c WHERE trim(title) <> '' QUALIFY row_number() OVER (PARTITION BY book, CASE WHEN num > 0 THEN '#' || num ELSE lower(regexp_replace(title, '[^A-Za-z0-9]', '', 'g')) END ORDER BY pos) = 1")
def distinct_contents(spark, d):
    n = F.col("o_orderkey")
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("book"), n.alias("pos"), F.when(n % 3 == 0, 0).otherwise(n % 5).alias("num"), F.when(n % 17 == 0, " ").otherwise(F.col("o_orderpriority")).alias("title"))
    return ch.distinct_contents(c, order=["pos"])


@register("false_chapter_gates", """WITH c AS (SELECT o_custkey AS book, o_orderkey % 12 AS num, o_orderkey AS start, (SELECT max(o_orderkey) FROM orders) AS last_page FROM orders),
g AS (SELECT book, min(num) FILTER (WHERE num > 0) AS lo, max(num) FILTER (WHERE num > 0) AS hi, count(*) FILTER (WHERE num > 0) AS k, count(DISTINCT num) FILTER (WHERE num > 0) AS d, count(*) AS n, min(start) AS f, max(start) AS l, max(last_page) AS e FROM c GROUP BY book)
SELECT book, coalesce(lo <= 2 AND hi - lo + 1 - k <= 2, false) AS dense, ((l - f) / e >= 0.30 AND f / e <= 0.6) OR n < 2 AS spread, n = w AND (k = 0 OR (lo <= 1 AND hi - lo + 1 = k AND k = d)) AS complete FROM g JOIN (SELECT o_custkey AS book, count(*) AS w FROM orders WHERE o_orderpriority <> '5-LOW' OR o_totalprice > 1000 GROUP BY 1) USING (book)""")
def false_chapter_gates(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("book"), (F.col("o_orderkey") % 12).alias("num"), F.col("o_orderkey").alias("start"))
    o = o.crossJoin(F.broadcast(o.agg(F.max("start").alias("last_page"))))
    contents = table(spark, d, "orders").filter("o_orderpriority <> '5-LOW' or o_totalprice > 1000").select(F.col("o_custkey").alias("book"))
    return ch.cover_gate(o).join(ch.spread_gate(o), "book").join(ch.completeness_gate(o, contents), "book")


@register("chapter_strategy", "WITH a AS (SELECT c_nationkey AS book, c_custkey AS page FROM customer WHERE c_acctbal > 9700), b AS (SELECT c_nationkey AS book, c_custkey AS page FROM customer WHERE c_acctbal < -300), n AS (SELECT book, (SELECT count(*) FROM a WHERE a.book = x.book) AS na, (SELECT count(*) FROM b WHERE b.book = x.book) AS nb FROM (SELECT DISTINCT c_nationkey AS book FROM customer) x), w AS (SELECT book, CASE WHEN na < 2 AND nb > na THEN 'contents' ELSE 'covers' END AS \"by\" FROM n) SELECT a.book, a.page, \"by\" FROM a JOIN w USING (book) WHERE \"by\" = 'covers' UNION ALL SELECT b.book, b.page, \"by\" FROM b JOIN w USING (book) WHERE \"by\" = 'contents'")
def chapter_strategy(spark, d):
    c, kept = table(spark, d, "customer"), [F.col("c_nationkey").alias("book"), F.col("c_custkey").alias("page")]
    return ch.choose_strategy(c.filter("c_acctbal > 9700").select(kept), c.filter("c_acctbal < -300").select(kept)).select("book", "page", "by")


_TOC_TEXT = "t AS (SELECT p_brand AS book, page, string_agg(CASE WHEN page % 3 = 0 THEN 'Prose about ' || p_name || '.' ELSE CASE WHEN p_partkey % 5 = 0 THEN 'Chapter ' || (p_partkey % 9) || ' ' ELSE '' END || p_name || ' ..... ' || p_size END, chr(10) ORDER BY p_partkey) AS text FROM (SELECT *, p_partkey // 250 AS page FROM part) GROUP BY 1, 2)"


def _toc_text(spark, d):
    key, page = F.col("p_partkey"), F.floor(F.col("p_partkey") / 250)
    chapter = F.when(key % 5 == 0, F.concat(F.lit("Chapter "), key % 9, F.lit(" "))).otherwise("")
    line = F.when(page % 3 == 0, F.concat(F.lit("Prose about "), F.col("p_name"), F.lit("."))).otherwise(F.concat(chapter, F.col("p_name"), F.lit(" ..... "), F.col("p_size")))
    lines = table(spark, d, "part").select(F.col("p_brand").alias("book"), page.alias("page"), key.alias("k"), line.alias("line"))
    return lines.groupBy("book", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("text"))


@register("toc_lines", f"WITH {_TOC_TEXT}, l AS (SELECT book, page, trim(unnest(string_split(text, chr(10)))) AS s FROM t) SELECT book, page, CAST(count(*) FILTER (WHERE length(s) >= 4 AND regexp_matches(s, '[.·•\\s]\\s*\\d{{1,3}}\\s*$') AND length(trim(regexp_replace(s, '[.·•\\s]\\s*\\d{{1,3}}\\s*$', ''))) >= 3) AS INTEGER) AS score FROM l GROUP BY 1, 2")
def toc_lines(spark, d):
    return _toc_text(spark, d).select("book", "page", pages.toc_lines(F.col("text")).alias("score"))


@register("toc_pages", f"WITH {_TOC_TEXT}, l AS (SELECT book, page, count(*) FILTER (WHERE page % 3 <> 0) AS score, list_distinct(list(p_partkey % 9) FILTER (WHERE page % 3 <> 0 AND p_partkey % 5 = 0)) AS m FROM (SELECT p_brand AS book, p_partkey // 250 AS page, p_partkey FROM part) GROUP BY 1, 2), dn AS (SELECT book, min(page) AS lo, max(page) AS hi, len(list_distinct(flatten(list(m)))) AS m FROM l WHERE score >= 6 AND page < 30 GROUP BY book) SELECT book, page, CAST(score AS INTEGER) AS score FROM l JOIN dn USING (book) WHERE dn.m >= 3 AND page BETWEEN lo AND hi AND score >= 3")
def toc_pages(spark, d):
    return pages.toc_pages(_toc_text(spark, d), book="book", page="page", text="text")


@register("publication_dates", "WITH p AS (SELECT o_custkey, o_orderdate AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey FROM orders), g AS (SELECT o_custkey, strftime(d, '%Y-%m-%d') AS d FROM p WHERE n <= 6 AND o_orderkey % 4 <> 0) SELECT o_custkey, min(d) AS pub_date, CASE WHEN max(d) <> min(d) THEN max(d) END AS revision_date FROM g GROUP BY 1")
def publication_dates(spark, d):
    day = F.date_format("o_orderdate", "yyyy'년' M'월' d'일'")
    text = F.when(F.col("o_orderkey") % 4 == 0, day).otherwise(F.concat(day, F.lit(" 초판 발행, 1970년 13월 1일")))
    return ch.publication_dates(table(spark, d, "orders").select("o_custkey", "o_orderkey", text.alias("text")), book="o_custkey", page="o_orderkey", text="text")

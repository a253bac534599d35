"""Model requests and replies, and the flattening of nested page data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import stripped
from pagemill.operators.ordered import first_and_last
from pagemill.schemas import BLOCKS, OVERVIEW, PAGE, PAGES_DATA, SECTIONS, TABLE

#: Characters of a page in a blob, of a blob, pages at either end of a book.
PAGE_CHARS, BLOB_CHARS, FRONT, BACK = 1200, 9000, 6, 2


def reply_json(reply: Column) -> Column:
    """The JSON object in a model's reply: without a code fence, from the first { to the last }."""
    bare = F.regexp_replace(F.trim(reply), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def page_requests(pages: DataFrame, *, page: str, text: str, hint: str) -> DataFrame:
    """One request text a page: its number, its whole text (or a mark that it is empty or white space
    only), and a hint if there is one."""
    body = F.coalesce(F.nullif(stripped(F.col(text)), F.lit("")), F.lit("(empty)"))
    lines = F.concat_ws("\n", F.concat(F.lit("page "), F.col(page).cast("string")), body, F.when(F.col(hint).isNotNull(), F.concat(F.lit("intro: "), F.col(hint))))
    return pages.select(page, lines.alias("request"))


def page_replies(replies: DataFrame, *, page: str, reply: str) -> tuple[DataFrame, DataFrame]:
    """Parsed page objects numbered by the page that was asked for, and replies that do not parse."""
    parsed = replies.withColumn("_p", F.from_json(reply_json(F.col(reply)), PAGE))
    good = (F.col("_p").isNotNull()) & (F.col("_p.summary").isNotNull())
    return parsed.filter(good).select(F.col(page).alias("num"), "_p.topics", "_p.terms", "_p.summary", "_p.points"), parsed.filter(~F.coalesce(good, F.lit(False))).select(page, reply)


def block_replies(replies: DataFrame, *, page: str, reply: str) -> DataFrame:
    """(page, idx, lang, title, code) of replies with code blocks; replies without an object have none."""
    blocks = F.coalesce(F.from_json(reply_json(F.col(reply)), BLOCKS)["blocks"], F.array().cast("array<struct<lang:string,title:string,code:string>>"))
    kept = F.filter(blocks, lambda b: F.trim(F.coalesce(b["code"], F.lit(""))) != "")
    return replies.select(page, F.posexplode(kept).alias("idx", "b")).select(page, "idx", "b.lang", "b.title", "b.code")


def chapter_requests(chapters: DataFrame, texts: DataFrame, *, title: str) -> DataFrame:
    """(book, num, request): what is asked about each chapter (book, num, title, start, end, summary): its
    place, its summary and the texts (book, num, text) of its pages."""
    head = F.concat(F.lit("book: "), F.col(title), F.lit("\nchapter "), F.col("num").cast("string"), F.lit(": "), F.col("title"), F.lit(" (p."), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(")"))
    request = F.concat_ws("\n", head, F.concat(F.lit("about: "), F.coalesce("summary", F.lit(""))), F.lit("pages:"), F.coalesce("text", F.lit("")))
    return chapters.join(texts.select("book", "num", "text"), ["book", "num"], "left").select("book", "num", request.alias("request"))


def book_requests(chapters: DataFrame, *, title: str) -> DataFrame:
    """(book, request): what is asked about each book, its title and a line for each chapter in order."""
    line = F.concat(F.col("num").cast("string"), F.lit(". "), F.col("title"), F.lit(" (p."), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("): "), F.coalesce("summary", F.lit("")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("start", "num", line.alias("line")))), lambda x: x["line"])
    return chapters.groupBy("book", title).agg(F.array_join(listed, "\n").alias("lines")).select("book", F.concat(F.lit("book: "), F.col(title), F.lit("\nchapters:\n"), F.col("lines")).alias("request"))


def section_items(rows: DataFrame, *, id: str, json: str) -> DataFrame:
    """(id, section, title, sub, kind, pos, text, core) of a list of sections: points and tags of each and
    points of its subsections, in order; core marks the tags that are."""
    sections = rows.select(id, F.posexplode(F.from_json(json, SECTIONS)).alias("section", "s"))
    none = F.lit(None).cast("string")
    points = sections.select(id, "section", "s.title", none.alias("sub"), F.lit("point").alias("kind"), F.posexplode("s.points").alias("pos", "text"), F.lit(False).alias("core"))
    tags = sections.select(id, "section", "s.title", none.alias("sub"), F.lit("tag").alias("kind"), F.posexplode("s.tags").alias("pos", "tag")).select(id, "section", "title", "sub", "kind", "pos", "tag.text", F.coalesce("tag.core", F.lit(False)).alias("core"))
    subs = sections.select(id, "section", "s.title", F.explode("s.subsections").alias("u")).select(id, "section", "title", F.col("u.heading").alias("sub"), F.lit("point").alias("kind"), F.posexplode("u.points").alias("pos", "text"), F.lit(False).alias("core"))
    return points.unionByName(tags).unionByName(subs)


def book_blob(pages: DataFrame, *, book: str, page: str, text: str) -> DataFrame:
    """Per book, its first and last pages, each cut and headed by its number, joined and cut."""
    ends = first_and_last(pages, [book], [page], FRONT, BACK)
    part = F.concat(F.lit("[p."), F.col(page).cast("string"), F.lit("]\n"), F.left(F.coalesce(text, F.lit("")), F.lit(PAGE_CHARS)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), part.alias("t")))), lambda x: x["t"]), "\n\n")
    return ends.groupBy(book).agg(F.left(joined, F.lit(BLOB_CHARS)).alias("blob"))


def read_pages_data(rows: DataFrame, *, json: str) -> DataFrame:
    """Pages of JSON that is either a list of pages or an object with `pages`."""
    listed = F.coalesce(F.from_json(F.when(F.col(json).rlike(r"^\s*\["), F.col(json)), f"array<{PAGE}>"), F.from_json(F.when(F.col(json).rlike(r"^\s*\{"), F.col(json)), PAGES_DATA)["pages"])
    return rows.withColumn("pages", listed)


def code_map_rows(rows: DataFrame, *, book: str, json: str) -> DataFrame:
    """(book, page, idx, lang, title, code) of a map of page to blocks, pages as numbers; blank code goes."""
    mapped = F.from_json(json, "map<string,array<struct<lang:string,title:string,code:string>>>")
    flat = rows.select(book, F.explode(mapped).alias("page", "blocks")).select(book, F.col("page").cast("int").alias("page"), F.posexplode("blocks").alias("idx", "b"))
    return flat.filter(F.trim("b.code") != "").select(book, "page", "idx", "b.lang", "b.title", "b.code")


def code_totals(blocks: DataFrame, *, book: str, page: str) -> DataFrame:
    """Per book: pages with code, and blocks."""
    return blocks.groupBy(book).agg(F.countDistinct(page).alias("pages"), F.count("*").alias("blocks"))


def topic_counts(pages: DataFrame, *, topics: str = "topics") -> DataFrame:
    """Each topic of the pages and how often it is named."""
    return pages.select(F.explode(topics).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


def languages_of_pages(blocks: DataFrame, *, by: list[str], label: Column) -> DataFrame:
    """Languages of each page in order of first sight, joined."""
    named = blocks.withColumn("_l", label).groupBy(*by, "_l").agg(F.min("idx").alias("_i"))
    return named.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_l"))), lambda x: x["_l"]), " · ").alias("langs"))


def clean_overview(rows: DataFrame, *, book: str, json: str) -> DataFrame:
    """Overview fields without empty topics, terms without a name, must-reads without a page, digests without body."""
    o = F.from_json(json, OVERVIEW)
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return rows.select(
        book,
        F.filter(o["key_topics"], filled).alias("topics"),
        F.filter(o["key_terms"], lambda t: filled(t["term"])).alias("terms"),
        F.filter(o["must_read_pages"], lambda m: m["page"].isNotNull()).alias("must_read"),
        F.filter(o["chapter_digests"], lambda d: filled(d["body"])).alias("digests"),
    )


def table_cells(rows: DataFrame, *, id: str, json: str) -> DataFrame:
    """(id, row, col, header, value) of a table payload."""
    t = F.from_json(json, TABLE)
    flat = rows.select(id, t.alias("t")).select(id, "t.headers", F.posexplode("t.rows").alias("row", "cells"))
    return flat.select(id, "row", "headers", F.posexplode("cells").alias("col", "value")).select(id, "row", "col", F.get("headers", F.col("col")).alias("header"), "value")


def publish_gate(books: DataFrame, *, cards: str, overview: str, digests: str, panel: str, code: str, least: int = 40) -> DataFrame:
    """books with the checks a published book passes."""
    full = F.forall(digests, lambda d: (F.trim(F.coalesce(d["title"], F.lit(""))) != "") & (F.trim(F.coalesce(d["body"], F.lit(""))) != ""))
    checks = {"enough_cards": F.col(cards) >= least, "has_overview": F.trim(F.coalesce(overview, F.lit(""))) != "", "full_digests": full, "code_there": ~F.col(panel) | F.col(code)}
    out = books.select("*", *(c.alias(n) for n, c in checks.items()))
    return out.withColumn("published", F.col("enough_cards") & F.col("has_overview") & F.col("full_digests") & F.col("code_there"))

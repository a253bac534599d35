"""Chapters: the chapter and section tree, texts and pages of chapters, located starts, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import chapter_id, normal_title, without_tags
from pagemill.operators.folds import walk_in_order
from pagemill.operators.ordered import keep_first
from pagemill.sources.storage import stored

#: Labels of the tree, lengths of texts, gates on located chapters, title length.
OTHER, ALL_PAGES, POINTS = "기타", "전체 페이지", " / 핵심: "
CHAPTER_CHARS, HEAD_CHARS, TITLE_CHARS, LONG_TITLE = 6000, 400, 4, 40
#: Books of up to so many titles compare each of them with their pages; others go by grams.
FEW_TITLES = 32
SPREAD_LEAST, FIRST_MOST, COVER_FIRST, COVER_HOLES = 0.30, 0.6, 2, 2


def chapter_rows(pages: DataFrame, *, book: str, page: str, section: str, title: str) -> DataFrame:
    """Pages placed in chapters and sections: book, page, chapter_no, chapter, chapter_id, section_no,
    section, label, is_intro. A page is a chapter page (its section id names one), a section page (an
    intro with a dot in its id) or plain. Plain pages open an untitled chapter only as a book's first
    page; section pages before any chapter are left out, and a book without chapters is one of all pages."""
    sid = F.coalesce(F.col(section), F.lit(""))
    w = W.partitionBy("book").orderBy("page")
    chapter = (sid.contains("장") & ~sid.contains(".")) | sid.contains("Part") | sid.contains("part")
    sect = ~chapter & F.col(title).isNotNull() & sid.contains(".")
    kind = F.when(chapter, "C").when(sect, "S").otherwise("P")
    rows = pages.select(F.col(book).alias("book"), F.col(page).alias("page"), sid.alias("sid"), F.col(title).alias("title"), kind.alias("kind"))
    before = F.lag("kind").over(w)
    opens = (F.col("kind") == "C") | ((F.col("kind") == "P") & before.isNull())
    starts = (F.col("kind") == "S") | ((F.col("kind") == "P") & (before.isNull() | (before == "C")))
    named = lambda flag, value: F.max_by(F.struct(value.alias("v")), F.when(flag, F.col("page"))).over(w.rowsBetween(W.unboundedPreceding, 0))["v"]
    rows = rows.withColumn("opens", opens).withColumn("starts", starts)
    rows = rows.withColumn("chapter_no", F.sum(F.col("opens").cast("int")).over(w)).withColumn("section_no", F.sum(F.col("starts").cast("int")).over(w)).withColumn("any", F.max(F.col("opens").cast("int")).over(W.partitionBy("book")))
    chapter_title = F.when(F.col("kind") == "C", F.coalesce(F.nullif("title", F.lit("")), "sid")).otherwise(F.col("sid"))
    section_title = F.when(F.col("kind") == "S", F.coalesce(F.nullif("title", F.lit("")), "sid")).otherwise(F.coalesce(F.nullif("sid", F.lit("")), F.lit(OTHER)))
    rows = rows.withColumn("chapter", named(F.col("opens"), chapter_title)).withColumn("chapter_sid", named(F.col("opens"), F.when(F.col("kind") == "C", F.col("sid")).otherwise(""))).withColumn("section", named(F.col("starts"), section_title))
    number, intro = F.concat(F.lit("p."), F.col("page").cast("string")), F.col("kind") == "C"
    lost = F.col("any") == 0
    return rows.filter(lost | (F.col("chapter_no") > 0)).select(
        "book",
        "page",
        F.when(lost, 1).otherwise(F.col("chapter_no")).cast("bigint").alias("chapter_no"),
        F.when(lost, "").otherwise(F.col("chapter")).alias("chapter"),
        F.when(lost | (F.col("chapter_sid") == ""), "").otherwise(chapter_id(F.col("chapter_sid"), F.col("chapter"))).alias("chapter_id"),
        F.when(lost, 1).when(~intro, F.col("section_no")).cast("bigint").alias("section_no"),
        F.when(lost, ALL_PAGES).when(~intro, F.col("section")).alias("section"),
        F.when(lost, number).otherwise(F.coalesce(F.nullif("sid", F.lit("")), number)).alias("label"),
        (intro & ~lost).alias("is_intro"),
    )


def chapter_tree(rows: DataFrame) -> DataFrame:
    """Nested chapters of each book: array of struct<title, id, sections of struct<title, pages>>. A row
    holds the numbers and labels of all pages of one book, no texts: some ten bytes a page."""
    page = F.struct(F.col("page").alias("num"), "label")
    sections = rows.groupBy("book", "chapter_no", "chapter", "chapter_id", "section_no", "section").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    listed = F.when(F.col("section_no").isNotNull(), F.struct("section_no", F.col("section").alias("title"), "pages"))
    chapters = sections.groupBy("book", "chapter_no", "chapter", "chapter_id").agg(F.array_sort(F.collect_list(listed)).alias("sections"))
    return chapters.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("chapter_no", F.col("chapter").alias("title"), F.col("chapter_id").alias("id"), "sections"))).alias("chapters"))


def flat_tree(tree: DataFrame) -> DataFrame:
    """(book, chapter, section, page, label) of a tree; a section named like its chapter has no title."""
    chapters = tree.select("book", F.explode("chapters").alias("c"))
    sections = chapters.select("book", F.col("c.title").alias("chapter"), F.explode("c.sections").alias("s"))
    pages = sections.select("book", "chapter", F.col("s.title").alias("section"), F.explode("s.pages").alias("p"))
    return pages.select("book", "chapter", F.when(F.col("section") != F.col("chapter"), F.col("section")).alias("section"), F.col("p.num").alias("page"), F.col("p.label").alias("label"))


def chapters_of_pages(pages: DataFrame, chapters: DataFrame, *, front: bool = False) -> DataFrame:
    """pages (book, page, ...) with `num` of the range that holds them; with `front`, pages before the
    first start of a book have number 0; other pages outside the ranges go.

    Ranges of a book must not overlap; where they do, the one that starts last counts. Starts and
    pages are merged in one order of (book, page), and the last start is carried forward: within ranges
    of that order, and to a range from those before it. So nothing is made for ids between start and
    end, and a large book is in many tasks."""
    kinds, names = dict(pages.dtypes), [c for c in pages.columns if c not in ("book", "page")]
    span = F.struct(F.col("num").cast("long").alias("num"), F.col("end").cast("long").alias("end"))
    starts = chapters.select("book", F.col("start").cast("long").alias("page"), F.lit(0).alias("_kind"), span.alias("_span"), *(F.lit(None).cast(kinds[c]).alias(c) for c in names))
    rows = pages.select("book", F.col("page").cast("long").alias("page"), F.lit(1).alias("_kind"), F.lit(None).cast(dict(starts.dtypes)["_span"]).alias("_span"), *names)
    dealt = stored(starts.unionByName(rows).repartitionByRange("book", "page", "_kind").withColumn("_part", F.spark_partition_id()), "merged")
    # A row for each book in each range of the order, with the last start of those before.
    own = F.max_by("_span", F.when(F.col("_kind") == 0, F.struct("page", "_span.num")))
    before = F.last("_own", ignorenulls=True).over(W.partitionBy("book").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    blocks = dealt.groupBy("_part", "book").agg(own.alias("_own")).select(F.col("_part").alias("_p"), F.col("book").alias("_b"), before.alias("_before"))
    here = F.last("_span", ignorenulls=True).over(W.partitionBy("_part", "book").orderBy("page", "_kind", "_span.num").rowsBetween(W.unboundedPreceding, 0))
    met = dealt.join(blocks, (F.col("_part") == F.col("_p")) & F.col("book").eqNullSafe(F.col("_b"))).withColumn("_held", F.coalesce(here, F.col("_before"))).filter("_kind = 1")
    inside = met.filter(F.col("page") <= F.col("_held.end")).withColumn("num", F.col("_held.num"))
    if front:
        first = met.filter(F.col("_held").isNull() & (F.col("page") >= 1)).join(chapters.select("book").distinct(), "book", "left_semi")
        inside = inside.unionByName(first.withColumn("num", F.lit(0).cast("long")))
    return inside.select("book", "page", F.col("num").cast(dict(chapters.dtypes)["num"]).alias("num"), *names)


def chapter_texts(pages: DataFrame, chapters: DataFrame, *, text: str, points: str | None = None, limit: int = CHAPTER_CHARS) -> DataFrame:
    """Text of each chapter: a line for each of its pages in order, cut to limit. A line is the page's label
    and its text without tags, and its points, if it has any, without tags and joined by "; ". Only as
    many pages as can fill the limit are gathered, with the one that the line end before it belongs to."""
    line = F.concat(F.lit("[p."), F.col("page").cast("string"), F.lit("] "), without_tags(F.coalesce(F.col(text), F.lit(""))))
    if points is not None:
        told = F.array_join(F.transform(points, without_tags), "; ", "")
        line = F.concat(line, F.when(F.size(points) > 0, F.concat(F.lit(POINTS), told)).otherwise(""))
    placed = chapters_of_pages(pages.select("book", "page").distinct(), chapters)  # texts stay out of the merge
    lines = pages.select(F.col("book").alias("_book"), F.col("page").cast("long").alias("_page"), line.alias("line")).join(placed, F.col("_book").eqNullSafe(F.col("book")) & (F.col("_page") == F.col("page")))
    used = F.sum(F.length("line") + 1).over(W.partitionBy("book", "num").orderBy("page").rowsBetween(W.unboundedPreceding, -1))
    first = lines.withColumn("_used", F.coalesce(used, F.lit(0))).filter(F.col("_used") <= limit)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.left("line", F.lit(limit)).alias("line")))), lambda p: p["line"]), "\n")
    return first.groupBy("book", "num").agg(F.left(joined, F.lit(limit)).alias("text"))


def pages_in_chapters(chapters: DataFrame) -> DataFrame:
    """(book, num, page) of ranges, where no table of pages is at hand; pages before the first chapter are
    its front matter (num 0). With a table of pages, `chapters_of_pages` does not make any."""
    own = chapters.select("book", "num", F.explode(F.sequence("start", "end")).alias("page"))
    front = chapters.groupBy("book").agg(F.min("start").alias("first")).filter("first > 1")
    return own.union(front.select("book", F.lit(0).alias("num"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("first") - 1)).alias("page")))


def chapter_report(rows: DataFrame) -> DataFrame:
    """Per chapter of `chapter_rows`: its pages, sections and the page that introduces it."""
    return rows.groupBy("book", "chapter_no", "chapter", "chapter_id").agg(F.count("*").alias("pages"), F.countDistinct("section_no").alias("sections"), F.min(F.when(F.col("is_intro"), F.col("page"))).alias("intro_page"))


#: How a page head names its chapter: by number, in English, or as an appendix.
HEADINGS = (r"(?mU)^\s*(?:제\s*)?(\d+)\s*장\b", r"(?iU)\bchapter\s*0*(\d+)\b", r"(?mU)^\s*부록\s*(\d+)\b")


def heading_numbers(text: Column) -> Column:
    """Distinct chapter numbers, as written, in the headings at the top of a page."""
    top = F.left(F.coalesce(text, F.lit("")), F.lit(HEAD_CHARS))
    return F.array_distinct(F.concat(*(F.regexp_extract_all(top, F.lit(p), F.lit(1)) for p in HEADINGS)))


def _grams(text: Column) -> Column:
    """Distinct runs of TITLE_CHARS characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - TITLE_CHARS + 1), lambda i: F.substring(text, i, F.lit(TITLE_CHARS))))


def title_hits(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """(book, pos, page): pages (book, page, text, normalised) that contain a title (book, pos, title,
    normalised). The few titles that most books have are compared with each of the book's pages; a title of
    another book meets pages through the one of its character grams that fewest pages have."""
    long = titles.filter(F.length("title") >= TITLE_CHARS).select("book", "pos", "title")
    sizes = long.groupBy("book").agg(F.count("*").alias("n"))
    few, many = (sizes.filter(c).select("book") for c in (F.col("n") <= FEW_TITLES, F.col("n") > FEW_TITLES))
    direct = pages.join(long.join(few, "book", "left_semi"), "book").filter(F.col("text").contains(F.col("title"))).select("book", "pos", "page")
    rest = title_hits_by_grams(pages.join(many, "book", "left_semi"), long.join(many, "book", "left_semi"))
    return direct.unionByName(rest)


def title_hits_by_grams(pages: DataFrame, long: DataFrame) -> DataFrame:
    """`title_hits` for titles of at least TITLE_CHARS characters, through their rarest grams."""
    of_titles = long.select("book", "pos", F.explode(_grams(F.col("title"))).alias("gram"))
    of_pages = pages.filter(F.length("text") >= TITLE_CHARS).select("book", "page", F.explode(_grams(F.col("text"))).alias("gram"))
    met = stored(of_pages.join(of_titles.select("book", "gram").distinct(), ["book", "gram"], "left_semi"), "grams")
    often = met.groupBy("book", "gram").agg(F.count("*").alias("n"))
    rarest = of_titles.join(often, ["book", "gram"], "left").groupBy("book", "pos").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    near = met.join(rarest, ["book", "gram"]).join(long, ["book", "pos"]).select("book", "pos", "page", "title")
    return near.join(pages, ["book", "page"]).filter(F.col("text").contains(F.col("title"))).select("book", "pos", "page")


def chapter_hits(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """(book, pos, page, score) of pages that may start a chapter: 3 for heading and title, 2 for the
    heading alone, 1 for the title alone. Pages and chapters meet by equal numbers and grams."""
    heads = pages.select("book", "page", F.explode(heading_numbers(F.col("text"))).alias("num"))
    numbered = contents.filter("num > 0").select("book", "pos", F.col("num").cast("string").alias("num"))
    by_head = heads.join(numbered, ["book", "num"]).select("book", "pos", "page", F.lit(2).alias("score"))
    plain = lambda df, c, *more: df.select("book", *more, normal_title(F.col(c)).alias(c))
    by_title = title_hits(plain(pages, "text", "page"), plain(contents, "title", "pos")).withColumn("score", F.lit(1))
    return by_head.unionByName(by_title).groupBy("book", "pos", "page").agg(F.sum("score").cast("int").alias("score"))


def locate_chapters(pages: DataFrame, contents: DataFrame, *, after: int = 0) -> DataFrame:
    """Start page of each chapter of contents (book, pos, num, title) in pages (book, page, text):
    the best-scored, then earliest page at or after the page that follows the last chapter found.
    A chapter that is not found does not move that bound. Hits stream by in order of chapters; of a
    book only the bound and the best page so far are held."""

    def walk(rows):
        book = pos = best = None
        bound = after + 1
        for b, p, page, score in rows:
            if (b, p) != (book, pos):
                if best:
                    yield book, pos, best[1], best[0]
                    bound = best[1] + 1
                if b != book:
                    bound = after + 1
                book, pos, best = b, p, None
            if page >= bound and (best is None or score > best[0]):
                best = (score, page)
        if best:
            yield book, pos, best[1], best[0]

    kinds = dict(contents.dtypes) | dict(pages.select("page").dtypes)
    schema = f"book {kinds['book']}, pos {kinds['pos']}, start {kinds['page']}, score int"
    found = walk_in_order(chapter_hits(pages, contents), by=["book"], order=["pos", "page"], columns=["book", "pos", "page", "score"], schema=schema, walk=walk)
    return found.join(contents.select("book", "pos", "num", "title"), ["book", "pos"]).select("book", "pos", "num", "title", "start", "score")


def good_title(title: Column) -> Column:
    """Is it a title: neither blank nor overlong?"""
    bare = F.trim(F.coalesce(title, F.lit("")))
    return (bare != "") & (F.length(bare) <= LONG_TITLE)


def distinct_contents(contents: DataFrame, *, order: list[str]) -> DataFrame:
    """Contents entries once by number, or by normal title where the number is 0; blank and overlong titles go."""
    good = contents.withColumn("title", F.trim("title")).filter(good_title(F.col("title")))
    key = F.when(F.col("num") > 0, F.concat(F.lit("#"), F.col("num").cast("string"))).otherwise(normal_title(F.col("title")))
    return keep_first(good.withColumn("_key", key), ["book", "_key"], order).drop("_key")


def cover_gate(covers: DataFrame) -> DataFrame:
    """Per book, whether its cover numbers start by 2 and have at most two holes."""
    numbers = F.when(F.col("num") > 0, F.col("num"))
    return covers.groupBy("book").agg(F.min(numbers).alias("lo"), F.max(numbers).alias("hi"), F.count(numbers).alias("n")).select("book", F.coalesce((F.col("lo") <= COVER_FIRST) & (F.col("hi") - F.col("lo") + 1 - F.col("n") <= COVER_HOLES), F.lit(False)).alias("dense"))


def spread_gate(located: DataFrame) -> DataFrame:
    """Per book, whether located starts spread over it (books with one chapter pass)."""
    first, last, end = F.min("start"), F.max("start"), F.max("last_page")
    fine = ((last - first) / end >= SPREAD_LEAST) & (first / end <= FIRST_MOST)
    return located.groupBy("book").agg((fine | (F.count("*") < 2) | (end <= 0)).alias("spread"))


def completeness_gate(located: DataFrame, contents: DataFrame) -> DataFrame:
    """Per book, whether all entries were located and their numbers run on from 1 or less."""
    numbers = F.when(F.col("num") > 0, F.col("num"))
    found = located.groupBy("book").agg(F.count("*").alias("n"), F.min(numbers).alias("lo"), F.max(numbers).alias("hi"), F.count(numbers).alias("k"), F.countDistinct(numbers).alias("d"))
    wanted = contents.groupBy("book").agg(F.count("*").alias("wanted"))
    runs = (F.col("k") == 0) | ((F.col("lo") <= 1) & (F.col("hi") - F.col("lo") + 1 == F.col("k")) & (F.col("k") == F.col("d")))
    return wanted.join(found, "book", "left").select("book", F.coalesce((F.col("n") == F.col("wanted")) & runs, F.lit(False)).alias("complete"))


def choose_strategy(covers: DataFrame, contents: DataFrame) -> DataFrame:
    """Chapters by covers, or by contents for books with under two covers where contents give more."""
    count = lambda df, name: df.groupBy("book").agg(F.count("*").alias(name))
    counts = count(covers, "a").join(count(contents, "b"), "book", "full_outer").select("book", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    chosen = counts.select("book", F.when((F.col("a") < 2) & (F.col("b") > F.col("a")), "contents").otherwise("covers").alias("by"))
    both = covers.withColumn("by", F.lit("covers")).unionByName(contents.withColumn("by", F.lit("contents")))
    return both.join(chosen, ["book", "by"])


#: Keywords of an imprint page and its dates; years that are believed; pages looked at.
IMPRINT, DATE, YEARS, IMPRINT_PAGES = "발행|쇄|판", r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일", (1980, 2035), 6


def publication_dates(pages: DataFrame, *, book: str, page: str, text: str) -> DataFrame:
    """Per book: earliest date on its first imprint pages, and the latest if it is another one."""
    early = pages.withColumn("_n", F.row_number().over(W.partitionBy(book).orderBy(page))).filter((F.col("_n") <= IMPRINT_PAGES) & F.col(text).rlike(IMPRINT))
    dates = early.select(book, F.explode(F.regexp_extract_all(text, F.lit(DATE), F.lit(0))).alias("d"))
    y, m, d = (F.regexp_extract("d", DATE, g).cast("int") for g in (1, 2, 3))
    good = dates.filter(y.between(*YEARS) & m.between(1, 12) & d.between(1, 31)).select(book, F.format_string("%d-%02d-%02d", y, m, d).alias("d"))
    return good.groupBy(book).agg(F.min("d").alias("pub_date"), F.when(F.max("d") != F.min("d"), F.max("d")).alias("revision_date"))

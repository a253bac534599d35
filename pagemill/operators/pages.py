"""Page-quality operators: divider pages, duplicates, dimensions, contamination, code, contents lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.operators import ordered

#: Characters under which a page is a divider; kilobytes under which an image is blank;
#: least width in pixels; share of pages that may be off the main dimension, and how many at least.
DIVIDER_CHARS, BLANK_KB, MIN_WIDTH, OFF_SHARE, OFF_LEAST = 40, 80, 1400, 0.05, 3
#: Sizes of whole screens, which pages do not have.
SCREENS = ("2560x1440", "2560x1600", "1920x1080", "3456x2234")
#: Patterns of source code in two languages.
CODE_PATTERNS = (
    r"Cv2\.|using\s+OpenCvSharp|Console\.|new\s+Mat|videoWriter\.|namespace\s|ColorConversion",
    r"cv2\.|import\s+cv2|import\s+numpy|np\.|def\s+\w+\(|print\(|plt\.",
)
#: Contents lines a dense page has at least, pages looked at; a line of title and page number.
TOC_LINES, TOC_PAGES = 6, 30
TOC_LINE = r"^(.*?)[.·•\s]\s*\d{1,3}\s*$"
#: Chapter markers and contents keywords.
MARKERS = (r"(?:제\s*)?(\d{1,2})\s*장", r"(?i)chapter\s*0*(\d{1,2})", r"부록\s*([A-Ea-e가-힣])")
TOC_WORDS = ("목차", "차례", "contents")


def dense_text(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, r"(?U)\s", "")


def is_divider(text: Column, limit: int | Column = DIVIDER_CHARS) -> Column:
    return F.length(dense_text(F.coalesce(text, F.lit("")))) < limit


def divider_scaffold(pages: DataFrame, *, book: str, page: str, text: str, gap: int = ordered.DIVIDER_GAP) -> DataFrame:
    """Chapter ranges that divider pages lay out: book, num, start, end. A book without divider is one range."""
    marked = pages.select(F.col(book).alias("book"), F.col(page).cast("bigint").alias("page"), is_divider(F.col(text)).alias("divider"))
    kept = ordered.keep_apart(marked.filter("divider").select("book", "page"), ["book"], "page", gap)
    books = marked.groupBy("book").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.bool_or("divider").alias("laid"))
    starts = kept.select("book", F.col("page").alias("start")).union(books.filter(~F.col("laid")).select("book", "first")).join(books.select("book", "last"), "book")
    ended = ordered.range_ends(starts, ["book"], "start", F.col("last"))
    return ordered.renumber(ended, ["book"], ["start"]).select("book", "num", "start", "end")


def contamination(pages: DataFrame, patterns: DataFrame, *, keys: list, text: str) -> DataFrame:
    """pages with the evidence of the first matching pattern: literals in their order, then regular
    expressions. patterns has prio, kind ('literal' or 'regex') and pattern; it is configuration
    of a few dozen rows at most, so it is read into one expression."""
    hit = lambda p: F.col(text).contains(p["pattern"]) if p["kind"] == "literal" else F.col(text).rlike(p["pattern"])
    rows = sorted(patterns.limit(1001).collect(), key=lambda p: (p["kind"] != "literal", p["prio"]))
    if len(rows) > 1000:
        raise ValueError("more than 1000 patterns")
    tests = [F.when(hit(p), F.lit(p["pattern"])) for p in rows]
    return pages.withColumn("evidence", F.coalesce(*tests) if tests else F.lit(None).cast("string")).withColumn("contaminated", F.col("evidence").isNotNull())


def clean_counts(judged: DataFrame) -> DataFrame:
    """One row: pages that are clean and may go on, and pages that are skipped."""
    return judged.agg(F.count_if(~F.col("contaminated")).alias("clean"), F.count_if("contaminated").alias("skipped"))


def code_score(text: Column) -> Column:
    """Matches of code patterns; two or more make a code page."""
    return reduce(lambda a, b: a + b, (F.regexp_count(text, F.lit(p)) for p in CODE_PATTERNS))


def resolution_warnings(width: Column, height: Column, least: int = MIN_WIDTH) -> Column:
    """Warnings about a page image: landscape, low resolution."""
    return F.array_compact(F.array(F.when(width >= height, F.lit("landscape")), F.when(width < least, F.lit("low resolution"))))


def is_blank_image(n_bytes: Column, limit: int | Column = BLANK_KB) -> Column:
    return F.floor(n_bytes / 1024) < limit


def suspect_sizes(images: DataFrame, sizes: DataFrame, *, width: str, height: str) -> DataFrame:
    """images with `suspect`: the size is one of a small table (width, height) of whole screens."""
    known = sizes.select(F.col(width).alias("_w"), F.col(height).alias("_h"), F.lit(True).alias("_known")).distinct()
    out = images.join(F.broadcast(known), (F.col(width) == F.col("_w")) & (F.col(height) == F.col("_h")), "left")
    return out.withColumn("suspect", F.coalesce("_known", F.lit(False))).drop("_w", "_h", "_known")


#: Names of the thresholds that a rules file may set, with the values they have otherwise.
RULES = {"MIN_PAGE_KB": float(BLANK_KB), "DIVIDER_MAX_OCR_CHARS": float(DIVIDER_CHARS), "OFF_DIM_RATIO": OFF_SHARE, "OFF_DIM_MIN": float(OFF_LEAST), "TAIL_MIN_RUN": 2.0, "DIVIDER_MERGE_GAP": float(ordered.DIVIDER_GAP)}


def quality_rules(json: Column) -> Column:
    """struct of the thresholds in RULES, those that a JSON object names replaced; unknown names and
    broken JSON change nothing."""
    given = F.from_json(json, "map<string,string>")
    return F.struct(*(F.coalesce(F.try_element_at(given, F.lit(name)).try_cast("double"), F.lit(value)).alias(name) for name, value in RULES.items()))


def suspect_images(images: DataFrame, *, dim: str, n_bytes: str | None = None, limit: int = BLANK_KB, screens: tuple[str, ...] = SCREENS) -> DataFrame:
    """(..., kind, detail): images of a whole screen's size, and images that are blank by their bytes; an
    image may be both."""
    kb = F.floor(F.col(n_bytes) / 1024) if n_bytes is not None else F.lit(None).cast("long")
    screen = F.when(F.col(dim).isin(*screens), F.struct(F.lit("screen").alias("kind"), F.col(dim).cast("string").alias("detail")))
    blank = F.when(kb < limit, F.struct(F.lit("blank").alias("kind"), F.concat(kb.cast("string"), F.lit("KB")).alias("detail")))
    return images.withColumn("_s", F.explode(F.array_compact(F.array(screen, blank)))).select(*images.columns, "_s.kind", "_s.detail")


def quality_report(images: DataFrame, *, book: str, seq: str, digest: str, dim: str, n_bytes: str | None = None, limit: int = BLANK_KB, screens: tuple[str, ...] = SCREENS) -> DataFrame:
    """Per book: images, distinct digests, duplicate groups and images in them, dimensions with their
    images in order of appearance, the main dimension (most frequent, first seen on ties), images off
    it, images of a screen's size, blank ones, a flag for each thing that is wrong with the first three
    images of it, and whether all is well. Blank images are told by n_bytes, if there is such a column."""
    by_digest = images.groupBy(book, digest).agg(F.count("*").alias("n")).groupBy(book).agg(
        F.sum("n").alias("n_images"), F.count("*").alias("n_distinct"), F.count_if(F.col("n") > 1).alias("dup_groups"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("dup_images")
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", F.col(dim).alias("dim"), "n"))), lambda d: F.concat(d["dim"], F.lit(": "), d["n"].cast("string")))
    by_dim = images.groupBy(book, dim).agg(F.count("*").alias("n"), F.min(seq).alias("first")).groupBy(book).agg(
        F.count("*").alias("n_dims"), F.max_by(dim, F.struct("n", (-F.col("first")).alias("f"))).alias("main_dim"), F.max("n").alias("n_main"), listed.alias("dims")
    )
    place = F.row_number().over(W.partitionBy(book, "kind").orderBy(seq, "detail"))
    found = suspect_images(images.select(book, seq, dim, *([n_bytes] if n_bytes is not None else [])), dim=dim, n_bytes=n_bytes, limit=limit, screens=screens)
    counts = found.groupBy(book, "kind").agg(F.count("*").alias("n"))
    firsts = found.withColumn("_n", place).filter("_n <= 3").groupBy(book, "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.concat(F.col(seq).cast("string"), F.lit(" "), F.col("detail")).alias("t")))), lambda x: x["t"]), ", ").alias("first"))
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    suspects = counts.join(firsts, [book, "kind"]).groupBy(book).agg(pick("screen", "n").alias("n_screen"), pick("screen", "first").alias("_screen"), pick("blank", "n").alias("n_blank"), pick("blank", "first").alias("_blank"))
    off = F.col("n_images") - F.col("n_main")
    many = off > F.greatest(F.lit(float(OFF_LEAST)), F.col("n_images") * OFF_SHARE)
    flags = F.array_compact(
        F.array(
            F.when(F.col("n_screen") > 0, F.concat(F.lit("screen size: "), F.col("n_screen"), F.lit(" images, first "), F.col("_screen"))),
            F.when(F.col("n_blank") > 0, F.concat(F.lit("blank: "), F.col("n_blank"), F.lit(f" images below {limit}KB, first "), F.col("_blank"))),
            F.when(F.col("dup_groups") > 0, F.concat(F.lit("duplicates: "), F.col("dup_images"), F.lit(" images in "), F.col("dup_groups"), F.lit(" groups"))),
            F.when(F.col("many_off"), F.concat(F.lit("off size: "), F.col("n_off"), F.lit(" images off "), F.col("main_dim"))),
        )
    )
    report = by_digest.join(by_dim, book).join(suspects, book, "left").withColumn("n_off", off).withColumn("many_off", many)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return report.withColumn("flags", flags).select(book, "n_images", "n_distinct", "dup_groups", "dup_images", "n_dims", "dims", "main_dim", "n_off", "many_off", zero("n_screen"), zero("n_blank"), "flags", (F.size("flags") == 0).alias("ok"))


def report_text(report: DataFrame, *, book: str) -> DataFrame:
    """One text per book of a quality report: header, distribution of dimensions, and a line for each flag
    or one that says that all is well."""
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("book "), F.col(book), F.lit(": "), F.col("n_images"), F.lit(" images, "), F.col("n_distinct"), F.lit(" distinct, main dimension "), F.col("main_dim")),
        F.concat(F.lit("dimensions: "), F.array_join("dims", ", ")),
        F.when(F.col("ok"), F.lit("ok: no screen sizes, blanks, duplicates or other sizes")).otherwise(F.array_join("flags", "\n")),
    )
    return report.select(book, lines.alias("report"))


def corpus_stats(pages: DataFrame, *, book: str, chars: str) -> DataFrame:
    """Books, pages and characters of a corpus."""
    return pages.agg(F.countDistinct(book).alias("books"), F.count("*").alias("pages"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars"))


def duplicate_groups(pages: DataFrame, *, book: str, page: str, text: str) -> DataFrame:
    """Groups of pages of a book with one content: digest, pages and first page."""
    return pages.groupBy(F.col(book).alias("book"), F.md5(text).alias("digest")).agg(F.count("*").alias("n_pages"), F.min(page).alias("first_page")).filter("n_pages > 1")


def toc_lines(text: Column) -> Column:
    """How many lines of a text are a title followed by a page number."""

    def good(line):
        bare = F.trim(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
        head = F.regexp_replace(F.regexp_extract(bare, "(?U)" + TOC_LINE, 1), r"(?U)^\s+|\s+$", "")
        return (F.length(bare) >= 4) & bare.rlike("(?U)" + TOC_LINE) & (F.length(head) >= 3) & head.rlike("[가-힣A-Za-z]")

    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\R"), good))


def chapter_markers(text: Column) -> Column:
    """Distinct chapter markers of a text: numbers and appendix letters."""
    return reduce(F.array_union, (F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in MARKERS))


def toc_pages(pages: DataFrame, *, book: str, page: str, text: str, min_lines: int = TOC_LINES, scan: int = TOC_PAGES) -> DataFrame:
    """Contents pages of each book: the span of its dense pages if a keyword or three chapter markers
    confirm it, without pages that have under half the lines."""
    scored = pages.select(F.col(book).alias("book"), F.col(page).alias("page"), F.col(text).alias("text"), toc_lines(F.col(text)).alias("score"))
    early = ordered.first_and_last(scored, ["book"], ["page"], scan, 0).filter(F.col("score") >= min_lines)
    word = reduce(lambda a, b: a | b, (F.lower("text").contains(w) for w in TOC_WORDS))
    blocks = early.groupBy("book").agg(F.min("page").alias("lo"), F.max("page").alias("hi"), F.bool_or(word).alias("word"), F.size(F.array_distinct(F.flatten(F.collect_list(chapter_markers(F.col("text")))))).alias("markers")).filter("word or markers >= 3")
    return scored.join(blocks.select("book", "lo", "hi"), "book").filter(F.col("page").between(F.col("lo"), F.col("hi")) & (F.col("score") >= min_lines // 2)).select("book", "page", "score")

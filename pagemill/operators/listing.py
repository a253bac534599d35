"""Files and page numbers: manifests, typed lists, numbers seen, collisions, finished books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import natural_rank

#: Extensions of page images in the order in which their lists are joined.
IMAGE_KINDS = ("png", "jpg", "jpeg", "webp")
#: Fixed value: a page number in a file name.
NUMBER_IN_NAME = r"_(\d{3,4})(?:_|\.|$)"


def _kind(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1))


def files_by_kind(files: DataFrame, *, by: list[str], name: str, then: list[str] = (), kinds: tuple[str, ...] = IMAGE_KINDS, out: str = "place") -> DataFrame:
    """Files of the kinds, numbered within `by`: kind after kind, by name (and then as told) within one.
    Others are left out."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), _kind(F.col(name)))
    ranked = files.withColumn("_rank", rank).filter("_rank > 0")
    return ranked.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy("_rank", name, *then))).drop("_rank")


def upload_manifest(files: DataFrame, *, by: list[str], name: str, content_type: str, then: list[str] = ()) -> DataFrame:
    """Uploaded images with the number and name they are kept under. Numbers are given in natural order
    (and then as told) before other files are left out, which leaves gaps."""
    numbered = files.withColumn("num", F.row_number().over(W.partitionBy(*by).orderBy(*natural_rank(F.coalesce(name, F.lit(""))), *then)))
    kind = _kind(F.col(name))
    image = F.coalesce(F.lower(content_type).startswith("image/"), F.lit(False)) | F.coalesce(kind.isin(*IMAGE_KINDS), F.lit(False))
    extension = F.when(kind.isin("jpg", "jpeg"), ".jpg").when(kind == "webp", ".webp").otherwise(".png")
    return numbered.filter(image).withColumn("file", F.concat(F.format_string("page_%03d", "num"), extension))


def numbers_seen(files: DataFrame, *, by: str, name: str) -> DataFrame:
    """Per key the highest page number in its file names, and how many different ones there are."""
    found = files.select(by, F.explode(F.regexp_extract_all(name, F.lit(NUMBER_IN_NAME), F.lit(1)).cast("array<bigint>")).alias("n"))
    return found.groupBy(by).agg(F.max("n").alias("last"), F.countDistinct("n").alias("n"))


def colliding(pages: DataFrame, *, by: list[str]) -> DataFrame:
    """Keys that several pages have."""
    return pages.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")


def batch_label(first_page: Column) -> Column:
    """Name of a batch: that of its first page."""
    return F.format_string("batch_%03d", first_page)


def merge_report(pages: DataFrame, *, book: str, page: str, chapter: str) -> DataFrame:
    """Per book: pages, first and last page, chapters and the label of its batch."""
    first = F.min(page)
    return pages.groupBy(F.col(book).alias("book")).agg(F.count("*").alias("pages"), first.alias("first"), F.max(page).alias("last"), F.countDistinct(chapter).alias("chapters"), batch_label(first).alias("label"))


def finished_books(indexes: DataFrame, data: DataFrame, *, book: str, pages: str) -> DataFrame:
    """(book, pages, url) of books with an index; pages is 0 where their page data is missing or broken."""
    counted = data.groupBy(book).agg(F.max(F.coalesce(F.size(pages), F.lit(0))).alias("_n"))
    n = F.greatest(F.coalesce("_n", F.lit(0)), F.lit(0)).cast("bigint")
    return indexes.select(book).distinct().join(counted, book, "left").select(book, n.alias("pages"), F.concat(F.lit("books/"), F.col(book), F.lit("/summary/index.html")).alias("url")).orderBy(book)


def added_books(files: DataFrame, *, name: str, slug: Column) -> DataFrame:
    """(name, slug, files): how many files each book that is added brings."""
    return files.groupBy(name, slug.alias("slug")).agg(F.count("*").alias("files"))

"""Sources: page texts, summary batches, image metadata, ledgers, chapter ranges, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.listing import finished_books
from pagemill.operators.reshape import read_pages_data
from pagemill.schemas import CHAPTER, LEDGER, PAGE


def _named(path: Column) -> Column:
    """The path of a file; of one that Spark wrote, the path of its folder, without column names."""
    return F.regexp_replace(F.regexp_replace(path, r"/part-[^/]+$", ""), r"/[A-Za-z_]+=", "/")


def read_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(book, page, text) of files <book>/.../page_NNN.txt."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", _named(F.col("_metadata.file_path")).alias("file"))
    page = F.regexp_extract("file", r"page_(\d+)\.txt$", 1)
    return files.filter(page != "").select(F.regexp_extract("file", r"/([^/]+)/(?:summary/)?(?:ocr_text/)?page_\d+\.txt$", 1).alias("book"), page.cast("int").alias("page"), F.col("value").alias("text"))


def read_batches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Page objects of JSON array files with their file and position, and files that are no arrays.
    Raises ValueError if there is no file or no page at all."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.regexp_extract(_named(F.col("_metadata.file_path")), r"([^/]+)$", 1).alias("file"))
    parsed = files.withColumn("pages", F.from_json(F.when(F.col("value").rlike(r"^\s*\["), F.col("value")), f"array<{PAGE}>"))
    good = parsed.filter("pages is not null").select("file", F.posexplode("pages").alias("pos", "page")).select("file", "pos", "page.*")
    if not files.take(1):
        raise ValueError("no batch file")
    if not good.take(1):
        raise ValueError("no pages")
    return good, parsed.filter("pages is null").select("file")


def read_image_files(spark: SparkSession, path: str) -> DataFrame:
    """(book, file, bytes, digest): raw images of a book, and its page images where it has no raw ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(_named(F.col("path")).alias("path"), F.col("length").alias("bytes"), F.md5("content").alias("digest"))
    named = named.select(F.regexp_extract("path", r"/([^/]+)/(?:source_raws/)?[^/]+$", 1).alias("book"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "bytes", "digest")
    is_raw = F.col("file").startswith("raw_")
    # Contents are read once: which books have raw images is told by the paths.
    with_raw = named.filter(is_raw).select("book").distinct().withColumn("_raw", F.lit(True))
    images = named.filter(is_raw | F.col("file").startswith("page_")).join(with_raw, "book", "left")
    return images.filter(is_raw | F.col("_raw").isNull()).select(named.columns)


def read_page_images(spark: SparkSession, path: str) -> DataFrame:
    """(book, page, file, bytes): numbered page images of a book, and its thumbnails where it has none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(_named(F.col("path")).alias("path"), F.col("length").alias("bytes"))
    pattern = r"/([^/]+)/(thumbs/)?(page_(\d+)\.png)$"
    part = lambda n: F.regexp_extract("path", pattern, n)
    images = files.filter(part(3) != "").select(part(1).alias("book"), part(4).cast("int").alias("page"), part(3).alias("file"), "bytes", (part(2) != "").alias("thumb"))
    whole = images.filter("not thumb")
    return whole.union(images.filter("thumb").join(whole.select("book").distinct(), "book", "left_anti").select(images.columns)).drop("thumb")


def read_finished(spark: SparkSession, path: str) -> DataFrame:
    """(book, pages, url) of the books below a folder that have summary/index.html, sorted."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(_named(F.col("path")).alias("path"))
    book = F.regexp_extract("path", r"/([^/]+)/summary/index\.html$", 1)
    data = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*").select("value", _named(F.col("_metadata.file_path")).alias("path"))
    of = F.regexp_extract("path", r"/([^/]+)/summary/pages_data\.json$", 1)
    return finished_books(listed.select(book.alias("book")).filter("book <> ''"), read_pages_data(data.select(of.alias("book"), F.col("value").alias("json")).filter("book <> ''"), json="json"), book="book", pages="pages")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger lines of five fields or more, in tab-separated files."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).filter("size(p) >= 5")
    names = [field.strip().split(" ") for field in LEDGER.replace("decimal(18,4)", "decimal(18;4)").split(",")]
    return parts.select(*(F.get("p", F.lit(i)).try_cast(kind.replace(";", ",")).alias(name) for i, (name, kind) in enumerate(names)))


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """Chapter ranges of JSON array files, with the file of each."""
    return spark.read.schema(CHAPTER).json(path, multiLine=True, recursiveFileLookup=True).withColumn("file", F.col("_metadata.file_path"))


def read_feed(spark: SparkSession, path: str, *, known: list[str]) -> DataFrame:
    """Feed objects, one a line: known fields as strings, all others in `meta`, or the meta_json that came
    along if there are none. Raises ValueError for a feed without any object."""
    fields = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("m")).filter("m is not null and size(m) > 0")
    if not fields.take(1):
        raise ValueError("the feed is empty")
    extra = F.map_filter("m", lambda k, v: ~k.isin("meta_json", *known))
    meta = F.when(F.size(extra) > 0, F.to_json(extra)).otherwise(F.try_element_at("m", F.lit("meta_json")))
    return fields.select(*(F.try_element_at("m", F.lit(k)).alias(k) for k in known), meta.alias("meta"))

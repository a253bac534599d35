"""Catalogue cards and element statistics from HTML columns, by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import leading_int, squeezed, without_tags


def cards(pages: DataFrame, *, id: str, html: str, block: str, fields: dict[str, str]) -> DataFrame:
    """One row for each block of a page (id, pos) with the first group of each field's pattern; a
    field that is missing is null."""
    found = pages.select(id, F.posexplode(F.regexp_extract_all(html, F.lit(block), F.lit(0))).alias("pos", "card"))
    value = lambda p: F.nullif(squeezed(without_tags(F.regexp_extract("card", p, 1))), F.lit(""))
    return found.select(id, "pos", *(value(p).alias(name) for name, p in fields.items()))


def cards_with_fallback(pages: DataFrame, *, id: str, html: str, first: tuple[str, dict], second: tuple[str, dict]) -> DataFrame:
    """Cards by the first pattern set; pages it finds none on are tried with the second."""
    main = cards(pages, id=id, html=html, block=first[0], fields=first[1]).withColumn("by", F.lit("first"))
    block = F.regexp_count(html, F.lit(first[0]))
    rest = cards(pages.filter(F.coalesce(block, F.lit(0)) == 0), id=id, html=html, block=second[0], fields=second[1]).withColumn("by", F.lit("second"))
    return main.unionByName(rest)


def progress_of(text: Column) -> Column:
    return leading_int(F.coalesce(text, F.lit("")))


def name_histogram(pages: DataFrame, *, html: str, pattern: str, least: int = 5, top: int = 20) -> DataFrame:
    """The most frequent names that a pattern's group finds, at least `least` of each."""
    names = pages.select(F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "name").limit(top)


def long_lists(pages: DataFrame, *, id: str, html: str, least: int = 5, top: int = 10) -> DataFrame:
    """The first list elements of each page with at least `least` items."""
    lists = pages.select(id, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?s)<(?:ul|ol)\b.*?</(?:ul|ol)>"), F.lit(0))).alias("pos", "block"))
    counted = lists.select(id, "pos", F.regexp_count("block", F.lit(r"<li\b")).alias("items")).filter(F.col("items") >= least)
    return counted.withColumn("_n", F.row_number().over(W.partitionBy(id).orderBy("pos"))).filter(F.col("_n") <= top).drop("_n")


def selector_vote(pages: DataFrame, *, html: str, patterns: list[str]) -> DataFrame:
    """Matches of each pattern over all pages (those with any), and whether it won (most, first on ties)."""
    sums = pages.agg(*(F.sum(F.regexp_count(html, F.lit(p))).alias(f"p{i}") for i, p in enumerate(patterns)))
    listed = F.array(*(F.struct(F.lit(i).alias("prio"), F.lit(p).alias("pattern"), F.col(f"p{i}").alias("n")) for i, p in enumerate(patterns)))
    rows = sums.select(F.inline(F.filter(listed, lambda r: r["n"] > 0)))
    best = rows.agg(F.max_by("prio", F.struct("n", (-F.col("prio")).alias("p"))).alias("best"))
    return rows.crossJoin(F.broadcast(best)).select("pattern", "n", (F.col("prio") == F.col("best")).alias("won"))

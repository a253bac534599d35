"""Pixel signatures: hashes, densities, covers and content boxes of already decoded pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.operators.merge import union_if_absent

#: Grey under which a pixel is dark; near-white page; brightness under which a page is looked at.
DARK, WHITE_MEAN, WHITE_DARK, WHITE_SHARE, DIM = 110, 235.0, 120, 0.02, 125.0
#: Colours left out, width of a colour bucket, cover shares and densities, covers by density.
PALE, DEEP, BUCKET, COVER_SHARE, DENSITY, LOWEST = 225, 55, 24, 0.30, (0.0002, 0.010), 25
#: Content pixels by saturation, darkness or whiteness; share of a row or column that has them.
SATURATED, INK, PAPER, BOX_SHARE = 18, 155, 245, 0.30


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def average_hash(values: Column) -> Column:
    """64 bits, one for each value of at least the mean, the first value being the lowest bit."""
    bit = lambda x, i: F.when(x["v"] >= x["m"], F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
    pairs = F.transform(values, lambda v: F.struct(v.alias("v"), mean(values).alias("m")))
    return F.aggregate(F.transform(pairs, bit), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def average_hashes(images: DataFrame, *, values: str, out: str = "hash") -> DataFrame:
    """images with the average hash; the mean is taken once a row."""
    with_mean = images.withColumn("_mean", mean(F.col(values)))
    bits = F.transform(F.col(values), lambda v, i: F.when(v >= F.col("_mean"), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return with_mean.withColumn(out, F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))).drop("_mean")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dark_share(values: Column, below: float = DARK) -> Column:
    return F.size(F.filter(values, lambda v: v < below)) / F.size(values)


def is_near_white(values: Column) -> Column:
    return (mean(values) > WHITE_MEAN) & (dark_share(values, WHITE_DARK) < WHITE_SHARE)


def needs_review(values: Column) -> Column:
    return mean(values) < DIM


def signature_digest(values: Column) -> Column:
    return F.md5(F.array_join(F.transform(values, lambda v: v.cast("string")), ","))


def dominant_colour(pixels: DataFrame, *, image: str) -> DataFrame:
    """Per image of pixels (image, r, g, b): the largest colour bucket's share of all pixels, and its centre."""
    strong = ~((F.least("r", "g", "b") > PALE) | (F.greatest("r", "g", "b") < DEEP))
    centre = [(F.floor(F.col(c) / BUCKET) * BUCKET + BUCKET // 2).alias(c) for c in "rgb"]
    counted = pixels.groupBy(image, F.when(strong, F.struct(*centre)).alias("colour")).agg(F.count("*").alias("n"))
    named = F.when(F.col("colour").isNotNull(), F.struct("n", "colour"))
    per = counted.groupBy(image).agg(F.sum("n").alias("all"), F.max(named).alias("top"))
    return per.select(image, F.coalesce(F.col("top.n") / F.col("all"), F.lit(0.0)).alias("share"), F.col("top.colour").alias("colour"))


def cover_candidates(images: DataFrame, *, book: str, page: str, share: str, density: str) -> DataFrame:
    """Pages that may be covers: of one large colour, or among the LOWEST pages of low text density."""
    color = images.filter(F.col(share) >= COVER_SHARE).select(book, page, F.lit("color").alias("why"))
    place = F.row_number().over(W.partitionBy(book).orderBy(density, page))
    low = images.filter(F.col(density).between(*DENSITY)).withColumn("_n", place).filter(F.col("_n") <= LOWEST).select(book, page, F.lit("low-density").alias("why"))
    return union_if_absent(color, low, keys=[book, page])


def content_box(pixels: DataFrame, *, image: str) -> DataFrame:
    """Per image of pixels (image, x, y, r, g, b): first and last column and row that have content in
    at least BOX_SHARE of their pixels; the whole image where there is none."""
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    kept = ((high - low > SATURATED) | (high < INK) | (low >= PAPER)).cast("int")
    marked = pixels.select(image, "x", "y", kept.alias("k"))

    def edges(axis):
        lines = marked.groupBy(image, axis).agg(F.avg("k").alias("share"))
        good = F.when(F.col("share") >= BOX_SHARE, F.col(axis))
        return lines.groupBy(image).agg(F.min(good).alias(f"{axis}0"), F.max(good).alias(f"{axis}1"), F.min(axis).alias(f"{axis}_lo"), F.max(axis).alias(f"{axis}_hi"))

    both = edges("x").join(edges("y"), image)
    whole = F.col("x0").isNull() | F.col("y0").isNull()
    pick = lambda c, full: F.when(whole, F.col(full)).otherwise(F.col(c)).alias(c)
    return both.select(image, pick("x0", "x_lo"), pick("x1", "x_hi"), pick("y0", "y_lo"), pick("y1", "y_hi"))

"""Operators on ordered pages: keep-first, ranges, runs, tails, links and greedy thinning.

Each takes a DataFrame, the columns that name a book (or any other sequence) and the order
inside it. Window forms and greedy folds stream through sorted partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.operators.folds import flag_in_order
from pagemill.sources.storage import stored

#: Pages two dividers must be apart by more than; bits two kept frames must differ by
#: more than; most frames kept; mean grey difference under which two pages are the same.
DIVIDER_GAP, FRAME_BITS, FRAME_CAP, SAME_PAGE = 2, 8, 3000, 4.0


def _over(by, order):
    return W.partitionBy(*by).orderBy(*order)


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(_over(keys, order))).filter("_n = 1").drop("_n")


def keep_newest(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The last row of each key in the given order."""
    return keep_first(df, keys, [F.desc(c) if isinstance(c, str) else c.desc() for c in order])


def first_and_last(df: DataFrame, by: list, order: list, first: int, last: int) -> DataFrame:
    """The first and the last few rows of each sequence, each row once."""
    down = [F.desc(c) for c in order]
    return df.withColumn("_a", F.row_number().over(_over(by, order))).withColumn("_z", F.row_number().over(_over(by, down))).filter((F.col("_a") <= first) | (F.col("_z") <= last)).drop("_a", "_z")


def range_ends(df: DataFrame, by: list, start: str, last: Column, out: str = "end") -> DataFrame:
    """End of each range: one before the next start, and `last` for the last range."""
    return df.withColumn(out, F.coalesce(F.lead(start).over(_over(by, [start])) - 1, last))


def drop_regressions(df: DataFrame, by: list, order: list, num: str) -> DataFrame:
    """Drops rows whose positive number is not above every earlier one; number 0 passes."""
    before = F.max(num).over(_over(by, order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("_max", F.coalesce(before, F.lit(0))).filter((F.col(num) == 0) | (F.col(num) > F.col("_max"))).drop("_max")


def renumber(df: DataFrame, by: list, order: list, out: str = "num") -> DataFrame:
    """1..N in order."""
    return df.withColumn(out, F.row_number().over(_over(by, order)))


def place_overall(df: DataFrame, order: list, out: str = "place") -> DataFrame:
    """1..N over the whole table: rows are dealt to ranges of the order, numbered within each, and raised
    by the rows of the ranges before. order has to be unique for a defined result."""
    part, first = "_part", "_first"
    dealt = stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")  # stored: sampled ranges differ from run to run
    sizes = dealt.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    firsts = sizes.select(part, before.alias(first))
    numbered = dealt.withColumn(out, F.row_number().over(_over([part], order)))
    return numbered.join(F.broadcast(firsts), part).withColumn(out, F.col(out) + F.col(first)).drop(part, first)


def number_or_position(df: DataFrame, by: list, order: list, num: str) -> DataFrame:
    """The number, or the position where it is zero or missing."""
    return df.withColumn(num, F.coalesce(F.nullif(num, F.lit(0)), F.row_number().over(_over(by, order))))


def keep_apart(df: DataFrame, by: list, order: str, gap: int = DIVIDER_GAP) -> DataFrame:
    """The rows whose order value is more than gap above that of the last row kept."""

    def decide(last, value):
        keep = last is None or value - last > gap
        return keep, value if keep else last

    return flag_in_order(df, by=by, order=[order], values=[F.col(order)], decide=decide, out="_keep").filter("_keep").drop("_keep")


def distinct_frames(df: DataFrame, by: list, order: str, hash: str, bits: int = FRAME_BITS, cap: int | None = None) -> DataFrame:
    """The frames whose hash differs by more than bits from that of the last frame kept. cap is the most
    frames kept of one sequence, None for all; FRAME_CAP is that of a video."""

    def decide(state, value):
        last, kept = state or (None, 0)
        keep = (last is None or ((value ^ last) & 0xFFFFFFFFFFFFFFFF).bit_count() > bits) and (cap is None or kept < cap)
        return keep, (value, kept + 1) if keep else (last, kept)

    return flag_in_order(df, by=by, order=[order], values=[F.col(hash)], decide=decide, out="_keep").filter("_keep").drop("_keep")


def take_until_repeat(df: DataFrame, by: list, order: list, value: str) -> DataFrame:
    """Rows before the first one equal to its predecessor."""
    same = F.coalesce((F.col(value) == F.lag(value).over(_over(by, order))).cast("int"), F.lit(0))
    return df.withColumn("_same", same).withColumn("_stop", F.sum("_same").over(_over(by, order))).filter("_stop = 0").drop("_same", "_stop")


def take_until_error(df: DataFrame, by: list, order: list, failed: Column) -> DataFrame:
    """Rows up to and including the first failed one."""
    before = F.sum(failed.cast("int")).over(_over(by, order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("_failed", F.coalesce(before, F.lit(0))).filter("_failed = 0").drop("_failed")


def runs(df: DataFrame, by: list, order: list, value: str) -> DataFrame:
    """Adds run (number of the run of equal values) and nth (place in it, from 0)."""
    w = _over(by, order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    marked = df.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(changed)).withColumn("run", F.sum("_new").over(w)).drop("_new")
    return marked.withColumn("nth", F.row_number().over(_over([*by, "run"], order)) - 1)


def take_until_kth_repeat(df: DataFrame, by: list, order: list, value: str, k: int = 2) -> DataFrame:
    """Distinct neighbours up to the place where a value has been repeated k times in a row."""
    marked = runs(df, by, order, value).withColumn("_stop", F.sum((F.col("nth") >= k).cast("int")).over(_over(by, order)))
    return marked.filter("_stop = 0 and nth = 0").drop("_stop", "run", "nth")


def stable_runs(df: DataFrame, by: list, order: list, value: str, k: int = 3) -> DataFrame:
    """Where runs of at least k equal values start: by, value, start, length."""
    found = runs(df, by, order, value).groupBy(*by, "run").agg(F.min_by(value, order[0]).alias(value), F.min(order[0]).alias("start"), F.count("*").alias("length"))
    return found.filter(F.col("length") >= k).drop("run")


def trim_tail(df: DataFrame, by: list, order: str, value: str, min_run: int = 2) -> DataFrame:
    """Per sequence: length of the run of equal values at the end, how many rows of it go, the last
    row kept and the rows trimmed. min_run under 2 would trim whole sequences and is refused."""
    if min_run < 2:
        raise ValueError("min_run is 2 at least")
    newest = F.max("run").over(W.partitionBy(*by))
    tail = runs(df, by, [order], value).withColumn("_last", newest).filter("run = _last")
    per = tail.groupBy(*by).agg(F.count("*").alias("tail_run"), F.array_sort(F.collect_list(order)).alias("_rows"))
    cut = F.col("tail_run") >= min_run
    return per.select(
        *by,
        "tail_run",
        F.when(cut, F.col("tail_run") - 1).otherwise(F.lit(0)).cast("bigint").alias("trimmed"),
        F.when(cut, F.col("_rows")[0]).otherwise(F.element_at("_rows", -1)).alias("last_kept"),
        F.when(cut, F.slice("_rows", F.lit(2), F.greatest(F.size("_rows") - 1, F.lit(1)))).otherwise(F.slice("_rows", 1, 0)).alias("rows"),
    )


def neighbours(df: DataFrame, by: list, order: str) -> DataFrame:
    """Adds the previous and the next value of the order column."""
    w = _over(by, [order])
    return df.withColumn("prev", F.lag(order).over(w)).withColumn("next", F.lead(order).over(w))


def running_sum(df: DataFrame, by: list, order: list, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(_over(by, order).rowsBetween(W.unboundedPreceding, 0)))


def flag_runs(df: DataFrame, by: list, order: str, flag: Column, gap: int = 0) -> DataFrame:
    """Runs of rows with a set flag as (start, end), joining runs at most gap apart."""
    w = _over(by, [order])
    marked = df.filter(flag).withColumn("_new", F.coalesce((F.col(order) - F.lag(order).over(w) > gap + 1).cast("int"), F.lit(1)))
    return marked.withColumn("_run", F.sum("_new").over(w)).groupBy(*by, "_run").agg(F.min(order).alias("start"), F.max(order).alias("end")).drop("_run")


def same_as_previous(df: DataFrame, by: list, order: str, signature: str, limit: float = SAME_PAGE) -> DataFrame:
    """Adds the mean absolute difference to the previous signature, and whether it counts as the same page."""
    before = F.lag(signature).over(_over(by, [order]))
    diff = F.aggregate(F.zip_with(signature, before, lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(signature)
    return df.withColumn("diff", diff).withColumn("same", F.coalesce(F.col("diff") < limit, F.lit(False)))


def crawl_new(df: DataFrame, key: Column, order: list) -> DataFrame:
    """Adds is_new: the first occurrence of a key over all crawled pages."""
    return df.withColumn("is_new", F.row_number().over(W.partitionBy(key).orderBy(*order)) == 1)


def crawl_stop(counts: DataFrame, by: list, page: str, added: str, empty: int = 3) -> DataFrame:
    """Pages up to the place where `empty` pages in a row added nothing."""
    flagged = counts.withColumn("_none", F.col(added) == 0)
    marked = runs(flagged, by, [page], "_none").withColumn("_hit", (F.col("_none") & (F.col("nth") >= empty)).cast("int"))
    return marked.withColumn("_stop", F.sum("_hit").over(_over(by, [page]))).filter("_stop = 0").drop("_none", "run", "nth", "_hit", "_stop")

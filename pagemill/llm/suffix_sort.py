"""Suffix sort by a difference cover, of many sequences of symbols that are spread over a cluster.

Rows are (seq, k, symbol): symbol k of a sequence, k from 0 on; symbols are positive, and what follows
the end of a sequence counts as 0. Places with k mod 3 of 1 or 2 are the sample: a difference cover,
as of any two places one offset of 0, 1 or 2 leads to the sample from both.

1. The sampled triples are sorted and named by their ranks (`named`).
2. The names are a string over the sample again, of which triples are named in turn, each round three
   times as deep, until names reach as deep as is asked. After WHOLE_ROUNDS rounds only sequences with places
   whose names are not deep enough yet go on, so a few of very short symbols cost the others nothing.
3. The remaining suffixes take part through the offset that a pair of classes has in common: places of
   classes 0 and 1 are sorted by their symbol and the name after it, those of 0 and 2 by two symbols
   and the name after them, those of 1 and 2 by their names (`neighbours`).

Names are ranks among distinct rows, which are counted before they are moved; so a triple that very
many places have is one row when it is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import dropped, stored


def in_ranges(distinct: DataFrame, order: list[str], used: list[DataFrame]) -> DataFrame:
    """distinct, dealt to ranges of an order (column _part); stored, as sampled ranges differ from run to
    run. used gets the stored table, for deleting it when what is made of it is stored in turn."""
    used.append(stored(distinct.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges"))
    return used[-1]


def ranks(distinct: DataFrame, out: str, used: list[DataFrame]) -> DataFrame:
    """distinct rows with their place, from 1, in the order of all their columns."""
    columns = distinct.columns
    dealt = in_ranges(distinct, columns, used)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))  # a row a range
    within = F.row_number().over(W.partitionBy("_part").orderBy(*columns))
    return dealt.withColumn(out, within).join(F.broadcast(first), "_part").select(*columns, (F.col(out) + F.col("_first")).alias(out))


def equal_to_next(distinct: DataFrame, order: list[str], same: list[str], used: list[DataFrame]) -> DataFrame:
    """distinct with `_met`: are the columns `same` those of the next row in the order, also where that is
    the first row of the next range?"""
    dealt, row = in_ranges(distinct, order, used), F.struct(*order)
    heads = dealt.groupBy("_part").agg(F.min(row).alias("_head"))
    behind = heads.select("_part", F.lead("_head").over(W.orderBy("_part")).alias("_behind"))  # a row a range
    near = F.coalesce(F.lead(row).over(W.partitionBy("_part").orderBy(*order)), F.col("_behind"))
    ahead = dealt.join(F.broadcast(behind), "_part").withColumn("_next", near)
    equal = F.lit(True)
    for c in same:
        equal = equal & (F.col(c) == F.col("_next")[c])
    return ahead.withColumn("_met", F.coalesce(equal, F.lit(False))).drop("_part", "_behind", "_next")


def named(rows: DataFrame, keys: list[str], out: str, used: list[DataFrame]) -> DataFrame:
    """rows with the rank of their keys among all distinct ones, for the keys, and `_least`, the least
    `_reach` of places of that name. Names are hashed, as there are fewer of them than rows; neither side
    is sorted."""
    distinct = rows.groupBy(keys).agg(F.min("_reach").alias("_least"))
    return rows.join(ranks(distinct, out, used).hint("shuffle_hash"), keys).drop(*keys)


def _after(column: str, n: int) -> Column:
    return F.coalesce(F.lead(column, n).over(W.partitionBy(*SEQ).orderBy("k")), F.lit(0))


#: Columns that name a sequence.
SEQ = ("uid", "part")


#: Rounds that name all places of the sample; later ones only name those that are not deep enough.
WHOLE_ROUNDS = 2


def sample_names(rows: DataFrame, *, depth: int) -> DataFrame:
    """rows (uid, part, k, pos, symbol, ...) with `name` at places of the sample (null elsewhere): names
    are in the order of suffixes and differ for suffixes that differ within depth of their place; pos
    says how far a place is along its sequence."""
    step, column, columns, n = 1, "symbol", rows.columns, 0
    while True:
        used: list[DataFrame] = []
        near = stored(_triples(rows, columns, column, step), "triples")
        rest = near.filter("k % 3 = 0").select(*columns, F.lit(None).cast("bigint").alias("name"), F.lit(None).cast("bigint").alias("_least"))
        told = named(near.filter("k % 3 <> 0"), ["_x", "_y", "_z"], "name", used).select(*columns, F.col("name").cast("bigint").alias("name"), F.col("_least").cast("bigint").alias("_least"))
        before, rows = rows, stored(told.unionByName(rest), "suffixes")
        dropped(near, *used, *([before] if column == "name" else []))
        n, step, column = n + 1, 3 * step, "name"
        if not rows.filter(F.col("_least") < depth).select("_least").take(1):
            out = rows.drop("_least")
            out.stored_in = rows.stored_in
            return out
        if n >= WHOLE_ROUNDS and (finer := _refined(rows, columns, step, depth)) is not None:
            dropped(rows)
            return finer


def _triples(rows: DataFrame, columns: list[str], column: str, step: int, *more: str) -> DataFrame:
    """Three symbols or names from each place, and how far they reach."""
    reach = F.lead("pos", 3 * step).over(W.partitionBy(*SEQ).orderBy("k")) - F.col("pos")
    return rows.select(*columns, *more, F.col(column).alias("_x"), _after(column, step).alias("_y"), _after(column, 2 * step).alias("_z"), reach.alias("_reach"))


def _refined(rows: DataFrame, columns: list[str], step: int, depth: int) -> DataFrame | None:
    """rows, as a whole round leaves them, with names that are deep enough: places whose names are not are
    named anew, in order within their old name, which needs their sequences only. A round leaves apart the
    sequences without such places, whose rows are not read again before the end. A new name is the
    old one, moved by some bits, and the place in that order; all other names are moved at the end.
    None if that does not fit: then another whole round follows."""
    shallow = (F.col("k") % 3 != 0) & (F.col("_least") < depth)
    going_on = F.coalesce(F.max(shallow).over(W.partitionBy(*SEQ).orderBy("k").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(False)).alias("_open")
    largest, moved, some, apart = rows.agg(F.max("name")).first()[0], 0, rows, []
    while some.filter(shallow).select("k").take(1):
        used: list[DataFrame] = []
        near = _triples(some, columns, "name", step, "_least", going_on)
        near = stored(near.select(*columns, "_least", "_open", "_x", *(F.when(F.col("_open"), F.col(c)).alias(c) for c in ("_y", "_z", "_reach"))), "triples")
        apart.append((near, moved))
        dropped(*([] if some is rows else [some]))
        placed = ranks(near.filter(shallow).groupBy("_x", "_y", "_z").agg(F.min("_reach").alias("_new")), "_place", used)
        finer = stored(placed.withColumn("_place", F.col("_place") - F.min("_place").over(W.partitionBy("_x")) + 1), "finer")
        bits = int(finer.agg(F.max("_place")).first()[0]).bit_length()
        dropped(*used)
        if largest.bit_length() + moved + bits > 62:
            dropped(finer, *(t for t, _ in apart))
            return None
        moved += bits
        told = near.filter(shallow).join(finer.hint("shuffle_hash"), ["_x", "_y", "_z"]).select(*columns, (F.shiftleft("_x", bits) + F.col("_place")).alias("name"), F.col("_new").cast("bigint").alias("_least"))
        rest = near.filter("_open").filter(~F.coalesce(shallow, F.lit(False))).select(*columns, F.shiftleft("_x", bits).alias("name"), "_least")
        some = stored(told.unionByName(rest), "some")
        dropped(finer)
        step *= 3
    out = some.select(*columns, "name")
    for near, then in apart:
        out = out.unionByName(near.filter("not _open").select(*columns, F.shiftleft("_x", moved - then).alias("name")))
    out = stored(out, "suffixes")
    dropped(some, *(t for t, _ in apart))
    return out


def neighbours(rows: DataFrame, value: str) -> DataFrame:
    """(value): the values that two places next to each other in the order of suffixes have in common.
    rows (uid, part, k, symbol, name, value) are as sample_names leaves them; places without value have no say."""
    ahead = rows.withColumn("_s1", _after("symbol", 1)).withColumn("_n1", _after("name", 1)).withColumn("_n2", _after("name", 2)).filter(F.col(value).isNotNull())
    ahead = stored(ahead.select("symbol", "_s1", "_n1", "_n2", "name", (F.col("k") % 3).alias("_class"), value), "merge")
    none, used = F.lit(0).cast("bigint"), [ahead]
    lists = (
        ("_class <> 2", [F.col("_n1").cast("bigint"), none]),
        ("_class <> 1", [F.col("_s1").cast("bigint"), F.col("_n2").cast("bigint")]),
        ("_class <> 0", [F.col("name"), none]),
    )
    found = None
    for classes, (a, b) in lists:
        # equal places are one row with a count; the rest is compared with the next one in order
        one = ahead.filter(classes).groupBy("symbol", a.alias("_a"), b.alias("_b"), value).agg(F.count("*").alias("_n"))
        same = equal_to_next(one, ["symbol", "_a", "_b", value], ["symbol", value], used).filter("_n > 1 or _met").select(value)
        found = same if found is None else found.union(same)
    twice = stored(found.distinct(), "neighbours")
    dropped(*used)
    return twice

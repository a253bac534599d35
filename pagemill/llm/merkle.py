"""Merkle manifest of a dataset: a root over all rows, and a proof of each row.

Rows are leaves. Within a group (a source) leaves stand in order of their id, and every FANOUT
consecutive nodes become one, until one is left: the group's subroot. Subroots, in order of the
group, become the root in the same way. A level is one pivot: rows of nodes become rows of
parents with a column for each slot, filled by conditional aggregates; the columns one after the
other are what a parent hashes, and all but the own one are a child's siblings. Pivots go up
once, level by level, and are stored; paths go down through them, so that a path above a parent
is carried once for all its children. All keys are (group, place), so a group that holds most
rows is spread like any other.

Defined results: a null group comes first and is a group of its own; rows without id come
first in their group; rows of one id stand in order of their leaves (equal rows have equal
leaves); a null value and an empty text hash differently; a group of one leaf has it as its
subroot, a single subroot is the root; an empty table gives an empty manifest. Texts are hashed
whole. Columns that are not named take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import dropped, stored

#: Fixed value: consecutive nodes that become one.
FANOUT = 3
#: Fixed values of the contract: columns of a leaf, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left string, right string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(*values: Column) -> Column:
    """Digest of a row: `-` for null, else number of UTF-8 bytes, colon and value."""
    texts = [v.cast("string") for v in values]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def fold_path(leaf: Column, path: Column) -> Column:
    """Root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, step: digest(step["left"], h, step["right"]))


def path_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "").cast("binary"), 256)


def _placed(rows: DataFrame) -> DataFrame:
    """(g, pos, n, hash, more) of rows (family, id, hash, more): `g` is the first place of their family
    in the order of all, `pos` the place within it from 0, `n` its rows. Ranges of the whole order are
    numbered each by itself and raised by what stands before, so no family is in one task."""
    order = [F.col(c).asc_nulls_first() for c in ("family", "id", "hash", "row")]
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = stored(ranged.select("*", F.spark_partition_id().alias("part"), within.alias("i")), "leaves")
    blocks = dealt.groupBy("part", "family").agg(F.min("i").alias("low"), F.count("*").alias("size"))
    parts = blocks.groupBy("part").agg(F.sum("size").alias("size"))  # a row a range
    before = parts.select("part", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    blocks = blocks.join(before, "part").select("part", "family", "before", (F.col("before") + F.col("low")).alias("first"), "size")
    families = blocks.groupBy("family").agg(F.min("first").alias("g"), F.sum("size").alias("n"))
    known = blocks.alias("b").join(families.alias("f"), F.col("b.family").eqNullSafe(F.col("f.family"))).select("b.part", F.col("b.family").alias("of"), "b.before", "f.g", "f.n")
    joined = dealt.join(known.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col("family").eqNullSafe(F.col("of")))
    placed = stored(joined.select("g", (F.col("i") + F.col("before") - F.col("g")).alias("pos"), "n", "hash", "more"), "placed")
    dropped(dealt)
    return placed


class _Trees:
    """The trees of placed leaves: pivots by level, stored, as high as the largest tree."""

    def __init__(self, leaves: DataFrame, fanout: int):
        self.leaves, self.fanout, self.pivots = leaves, fanout, []
        most = leaves.agg(F.max("n")).first()[0] or 0
        nodes = leaves
        while most > 1:
            level = len(self.pivots)
            child = F.struct("hash", "more") if level == 0 else F.struct("hash")
            slots = [F.max(F.when(F.col("pos") % fanout == k, child)).alias(f"c{k}") for k in range(fanout)]
            pivot = nodes.filter("n > 1").groupBy("g", F.floor(F.col("pos") / fanout).alias("parent")).agg(*slots, F.max("n").alias("n"))
            self.pivots.append(stored(pivot, "pivot"))
            nodes, most = self.parents(level), -(-most // fanout)

    def parents(self, level: int) -> DataFrame:
        together = digest(*(F.coalesce(F.col(f"c{k}.hash"), F.lit("")) for k in range(self.fanout)))
        return self.pivots[level].select("g", F.col("parent").alias("pos"), F.ceil(F.col("n") / self.fanout).alias("n"), together.alias("hash"))

    def ends(self) -> DataFrame:
        """(g, hash, height): the node at which each tree ends, and its level."""
        found = self.leaves.filter("n = 1").select("g", "hash", F.lit(0).alias("height"))
        for level in range(len(self.pivots)):
            found = found.union(self.parents(level).filter("n = 1").select("g", "hash", F.lit(level + 1).alias("height")))
        return found

    def paths(self, above: DataFrame) -> DataFrame:
        """(hash, more, carried columns of above, path): all leaves with the siblings on their way up.
        above is a stored table of g, height, path, and what to carry down."""
        carried = [c for c in above.columns if c not in ("g", "height", "path")]

        def crowned(level: int) -> DataFrame:
            return above.filter(F.col("height") == level).select("g", F.lit(0).cast("long").alias("pos"), *carried, "path")

        def met(level: int, nodes: DataFrame) -> DataFrame:
            sides, digests = [], [F.coalesce(F.col(f"c{j}.hash"), F.lit("")) for j in range(self.fanout)]
            for k in range(self.fanout):
                step = F.struct(F.concat(F.lit(""), *digests[:k]).alias("left"), F.concat(F.lit(""), *digests[k + 1 :]).alias("right"))
                fields = [F.lit(k).alias("slot"), step.alias("step")] + ([F.col(f"c{k}").alias("leaf")] if level == 0 else [])
                sides.append(F.when(F.col(f"c{k}").isNotNull(), F.struct(*fields)))
            parents = nodes.select("g", F.col("pos").alias("parent"), *carried, "path")
            return self.pivots[level].drop("n").join(parents, ["g", "parent"]).withColumn("at", F.explode(F.array_compact(F.array(*sides)))).withColumn("path", F.concat(F.array("at.step"), "path").cast(_PATH))

        nodes, older = crowned(len(self.pivots)), None
        for level in range(len(self.pivots) - 1, 0, -1):
            nodes = met(level, nodes).select("g", (F.col("parent") * self.fanout + F.col("at.slot")).alias("pos"), *carried, "path").union(crowned(level))
            if level % 4 == 1 and level > 1:  # short plans; a table has few rows beside those of the levels below it
                nodes, before = stored(nodes, "paths"), older
                if before is not None:
                    dropped(before)
                older = nodes
        alone = self.leaves.filter("n = 1").join(above.filter("height = 0"), "g").select("hash", "more", *carried, "path")
        if not self.pivots:
            return alone
        return met(0, nodes).select(F.col("at.leaf.hash").alias("hash"), F.col("at.leaf.more").alias("more"), *carried, "path").union(alone)


def manifest(rows: DataFrame, *, key: str, group: str, columns: tuple[str, ...], fanout: int = FANOUT, also: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, path) of each row; path is an array of (left, right), the digests of
    the siblings on either side at each level up to the root. `also` names more columns of the
    leaves to keep, computed from the rows."""
    also = also or {}
    leaves = rows.select(F.col(group).alias("family"), F.col(key).alias("id"), leaf_of(*map(F.col, columns)).alias("hash"), F.struct(F.col(key).alias("id"), *(c.alias(name) for name, c in also.items())).alias("more"))
    lower = _Trees(_placed(leaves), fanout)
    # The order of families is that of their first places; their subroots are the leaves of one more tree.
    crown = lower.ends().select(F.lit(0).alias("family"), F.col("g").alias("id"), "hash", F.struct(F.col("g").alias("id"), "height").alias("more"))
    upper = _Trees(_placed(crown), fanout)
    root = stored(upper.ends().select("g", "height", F.col("hash").alias("root"), F.array().cast(_PATH).alias("path")), "root")
    above = stored(upper.paths(root).select(F.col("more.id").alias("g"), "more.height", F.col("hash").alias("subroot"), "root", "path"), "above")
    found = lower.paths(above)
    return found.select(F.col("more.id").alias(key), F.col("hash").alias("leaf"), "subroot", "root", "path", *(F.col(f"more.{name}").alias(name) for name in also))


def tamper_report(docs: DataFrame, changed: Column, *, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = LEAF, text: str = "text", fanout: int = FANOUT) -> DataFrame:
    """Manifest of docs against a copy of them whose text is `changed`: (key, leaf, subroot, root,
    proof_sha256, folded_root, verified). A row whose text is the same keeps its leaf; the copy's
    leaf is folded with the original siblings, and equals the root only if nothing has changed."""
    other = leaf_of(*(changed if c == text else F.col(c) for c in columns))
    differs = ~F.col(text).eqNullSafe(changed)
    found = manifest(docs, key=key, group=group, columns=columns, fanout=fanout, also={"seen": F.when(differs, other)})
    folded = fold_path(F.coalesce("seen", "leaf"), F.col("path"))
    out = found.select(key, "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

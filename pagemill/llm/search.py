"""Exact top-k inner products by KD-trees, one per shard.

Space is cut into regions by median splits of a bounded sample, as many as there are shards of
SHARD rows (REGIONS at most; then a region has several shards, by hash). Each shard is one KD-tree:
median splits on the widest axis, a tight bounding box at every node. For a query, a node's
box bounds the best inner product inside it, and nodes are visited best bound first until
the bound falls below the k-th score found. Each query searches the shard of its own vector first;
the k-th score found there goes along with it, and it is dealt to those shards only in whose
region's box its bound reaches that score, before any vector moves. Queries travel in blocks, so a
task holds one tree and one block.

Defined results: vectors that are null, empty or hold null or non-finite components, and
rows without id, take no part; rows of one id are rows of their own, as queries and as
candidates, also of each other; vectors of another dimension are not compared; fewer than k
others give as many; ties go to the smaller id; components and products beyond 64 bits are
worked out exactly, and a score that no long holds is an error; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import dropped, stored

#: Fixed value: results of a query.
TOP = 5
#: Rows of a shard, of a query block, and of a leaf, about.
SHARD, BLOCK, LEAF = 16384, 8192, 128
#: Vectors that the regions are cut by, and regions, at most: what the driver holds and tasks are sent.
SAMPLE, REGIONS = 65_536, 4096


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null for a vector that takes no part."""
    finite = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class KDTree:
    """Nodes in arrays: children of node i (-1: leaf), rows from first to last, and its box."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((rows, ids))
        self.ids, self.rows, self.points = ids[order], rows[order], points[order]
        self.nodes, self.low, self.high = [], [], []
        at = np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)]
        while todo:
            first, last, parent, side = todo.pop()
            rows = self.points[at[first:last]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            me = len(self.nodes)
            self.nodes.append([first, last, -1, -1])
            self.low.append(low)
            self.high.append(high)
            if parent >= 0:
                self.nodes[parent][2 + side] = me
            if last - first > leaf and (high > low).any():
                axis = int(np.argmax(high - low))
                half = (first + last) // 2
                at[first:last] = at[first:last][np.argpartition(rows[:, axis], half - first)]
                todo += [(first, half, me, 0), (half, last, me, 1)]
        self.ids, self.rows, self.points = self.ids[at], self.rows[at], self.points[at]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def search(self, query: np.ndarray, own: int, k: int, least: int | None) -> list[tuple[int, int, int]]:
        """The k best (score, -id, -row) with a score of at least `least`, but for the query's own row."""
        bounds = np.maximum(query * self.low, query * self.high).sum(axis=1)
        found: list[tuple[int, int, int]] = []
        open_nodes = [(-int(bounds[0]), 0)]
        while open_nodes:
            bound, node = heapq.heappop(open_nodes)
            floor = found[0][0] if len(found) == k else least
            if floor is not None and -bound < floor:
                break
            first, last, left, right = self.nodes[node]
            if left >= 0:
                heapq.heappush(open_nodes, (-int(bounds[left]), left))
                heapq.heappush(open_nodes, (-int(bounds[right]), right))
                continue
            scores = self.points[first:last] @ query
            good = np.arange(len(scores)) if floor is None else np.flatnonzero(scores >= floor)
            for i in good.tolist():
                hit = (int(scores[i]), -int(self.ids[first + i]), -int(self.rows[first + i]))
                if -hit[2] == own or least is not None and hit[0] < least:
                    continue
                if len(found) < k:
                    heapq.heappush(found, hit)
                elif hit > found[0]:
                    heapq.heapreplace(found, hit)
        return found


_HITS = pa.schema([(c, pa.int64()) for c in ("query", "vec_id", "row", "score")])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _search_shard(k: int):
    def search(points: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if points.num_rows and queries.num_rows:
            vectors, asked = _matrix(points["v"]), _matrix(queries["v"])
            if np.abs(vectors.astype(float)).max() * np.abs(asked.astype(float)).max() * vectors.shape[1] >= 2.0**62:
                vectors, asked = vectors.astype(object), asked.astype(object)  # whole numbers of any size
            tree = KDTree(points["vec_id"].to_numpy(), points["row"].to_numpy(), vectors)
            for own, query, least in zip(queries["query"].to_pylist(), asked, queries["least"].to_pylist(), strict=True):
                for score, other, row in tree.search(query, own, k, least):
                    for column, value in zip(out, (own, -other, -row, score), strict=True):
                        column.append(value)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_HITS)

    return search


class Regions:
    """Parts of the space by median splits of a sample on the widest axis, each with the box of all vectors in
    it, once these are known. Split i sends a vector below `cut[i]` on `axis[i]` to child 2 * i + 1, others
    to 2 * i + 2; the leaves are the regions."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.axis, self.cut = depth, np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        parts = {0: sample}
        for i in range(2**depth - 1):
            points = parts.pop(i)
            if len(points):
                self.axis[i] = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
                self.cut[i] = float(np.median(points[:, self.axis[i]]))
            left = points[:, self.axis[i]] < self.cut[i]
            parts[2 * i + 1], parts[2 * i + 2] = points[left], points[~left]
        self.low = self.high = None

    def of(self, points: np.ndarray) -> np.ndarray:
        """Region of each vector."""
        at = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (points[np.arange(len(points)), self.axis[at]] >= self.cut[at])
        return at - (2**self.depth - 1)

    def reached(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, region): where the bound of a query's inner products in the box is at least `least`."""
        empty = (self.high < self.low).any(axis=1)
        low, high = np.where(empty[:, None], 0, self.low), np.where(empty[:, None], 0, self.high)
        bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        slack = 1e-9 * (np.abs(queries) @ np.maximum(np.abs(high), np.abs(low)).T)
        return np.nonzero((bound + slack >= least[:, None]) & ~empty)


def _padded(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out, values = np.zeros((len(column), dim)), column.flatten().to_numpy().astype(np.float64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


_BOX = "region long, low array<double>, high array<double>"


def _box(parts: pa.Table) -> pa.Table:
    low, high = (np.array(parts[c].to_pylist()) for c in ("low", "high"))
    return pa.table({"region": parts["region"][:1], "low": pa.array([low.min(axis=0).tolist()]), "high": pa.array([high.max(axis=0).tolist()])})


def _boxes(dim: int):
    def boxes(batches):
        """Box of each region that a task has vectors of."""
        low, high = {}, {}
        for batch in batches:
            points, region = _padded(batch.column("v"), dim), batch.column("region").to_numpy()
            for r in np.unique(region).tolist():
                own = points[region == r]
                low[r] = np.minimum(low[r], own.min(axis=0)) if r in low else own.min(axis=0)
                high[r] = np.maximum(high[r], own.max(axis=0)) if r in high else own.max(axis=0)
        yield pa.RecordBatch.from_pydict({"region": pa.array(list(low), pa.int64()), "low": pa.array([x.tolist() for x in low.values()], pa.list_(pa.float64())), "high": pa.array([x.tolist() for x in high.values()], pa.list_(pa.float64()))})

    return boxes


def top_inner_products(vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = TOP, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best others of each query."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), is_query.alias("asks"), quantised(F.col(vector)).alias("v")).filter("v is not null and vec_id is not null")
    points = stored(rows.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "points")  # stored, so that a row keeps its number
    n, n_queries, dim = points.agg(F.count("*"), F.count(F.when(F.col("asks"), 1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    blocks = n_queries // block + 1
    depth = min(n // shard, REGIONS - 1).bit_length()
    parts = n // (shard << depth) + 1  # of a region; one but for more vectors than REGIONS shards hold
    chosen = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20)) + 1
    regions = Regions(_padded(points.filter(chosen & F.lit(depth > 0)).select("v").toArrow()["v"].combine_chunks(), dim), depth)

    def place(batches):
        for batch in batches:
            region = regions.of(_padded(batch.column("v"), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], names=[*batch.schema.names, "region"])

    placed = stored(points.mapInArrow(place, "vec_id long, asks boolean, v array<long>, dim int, row long, region long").withColumn("shard", F.col("region") * parts + F.pmod(F.xxhash64("row"), F.lit(parts))), "placed")
    dropped(points)
    boxes = placed.select("v", "region").mapInArrow(_boxes(dim), _BOX).groupBy("region").applyInArrow(_box, _BOX)
    regions.low, regions.high = np.full((2**depth, dim), np.inf), np.full((2**depth, dim), -np.inf)
    for r, low, high in boxes.collect():  # a row a region, REGIONS at most
        regions.low[r], regions.high[r] = low, high
    queries = stored(placed.filter("asks").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "v", "dim", F.col("shard").alias("home"), F.pmod(F.xxhash64("row", F.lit(2)), F.lit(blocks)).alias("block")), "queries")
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")

    def search(asked: DataFrame) -> DataFrame:
        """asked: (query, v, dim, shard, block, least). A shard's rows go to each of its blocks."""
        meets = asked.select(F.col("shard").alias("s"), F.col("dim").alias("d"), F.col("block").alias("b")).distinct()
        dealt = placed.join(meets, (F.col("shard") == F.col("s")) & (F.col("dim") == F.col("d"))).select("s", "d", "b", "vec_id", "row", "v")
        return dealt.groupBy("s", "d", "b").cogroup(asked.groupBy("shard", "dim", "block")).applyInArrow(_search_shard(k), "query long, vec_id long, row long, score long")

    def reach(batches):
        """Queries with each shard of the regions where their bound reaches the k-th score they have."""
        for batch in batches:
            least = batch.column("least").cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            at, region = regions.reached(_padded(batch.column("v"), dim), least)
            at, to = np.repeat(at, parts), np.repeat(region, parts) * parts + np.tile(np.arange(parts), len(region))
            other = to != batch.column("home").to_numpy()[at]
            at, to = pa.array(at[other]), pa.array(to[other])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("query", "v", "dim", "block", "least")), to], names=["query", "v", "dim", "block", "least", "shard"])

    at_home = stored(search(queries.withColumn("shard", F.col("home")).withColumn("least", F.lit(None).cast("long"))), "home")
    least = at_home.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query", F.col("score").alias("least"))
    away = queries.join(least, "query", "left").select("query", "v", "dim", "block", "least", "home").mapInArrow(reach, "query long, v array<long>, dim int, block long, least long, shard long")
    found = at_home.union(search(stored(away, "away"))).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.join(queries.select("query", "query_id"), "query").select("query_id", "rank", "vec_id", "score")

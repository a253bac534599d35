"""Approximate nearest neighbours by inner product: an inverted index of balanced posting lists.

Centroids come from halving a bounded sample at the median of its two-means direction, again and
again, so that lists are of like size. Every vector is then put into the list of its nearest
centroid, and a boundary vector into those of other centroids about as near. Centroids are
searched by a graph that a task holds in memory: best first, from a few entries along links to
near centroids, until no open one is within a ratio of the nearest. The same ratio decides which
lists a query reads; it is fitted on the sample, as the least one that finds TARGET of the true
neighbours there. Inner products become distances through one more component, the root of
what a vector's square lacks of the largest.

Lists go to shards of about SHARD postings by their order in the halving, lists above that to
several; queries go to the shards of their lists in blocks, and a shard returns its best for
each. Equal vectors are indexed once, with their TOP + 1 smallest ids: any further copy would be
beaten by these, with the same score and a smaller id. Queries of one vector are searched once.

Scores are sums of products in double precision, left to right, on the vectors as given.

Defined results: vectors that are null, empty, all zero or hold null or non-finite components,
and rows without id, take no part; rows of one id are rows of their own, also of each other;
vectors of another dimension are not compared; ties go to the smaller id; fewer others than k
give as many as there are; an empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import dropped, stored

#: Fixed value: results of a query.
TOP = 20
#: Distinct vectors the index is fitted on at most, vectors of a list about, lists at most: bounds of what the driver holds and tasks are sent.
SAMPLE, LIST, LISTS = 65_536, 128, 4096
#: A vector goes to lists within this ratio of its nearest, and to so many at most.
CLOSURE, COPIES = 1.02, 4
#: Share of true neighbours on the sample that the ratio of the lists read has to find.
TARGET = 0.97
#: Share of the true neighbours of one query that counts as found.
EACH = 0.9
#: Postings of a shard and queries of a block, about.
SHARD, BLOCK = 32_768, 8192
#: Links of a centroid to near ones, and far ones; entries; nodes that a search opens at least.
NEAR, FAR, ENTRIES, BREADTH = 16, 4, 8, 24


def usable(vector: Column) -> Column:
    return (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def halved(points: np.ndarray, size: int, rng) -> np.ndarray:
    """Means of parts of at most `size` points, by halves of equal number; near parts stand near."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        part = points[at]
        if len(at) <= size:
            out.append(part.mean(axis=0))
            continue
        ends = part[rng.choice(len(at), 2, replace=False)]
        for _ in range(4):
            along = part @ (ends[1] - ends[0])
            order = np.argsort(along, kind="stable")
            ends = np.stack([part[order[: len(at) // 2]].mean(axis=0), part[order[len(at) // 2 :]].mean(axis=0)])
        todo += [at[order[len(at) // 2 :]], at[order[: len(at) // 2]]]
    return np.array(out)


class Centroids:
    """Centroids and the graph over them."""

    def __init__(self, points: np.ndarray, lists: int, longest: float, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.dim, self.longest = points.shape[1], longest
        raised = self.raised(points)
        self.at = halved(raised, -(-len(points) // lists), rng).astype(np.float32)
        n = len(self.at)
        ring = np.arange(n)[:, None]
        links = [(ring + 1) % n, (ring - 1) % n, rng.integers(0, n, (n, FAR))]
        near = [np.argsort(((self.at[a : a + 64, None] - self.at[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, : NEAR + 1] for a in range(0, n, 64)]
        self.links = np.concatenate([*links, np.concatenate(near)], axis=1).astype(np.int32)
        self.entries = np.unique(np.linspace(0, n - 1, ENTRIES).astype(int))
        self.ratio = 1.0

    def raised(self, points: np.ndarray) -> np.ndarray:
        """Points with one more component, so that all are of one length."""
        rest = np.sqrt(np.maximum(self.longest**2 - (points**2).sum(axis=1), 0))
        return np.concatenate([points, rest[:, None]], axis=1)

    def near(self, points: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, centroid, distance / least distance) of what the graph finds within the ratio, nearest first."""
        points = points.astype(np.float32)
        far = np.full((len(points), len(self.at)), np.inf, np.float32)
        opened = np.zeros(far.shape, bool)
        breadth = min(BREADTH, len(self.at))
        row, node = np.repeat(np.arange(len(points)), len(self.entries)), np.tile(self.entries, len(points))
        while len(row):
            far[row, node] = np.sqrt(((points[row] - self.at[node]) ** 2).sum(axis=1))
            bound = np.maximum(far.min(axis=1) * ratio, np.partition(far, breadth - 1, axis=1)[:, breadth - 1])
            row, node = np.nonzero((far <= bound[:, None]) & ~opened & (far < np.inf))
            opened[row, node] = True
            pairs = np.unique((row[:, None] * len(self.at) + self.links[node]).ravel())
            pairs = pairs[far.ravel()[pairs] == np.inf]
            row, node = np.divmod(pairs, len(self.at))
        least = np.maximum(far.min(axis=1, keepdims=True), 1e-12)
        row, node = np.nonzero(far <= least * ratio)
        share = (far / least)[row, node]
        order = np.lexsort((node, share, row))
        return row[order], node[order], share[order]

    def postings(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, list) of the lists that hold a point."""
        row, node, _ = self.near(self.raised(points), CLOSURE)
        first = np.searchsorted(row, np.arange(len(points)))
        keep = np.arange(len(row)) - first[row] < COPIES
        return row[keep], node[keep]

    def asked(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, list) of the lists that a query reads. Its one more component is zero: a query's length changes no order."""
        scale = self.longest / np.sqrt((points**2).sum(axis=1, keepdims=True))
        row, node, _ = self.near(np.concatenate([points * scale, np.zeros((len(points), 1))], axis=1), self.ratio)
        return row, node

    def fit_ratio(self, points: np.ndarray, k: int, target: float, n: int = 512, block: int = 64) -> None:
        """Least ratio that finds `target` of the k best others of n of the points, and EACH of those of
        `target` of the n, as points of one region may all be harder to find."""
        if len(points) < 2:
            return
        asks = np.linspace(0, len(points) - 1, min(n, len(points))).astype(int)
        needed = []
        for a in range(0, len(asks), block):
            some = asks[a : a + block]
            scores = points[some] @ points.T
            scores[np.arange(len(some)), some] = -np.inf
            best = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(points) - 1)]
            scale = self.longest / np.sqrt((points[some] ** 2).sum(axis=1, keepdims=True))
            asked = np.concatenate([points[some] * scale, np.zeros((len(some), 1))], axis=1)
            far = np.sqrt(np.maximum((asked**2).sum(axis=1)[:, None] - 2 * asked @ self.at.T + (self.at**2).sum(axis=1), 0))
            far /= np.maximum(far.min(axis=1, keepdims=True), 1e-12)
            wanted, own = np.unique(best, return_inverse=True)
            row, node = self.postings_of(points[wanted])
            starts = np.searchsorted(row, np.arange(len(wanted) + 1))
            needed += [far[i, node[starts[j] : starts[j + 1]]].min() for i, found in enumerate(own.reshape(best.shape)) for j in found]
        needed = np.sort(np.array(needed).reshape(len(asks), -1), axis=1)
        most = needed[:, int(np.ceil(EACH * needed.shape[1])) - 1]
        self.ratio = max(float(np.quantile(needed, target)), float(np.quantile(most, target))) * (1 + 1e-6)

    def postings_of(self, points: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.postings(points[a : a + block]) for a in range(0, len(points), block)]
        return np.concatenate([r + a * block for a, (r, _) in enumerate(parts)]), np.concatenate([n for _, n in parts])


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled up with zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0) if flat.num_chunks else pa.array([], flat.type)
    sizes = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dim).all():
        return values.reshape(len(flat), dim)
    out = np.zeros((len(flat), dim))
    row = np.repeat(np.arange(len(flat)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, summed left to right."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


_HITS = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])


def _sizes(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([chunk.value_lengths().to_numpy() for chunk in column.chunks])


def _search_shard(dim: int, k: int):
    def search(points: pa.Table, queries: pa.Table) -> pa.Table:
        """The k best of each query in its lists of the shard. Products in single precision leave out what is
        surely below the k-th of a list read before; the rest is worked out in double precision."""
        found = [[], [], [], []]
        if points.num_rows and queries.num_rows:
            lists, vectors, numbers = points["list"].to_numpy(), matrix(points["v"], dim), points["vid"].to_numpy()
            members = points["members"].combine_chunks()
            members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
            edges, inner = members.offsets.to_numpy(), members.values
            ids, rows = inner.field("vec_id").to_numpy(), inner.field("row").to_numpy()
            asked, asked_ids = matrix(queries["v"], dim), queries["query"].to_numpy()
            sizes, asked_sizes = _sizes(points["v"]), _sizes(queries["v"])
            mixed = len(np.unique(np.append(sizes, asked_sizes))) > 1
            # Both are brought to lengths of at most 1, which keeps single precision in range.
            longest, lengths = np.sqrt((vectors**2).sum(axis=1).max()), np.sqrt((asked**2).sum(axis=1))
            rough_vectors, rough_asked = (vectors / longest).astype(np.float32), (asked / lengths[:, None]).astype(np.float32)
            margin = np.float32(dim * 2e-7 + 1e-6)
            wants = [np.frombuffer(x, np.int32) for x in queries["lists"].to_pylist()]
            who = np.repeat(np.arange(len(wants)), [len(x) for x in wants])
            wants = np.concatenate(wants)
            by = np.argsort(wants, kind="stable")
            wants, who = wants[by], who[by]
            order = np.argsort(lists, kind="stable")
            names, first = np.unique(lists[order], return_index=True)
            last = np.append(first[1:], len(order))
            least = np.full(len(asked), -np.inf, np.float32)
            hits = []
            for name, a, b in zip(names.tolist(), first.tolist(), last.tolist(), strict=True):
                own = order[a:b]
                lo, hi = np.searchsorted(wants, [name, name + 1])
                for c in range(lo, hi, 1024):
                    some = who[c : min(c + 1024, hi)]
                    rough = rough_asked[some] @ rough_vectors[own].T
                    if mixed:
                        rough[asked_sizes[some][:, None] != sizes[own][None]] = -np.inf
                    if len(own) > k:
                        least[some] = np.maximum(least[some], np.partition(rough, -k, axis=1)[:, -k] - margin)
                    q, p = np.nonzero(rough >= least[some][:, None])
                    hits.append((some[q], own[p], rough[q, p]))
            q, p, rough = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.empty(0, int),) * 3
            keep = (rough >= least[q]) & (rough > -np.inf)
            q, p = q[keep], p[keep]
            if len(q):
                _, which = np.unique(numbers, return_inverse=True)
                _, once = np.unique(q * len(numbers) + which[p], return_index=True)  # a vector may be in several lists
                q, p = q[once], p[once]
                score = _in_order(asked[q], vectors[p])
                many = np.diff(edges)[p]
                at = np.repeat(edges[:-1][p] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                q, score = np.repeat(q, many), np.repeat(score, many)
                by_rank = np.lexsort((rows[at], ids[at], -score, q))
                q, score, at = q[by_rank], score[by_rank], at[by_rank]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                found = [asked_ids[q[keep]], ids[at[keep]], rows[at[keep]], score[keep]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, _HITS, strict=True)], schema=_HITS)

    return search


def fit_centroids(vectors: DataFrame, n: int, dim: int, longest: float, *, vector: str = "v", k: int = TOP, target: float = TARGET, sample: int = SAMPLE, size: int = LIST, lists: int = LISTS) -> Centroids:
    """Centroids, graph and ratio, from about `sample` of the n vectors, which their hashes choose."""
    chosen = F.pmod(F.xxhash64(vector), F.lit(1 << 20)) < int(min(1.0, sample / max(n, 1)) * (1 << 20)) + 1
    points = matrix(vectors.filter(chosen).select(vector).toArrow()[vector], dim)
    points = points[np.lexsort(points.T)]  # in one order, whatever the tasks
    model = Centroids(points, max(1, min(lists, n // size)), longest)
    model.fit_ratio(points, k, target)
    return model


def nearest(vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = TOP, target: float = TARGET, shard: int = SHARD, block: int = BLOCK, **bounds) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query."""
    spark = vectors.sparkSession
    taken = vectors.select(F.col(key).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector).alias("v")).filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    rows = stored(taken.withColumn("row", F.monotonically_increasing_id()), "vectors")  # stored, so that a row keeps its number
    first = F.row_number().over(W.partitionBy("v").orderBy("vec_id", "row"))
    grouped = rows.select("v", "vec_id", "row").withColumn("n", first).filter(F.col("n") <= k + 1)  # limited before the exchange, too
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    units = stored(grouped.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("members")).withColumn("vid", F.monotonically_increasing_id()).withColumn("square", squares), "units")
    n, dim, square = units.agg(F.count("*"), F.max(F.size("v")), F.max("square")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = fit_centroids(units, n, dim, float(square) ** 0.5, k=k, target=target, **bounds)

    def post(batches):
        for batch in batches:
            row, node = model.postings_of(matrix(batch.column("v"), dim))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row)) for c in ("vid", "v", "members")] + [pa.array(node, pa.int32())], names=["vid", "v", "members", "list"])

    kind = dict(units.dtypes)
    postings = stored(units.select("vid", "v", "members").mapInArrow(post, f"vid long, v {kind['v']}, members {kind['members']}, list int"), "postings")
    sizes = np.zeros(len(model.at), np.int64)
    for name, size in postings.groupBy("list").count().collect():  # a row a list, LISTS at most
        sizes[name] = size
    parts = np.maximum(-(-sizes // shard), 1)
    # Lists fill shards in order; one of several parts has shards of its own.
    first_shard, at, used = np.zeros(len(sizes), np.int64), 0, 0
    for i, (size, many) in enumerate(zip(sizes.tolist(), parts.tolist(), strict=True)):
        if used and used + size > shard:
            at, used = at + 1, 0
        first_shard[i] = at
        at, used = (at + many, 0) if many > 1 else (at, used + size)
    plan = F.broadcast(spark.createDataFrame(pa.table({"list": pa.array(np.arange(len(sizes)), pa.int32()), "first": first_shard, "parts": parts})))

    def ask(batches):
        for batch in batches:
            points = matrix(batch.column("v"), dim)
            for a in range(0, len(points), 256):
                row, node = model.asked(points[a : a + 256])
                many = parts[node]
                to = np.repeat(first_shard[node] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                row, node = np.repeat(row, many), np.repeat(node, many)
                order = np.lexsort((node, to, row))
                row, node, to = row[order], node[order].astype(np.int32), to[order]
                start = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (to[1:] != to[:-1]))) if len(row) else np.empty(0, int)
                ends = np.append(start[1:], len(row))
                lists = pa.array([node[s:e].tobytes() for s, e in zip(start.tolist(), ends.tolist(), strict=True)], pa.binary())
                pick = pa.array(a + row[start])
                yield pa.RecordBatch.from_arrays([batch.column("query").take(pick), batch.column("v").take(pick), pa.array(to[start]), lists], names=["query", "v", "shard", "lists"])

    # A query vector goes by the number of its unit.
    asking = rows.filter("asks").select("v", F.col("vec_id").alias("query_id"), F.col("row").alias("own"))
    queries = stored(asking.join(units.select("v", F.col("vid").alias("query")), "v"), "queries")
    distinct = units.join(queries.select(F.col("query").alias("vid")).distinct(), "vid", "left_semi").select(F.col("vid").alias("query"), "v")
    asked = stored(distinct.mapInArrow(ask, f"query long, v {kind['v']}, shard long, lists binary"), "asked")
    load = asked.groupBy("shard").agg((F.count("*") / block).cast("long").alias("more"))
    dealt = postings.join(plan, "list").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vid"), F.col("parts")))
    dealt = dealt.join(load, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "more"))).select("shard", "block", "list", "vid", "v", "members")
    met = asked.join(load, "shard").withColumn("block", F.pmod(F.xxhash64("query"), F.col("more") + 1)).select("shard", "block", "query", "v", "lists")
    hits = dealt.groupBy("shard", "block").cogroup(met.groupBy("shard", "block")).applyInArrow(_search_shard(dim, k + 1), "query long, vec_id long, row long, score double")
    once = hits.groupBy("query", "vec_id", "row").agg(F.max("score").alias("score"))
    order = [F.desc("score"), "vec_id", "row"]
    best = stored(once.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("n") <= k + 1).drop("n"), "best")
    dropped(postings, asked)
    others = queries.select("query", "query_id", "own").join(best, "query").filter("row <> own")
    ranked = others.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "own").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""SimHash near-duplicates, linked through BK-trees.

Fingerprints that differ in at most RADIUS of 64 bits agree in at least two of six bit
blocks, so each distinct fingerprint is dealt to the fifteen pairs of blocks it can meet
others in. The fingerprints of one block value form a shard; its BK-tree (children keyed
by Hamming distance to the parent) is searched along the edges within the radius. Shards
over CHUNK members are cut into chunks and every pair of chunks is a shard of its own, so
no task grows with a hot block value. A shard gives a spanning forest, not all pairs; the
forests together have the components of all links. Trees are built where their shard is,
since broadcasting them would send every fingerprint to every executor.

Defined results: null and blank texts have fingerprint zero and are linked like any
other; repeated rows share fingerprint and component; a row without id gets the component
of its fingerprint (null if only rows without id have it); empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import free_name, stored
from pagemill.llm.components import components

#: Words in a shingle, hash seed, most bits in which linked fingerprints differ.
SHINGLE, SEED, RADIUS = 4, 42, 4
#: Bits of each block; with RADIUS + 2 blocks two at least are equal.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Most members of a shard's tree, and most (query, node) steps taken at once.
CHUNK, STEPS = 4096, 1_000_000


def simhash(raw: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of a UTF-8 text."""
    words = raw.lower().split()  # of bytes: A-Z, and white space 0x20 and 0x09 to 0x0D, only
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashed = digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        hashed = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(hashed, np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(rows[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(rows), 65536))
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big", signed=True)


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """SimHash of a text column as a signed long."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t or b"", shingle) for t in texts.cast(pa.large_binary()).to_pylist()], pa.int64())

    return prints(text)


def bk_forest(codes: np.ndarray, tree: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all shards at once: root of each shard (-1: none), and the edges as sorted
    keys 65 * parent + distance with their child. codes of a shard are distinct."""
    members = np.flatnonzero(tree)
    root = np.full(int(shard.max()) + 1, -1)
    root[shard[members[::-1]]] = members[::-1]
    keys, children = [], []
    active = members[root[shard[members]] != members]
    at = root[shard[active]]
    while len(active):
        key = at * 65 + np.bitwise_count(codes[active] ^ codes[at])
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        keys.append(distinct)
        children.append(active[first])
        at = active[first][which]
        rest = at != active
        active, at = active[rest], at[rest]
    key = np.concatenate([np.empty(0, np.int64), *keys])
    order = np.argsort(key)
    return root, key[order], np.concatenate([np.empty(0, np.int64), *children])[order]


def bk_search(codes, forest, queries, shard, radius):
    """(query, node) pairs within radius, a level of the trees at a time."""
    root, keys, children = forest
    node = root[shard[queries]]
    queries, node = queries[node >= 0], node[node >= 0]
    while len(queries):
        d = np.bitwise_count(codes[queries] ^ codes[node]).astype(np.int64)
        near = (d <= radius) & (queries != node)
        yield queries[near], node[near]
        low = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 1))
        high = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), "right")
        n = high - low
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        queries, node = np.repeat(queries, n), children[np.repeat(low, n) + step]


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of each link the least label of their classes, in place."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def shard_links(codes, ids, tree, query, shard, radius=RADIUS):
    """Spanning forest of the links in the shards: ids of both ends. Rows are sorted by shard."""
    forest = bk_forest(codes, tree, shard)
    labels = np.arange(len(codes))
    asked = np.flatnonzero(query)
    work = np.cumsum(np.bincount(shard, tree)[shard[asked]])
    at = 0
    while at < len(asked):
        upto = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + STEPS, "right")))
        for a, b in bk_search(codes, forest, asked[at:upto], shard, radius):
            join_labels(labels, a, b)
        at = upto
    tied = np.flatnonzero(labels != np.arange(len(codes)))
    return ids[tied], ids[labels[tied]]


def _linked(batches):
    """Rows (key, i, j, chunk, code, id) sorted by (key, i, j) to links; whole shards are taken together."""
    kept: list[pa.Table] = []
    size = 0

    def links(rows: pa.Table):
        col = {c: rows[c].to_numpy() for c in ("key", "i", "j", "chunk", "code", "id")}
        new = np.ones(rows.num_rows, bool)
        new[1:] = (np.diff(col["key"]) != 0) | (np.diff(col["i"]) != 0) | (np.diff(col["j"]) != 0)
        a, b = shard_links(col["code"].view(np.uint64), col["id"], col["chunk"] == col["i"], col["chunk"] == col["j"], np.cumsum(new) - 1)
        return pa.RecordBatch.from_pydict({"a": a, "b": b})

    for batch in batches:
        kept.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < 16 * CHUNK:
            continue
        rows = pa.concat_tables(kept)
        last = [rows[c][-1].as_py() for c in ("key", "i", "j")]
        same = np.logical_and.reduce([rows[c].to_numpy() == v for c, v in zip(("key", "i", "j"), last, strict=True)])
        cut = int(np.flatnonzero(same)[0])
        if cut:
            yield links(rows.slice(0, cut))
        kept, size = [rows.slice(cut)], rows.num_rows - cut
    if size:
        yield links(pa.concat_tables(kept))


def _block_keys(code: Column) -> Column:
    """The pairs of blocks of a fingerprint, each as one long."""
    shift, fields = 0, []
    for bits in BLOCKS:
        fields.append((bits, F.shiftrightunsigned(code, shift).bitwiseAND((1 << bits) - 1)))
        shift += bits
    pairs = combinations(range(len(BLOCKS)), 2)
    return F.array(*((F.lit(n << 32).cast("long") + F.shiftleft(fields[x][1], fields[y][0]) + fields[y][1]) for n, (x, y) in enumerate(pairs)))


def links_within(nodes: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between ids of nodes (code long, id long; codes distinct) whose classes are
    those of all pairs within RADIUS bits."""
    keyed = nodes.select("code", "id", F.explode(_block_keys(F.col("code"))).alias("key"))
    crowds = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = keyed.join(crowds, "key").withColumn("parts", parts).withColumn("chunk", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int"))
    met = own.select("key", "code", "id", "chunk", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    placed = met.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "code", "id")
    return placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_linked, "a long, b long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (hex) and component_id, the least id reachable over links."""
    prints = stored(docs.select(F.col(key).cast("long").alias("doc_id"), fingerprints(F.col(text), shingle).alias("code")), "prints")
    nodes = stored(prints.groupBy("code").agg(F.min("doc_id").alias("id")).filter("id is not null"), "nodes")
    classes = components(links_within(nodes))
    named = nodes.join(classes, F.col("id") == F.col("node"), "left").select("code", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "code", "left").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each class, that of the least id (of repeated rows of that id, one);
    rows without id stay."""
    keepers = near_duplicates(docs, key=key, text=text, shingle=shingle).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keepers.withColumnRenamed("doc_id", key), key, "left_semi")
    first = F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(text)))
    place = free_name(docs, "_place")
    once = kept.withColumn(place, first).filter(F.col(place) == 1).drop(place)
    return once.unionByName(docs.filter(F.col(key).isNull())).select(docs.columns)

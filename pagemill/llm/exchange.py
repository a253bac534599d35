"""Which keys of a row's text occur elsewhere: a distributed exchange of 64-bit keys.

A text's windows are named by hashes, far too many to be rows of their own. A map task
folds the keys of some millions of windows (equal keys once), cuts them by hash bucket and
emits one row per bucket with packed arrays; a reduce task compares the keys of one bucket
and returns, for each text, those of its keys that count as shared. The number of buckets
grows with the corpus, so neither side of the exchange grows with it. A key that very many
texts have reaches its bucket once per fold, and what a fold already knows never leaves
for the bucket, so a hot key does not gather in one task.

Keys are 64 bits beside the bucket, which comes from an independent hash; the expected
number of wrong equalities among n keys is n * (keys per bucket) / 2**65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import mix, runs, text_bytes

#: Windows folded at once.
FOLD = 1_000_000
#: Order of a text without id: after all others.
LAST = np.iinfo(np.int64).max
_PACKED = "bucket int, names binary, counts binary, keys binary, values binary"
_REPORTED = "home int, names binary, counts binary, keys binary"
_SHARED = "name long, keys binary"


def named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(name, mark, id, text): name and mark are hashes of a row's id and text, so equal rows share
    them. Keys are gathered by name; name and mark together tell rows apart by 128 bits."""
    return docs.select(F.xxhash64(key, text).alias("name"), F.xxhash64(text, F.lit("mark"), key).alias("mark"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Start of each run of equal rows."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _pack(bucket, key, name, value) -> Iterator[dict]:
    """Rows by bucket; within one, keys stand by text, so that names are listed once."""
    order = np.lexsort((name, bucket))
    bucket, key, name, value = bucket[order], key[order], name[order], value[order]
    edges = np.append(_groups(bucket), len(bucket))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        first = np.append(_groups(name[a:b]), b - a)
        yield {"bucket": int(bucket[a]), "names": name[a:b][first[:-1]].tobytes(), "counts": np.diff(first).astype(np.uint32).tobytes(), "keys": key[a:b].tobytes(), "values": value[a:b].tobytes()}


def _unpack(table: pa.Table, key_type, value_type):
    return *_names_keys(table, key_type), np.concatenate([np.frombuffer(v, value_type) for v in table["values"].to_pylist()])


class Shared:
    """Keys that occur at two places or more; with by_id, in texts of two ids or more (a superset
    may be reported across folds). The value of a key says that its fold saw it twice."""

    value_type = np.uint8

    def __init__(self, by_id: bool = False):
        self.by_id = by_id

    def fold(self, bucket, key, name, order):
        """Keys to send (bucket, key, name, value), and (name, key) known to be shared."""
        at = np.lexsort((order, key, bucket))
        bucket, key, name, order = bucket[at], key[at], name[at], order[at]
        first = _groups(bucket, key)
        size = np.diff(np.append(first, len(key)))
        many = order[first] != order[first + size - 1] if self.by_id else size > 1
        known = np.repeat(many, size)
        sent = first
        if self.by_id:  # texts of one id are not told apart here, so each of them asks
            sent = np.union1d(first, np.intersect1d(np.flatnonzero(~known), _groups(bucket, key, name)))
        return bucket[sent], key[sent], name[sent], known[sent].astype(np.uint8), name[known], key[known]

    def reduce(self, name, key, value):
        at = np.argsort(key, kind="stable")
        name, key, value = name[at], key[at], value[at]
        first = _groups(key)
        size = np.diff(np.append(first, len(key)))
        shared = np.repeat((size > 1) | (np.maximum.reduceat(value, first) > 0 if len(first) else size > 1), size)
        back = shared & (value == 0)
        return name[back], key[back]


class Asked:
    """Keys for which some text asks (its order is 1)."""

    value_type = np.uint8

    def fold(self, bucket, key, name, order):
        at = np.lexsort((key, bucket))
        bucket, key, name, order = bucket[at], key[at], name[at], order[at]
        first = _groups(bucket, key)
        asked = np.maximum.reduceat(order, first) > 0
        size = np.diff(np.append(first, len(key)))
        known = np.repeat(asked, size)
        sent = np.union1d(first, np.flatnonzero(~known))
        return bucket[sent], key[sent], name[sent], known[sent].astype(np.uint8), name[known], key[known]

    def reduce(self, name, key, value):
        at = np.argsort(key, kind="stable")
        name, key, value = name[at], key[at], value[at]
        first = _groups(key)
        asked = np.repeat(np.maximum.reduceat(value, first) > 0, np.diff(np.append(first, len(key)))) if len(first) else np.empty(0, bool)
        back = asked & (value == 0)
        return name[back], key[back]


class Later:
    """Keys that also occur in a text of smaller id. The value of a key is the id."""

    value_type = np.int64

    def fold(self, bucket, key, name, order):
        at = np.lexsort((order, key, bucket))
        bucket, key, name, order = bucket[at], key[at], name[at], order[at]
        first = _groups(bucket, key)
        size = np.diff(np.append(first, len(key)))
        later = order > np.repeat(order[first], size)
        keep = np.intersect1d(np.flatnonzero(~later), _groups(bucket, key, name))
        return bucket[keep], key[keep], name[keep], order[keep], name[later], key[later]

    def reduce(self, name, key, value):
        at = np.lexsort((value, key))
        name, key, value = name[at], key[at], value[at]
        first = _groups(key)
        later = value > np.repeat(value[first], np.diff(np.append(first, len(key))))
        return name[later], key[later]


def shared_keys(texts: DataFrame, keys_of: Callable, rule, buckets: int, *, key_type=np.uint64, extra: tuple[str, ...] = ()) -> DataFrame:
    """(name, keys binary): for each text with any those of its keys that rule reports, packed.

    texts has name, id, text and the extra columns. keys_of(data, offsets, batch, first row,
    after last row) gives the row, placing hash and key of each window of a run of texts, and
    what the rule goes by if that is not the text's id.
    """

    def fold(batches):
        held, size = [], 0

        def flush():
            bucket, key, name, order = (np.concatenate(c) for c in zip(*held, strict=True))
            if key_type is not np.uint64:  # equal places of one text once; a shorter key is only a filter
                key = key.astype(key_type)
            *sent, name_known, key_known = rule.fold(bucket, key, name, order)
            rows = list(_pack(*sent))
            if len(name_known):
                at = np.lexsort((key_known, name_known))
                name_known, key_known = name_known[at], key_known[at]
                keep = _groups(name_known, key_known)
                spread = np.full(len(keep), -1)
                rows += [row | {"values": b""} for row in _pack(spread, key_known[keep], name_known[keep], np.zeros(len(keep), np.uint8))]
            return pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("names", "counts", "keys", "values")]))

        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            names, ids = batch.column("name").to_numpy(), batch.column("id").fill_null(LAST).to_numpy(zero_copy_only=False)
            for a, b in runs(offsets):
                row, place, key, *order = keys_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], batch, a, b)
                if len(row):
                    held.append((bucket_of(place, buckets), key, names[a + row], order[0] if order else ids[a + row]))
                    size += len(row)
                if size >= FOLD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def compare(rows: pa.Table) -> pa.Table:
        """Reported keys of a bucket, in one row for each home (hash bucket of names)."""
        if rows["bucket"][0].as_py() < 0:  # known in the fold already
            name, key = _names_keys(rows, key_type)
        else:
            name, key = rule.reduce(*_unpack(rows, key_type, rule.value_type))
        home = bucket_of(mix(name), buckets)
        return pa.Table.from_pylist([{"home": r["bucket"]} | {c: r[c] for c in ("names", "counts", "keys")} for r in _pack(home, key, name, np.zeros(len(key), np.uint8))], _REPORTED_ARROW)

    def gather(rows: pa.Table) -> pa.Table:
        """All reported keys of the names of a home, each key once."""
        name, key = _names_keys(rows, key_type)
        at = np.lexsort((key, name))
        name, key = name[at], key[at]
        once = _groups(name, key)
        name, key = name[once], key[once]
        edges = np.append(_groups(name), len(name))
        return pa.Table.from_pydict({"name": name[edges[:-1]], "keys": pa.array([key[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())})

    folded = texts.select("name", "id", "text", *extra).mapInArrow(fold, _PACKED)
    spread = folded.withColumn("part", F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("names"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket")))
    return spread.groupBy("part").applyInArrow(compare, _REPORTED).groupBy("home").applyInArrow(gather, _SHARED)


_REPORTED_ARROW = pa.schema([("home", pa.int32()), ("names", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])


def _names_keys(rows: pa.Table, key_type):
    names = [np.repeat(np.frombuffer(n, np.int64), np.frombuffer(c, np.uint32)) for n, c in zip(rows["names"].to_pylist(), rows["counts"].to_pylist(), strict=True)]
    return np.concatenate(names), np.concatenate([np.frombuffer(k, key_type) for k in rows["keys"].to_pylist()])


class KeyLists:
    """The reported keys of the texts of a run, to ask which windows have them.

    A key is asked for together with its row, as one code: exactly for 32-bit keys, and by a
    mixture of both for 64-bit ones."""

    def __init__(self, column: pa.Array, key_type=np.uint64):
        lists = [np.frombuffer(k or b"", key_type) for k in column.to_pylist()]
        row = np.repeat(np.arange(len(lists)), [len(k) for k in lists])
        self.exact = key_type is not np.uint64
        self.codes = np.sort(self._code(row, np.concatenate([np.empty(0, key_type), *lists])))
        self.maybe = np.zeros(1 << 21, bool)
        self.maybe[self._slot(self.codes)] = True

    def _code(self, row, key):
        if self.exact:
            return row.astype(np.uint64) << np.uint64(32) | key.astype(np.uint32)
        return key ^ mix(row + 1)

    def _slot(self, code):
        return ((code ^ code >> np.uint64(32)) & np.uint64((1 << 21) - 1)).astype(np.int64)

    def has(self, row: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Which windows (row, key) are reported for their row."""
        found = np.zeros(len(row), bool)
        if len(self.codes) and len(row):
            code = self._code(row, key)
            near = np.flatnonzero(self.maybe[self._slot(code)])
            code = code[near]
            found[near] = self.codes[np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)] == code
        return found

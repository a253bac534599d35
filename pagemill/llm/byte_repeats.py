"""Repeated byte strings: every byte of a WINDOW-byte string that also starts elsewhere.

Places are sampled by content, so that equal strings are sampled alike wherever they stand. Sampled
places are named by their first PREFIX bytes, equal names are brought together, and only stretches
all of whose sampled prefixes occur twice go on. There

1. texts are parsed into phrases between sampled places, and the suffixes of the parse are sorted by a
   difference cover (see suffix_sort): sampled triples are sorted and named, names of names in turn,
   and the remaining suffixes merged; neighbours in that order are compared by their first WINDOW
   bytes, which tells the windows that start a phrase and occur elsewhere;
2. a text asks about every other start, unless repeated starts on both sides of it, at most
   WINDOW apart, already cover its window; it asks by the first sampled prefix in the window,
   which a string equal to it has at the same place;
3. the windows of all texts at prefixes that some text asks about are compared.

The result is that of comparing every window with every other one. Sorting the suffixes of all bytes
instead of those of the parse would move some tens of bytes for each byte of text.

Defined results: a null text is empty; repeated rows repeat each other, whatever their ids
(null ids too); strings are judged on the input; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Polynomial, buckets_for, dropped, runs, stored, text_bytes
from pagemill.llm.exchange import Asked, KeyLists, Shared, named, shared_keys
from pagemill.llm.suffix_sort import neighbours, ranks, sample_names

#: Fixed value: bytes of a string that counts as repeated.
WINDOW = 200
#: Bytes by which a position is chosen, bytes by which it is named; one position in SPARSE, and of
#: starts one in PARSE, is of the sample.
SEED, PREFIX, SPARSE, PARSE = 16, 64, 16, 32
#: Positions are chosen, prefixes named and windows placed by spans of one hash; keys are of another one.
_PLACE, _KEY = Polynomial(21), Polynomial(24)


def _rows(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, "right") - 1


def _inside(offsets: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The positions that width bytes of their row follow."""
    return at[at + width <= offsets[_rows(offsets, at) + 1]]


def picks(data: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """Hash of the SEED bytes at each position; sums are those of _PLACE, if they are at hand."""
    return _PLACE.windows(_PLACE.prefix(data) if sums is None else sums, SEED)


def chosen(picked: np.ndarray, one_in: int) -> np.ndarray:
    return np.flatnonzero((picked & np.uint64(one_in - 1)) == 0)


def prefixes(data: np.ndarray, offsets: np.ndarray, picked: np.ndarray, sums: np.ndarray | None = None):
    """Sampled positions that PREFIX bytes of their row follow, with the name of those."""
    at = _inside(offsets, chosen(picked, SPARSE), PREFIX)
    return at, _PLACE.spans(_PLACE.prefix(data) if sums is None else sums, at, at + PREFIX)


def free_starts(flagged: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of windows inside a row none of whose prefix positions are flagged."""
    n = len(flagged) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(flagged, dtype=np.int32)])
    width = WINDOW - PREFIX + 1
    free = sums[width : width + n] == sums[:n]
    for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        free[max(first, last - WINDOW + 1) : last] = False
    return np.flatnonzero(free)


def candidates(data, offsets, batch, a, b, sums, picked=None):
    """Starts of windows all of whose sampled prefixes are shared (or that have none), which of
    them start a phrase, and the sampled prefixes."""
    picked = picks(data, sums) if picked is None else picked
    at, name = prefixes(data, offsets, picked, sums)
    unshared = np.zeros(len(data), bool)
    unshared[at[~KeyLists(batch.column("keys").slice(a, b - a), np.uint32).has(_rows(offsets, at), name)]] = True
    starts = free_starts(unshared, offsets)
    return starts, (picked[starts] & np.uint64(PARSE - 1)) == 0, at, name


def _prefix_keys(data, offsets, batch, a, b):
    sums = _PLACE.prefix(data)
    at, name = prefixes(data, offsets, picks(data, sums), sums)
    return _rows(offsets, at), name, name


_PHRASES = "uid long, part int, k int, pos int, phrase binary, key long"


def _binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as a binary array."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(starts - at[:-1], size) + np.arange(int(at[-1]))]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])


def phrases(data, offsets, batch, a, b):
    """The parse of what candidate windows cover: for each phrase its row, part (a stretch without gap),
    place in it, start, bytes, and the key of the window that starts there if it is a candidate.

    A phrase goes from one sampled place to SEED bytes behind the next one, the bytes that make that a
    sampled place. So no phrase begins another, and phrases in order of their bytes put suffixes of the
    parse in order of theirs. What WINDOW bytes do not reach is cut off."""
    sums = _PLACE.prefix(data)
    picked = picks(data, sums)
    starts, sampled, _, _ = candidates(data, offsets, batch, a, b, sums, picked)
    starts = starts[sampled]
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    inside = np.cumsum(cover[:-1]) > 0
    every = chosen(picked, PARSE)
    row = _rows(offsets, every)
    last = offsets[row + 1]
    after = np.append(every[1:], np.iinfo(np.int64).max)
    after = np.where(np.append(row[1:] == row[:-1], False), after, last) if len(every) else every
    ends = np.minimum(np.minimum(after + SEED, last), every + WINDOW)
    kept = inside[every] if len(every) else np.zeros(0, bool)
    x, row, ends = every[kept], row[kept], ends[kept]
    gaps = np.cumsum(~inside)[x] if len(x) else x
    fresh = np.ones(len(x), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (gaps[1:] != gaps[:-1])
    part = np.cumsum(fresh) - 1
    k = np.arange(len(x)) - np.flatnonzero(fresh)[part] if len(x) else x
    asks = np.isin(x, starts, assume_unique=True)
    key = np.zeros(len(x), np.uint64)
    key[asks] = _KEY.spans(_KEY.prefix(data), x[asks], x[asks] + WINDOW)
    return row, part, k, x - offsets[row], _binary(data, x, ends), pa.array(key.view(np.int64), mask=~asks)


def _parse(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        uid = batch.column("uid").to_numpy()
        for a, b in runs(offsets):
            row, part, k, pos, phrase, key = phrases(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], batch, a, b)
            if len(row):
                yield pa.RecordBatch.from_pydict({"uid": uid[a + row], "part": part.astype(np.int32), "k": k.astype(np.int32), "pos": pos.astype(np.int32), "phrase": phrase, "key": key})


def _packed(batches):
    """Lists of keys as the packed ones that KeyLists reads."""
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"name": batch.column("name"), "keys": pa.array([np.array(k, np.int64).tobytes() for k in batch.column("keys").to_pylist()], pa.binary())})


def repeated_phrases(some: DataFrame) -> DataFrame:
    """(name, keys binary): of each text the keys of windows that start a phrase and occur elsewhere, found
    by a suffix sort of the parse: windows are compared with their neighbours in that order."""
    parsed = stored(some.select("uid", "text", "keys").mapInArrow(_parse, _PHRASES), "phrases")
    used: list[DataFrame] = []
    symbols = ranks(parsed.select("phrase").distinct(), "symbol", used).select(F.xxhash64("phrase").alias("h"), F.col("symbol").cast("bigint").alias("symbol"))
    rows = parsed.select("uid", "part", "k", "pos", "key", F.xxhash64("phrase").alias("h")).join(symbols.hint("shuffle_hash"), "h").drop("h")
    numbered = stored(rows, "symbols")
    dropped(*used)
    sorted_rows = sample_names(numbered, depth=WINDOW)
    twice = neighbours(sorted_rows, "key")
    dropped(numbered, sorted_rows)
    met = parsed.select("uid", "key").filter("key is not null").join(twice, "key", "left_semi")
    listed = some.select("uid", "name").join(met, "uid").groupBy("name").agg(F.collect_set("key").alias("keys"))
    found = stored(listed.mapInArrow(_packed, "name long, keys binary"), "sampled")
    dropped(parsed, twice)
    return found


def _first_prefix(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of the first sampled prefix in the window of each start; len(at) if there is none."""
    first = np.searchsorted(at, starts)
    return np.where(np.append(at, np.iinfo(np.int64).max)[first] - starts <= WINDOW - PREFIX, first, len(at))


def _asked_prefixes(data, offsets, batch, a, b):
    """The first prefixes of windows that are not of the sample, and whether a window there still needs comparing."""
    starts, sampled, at, name = candidates(data, offsets, batch, a, b, _PLACE.prefix(data))
    known, starts = starts[sampled], starts[~sampled]
    keys = _KEY.spans(_KEY.prefix(data), known, known + WINDOW)
    known = known[KeyLists(batch.column("found").slice(a, b - a)).has(_rows(offsets, known), keys)]
    needed = np.ones(len(starts), bool)
    if len(known):
        row, after = _rows(offsets, known), np.searchsorted(known, starts)
        ends = (after > 0) & (after < len(known))
        low, high = np.maximum(after - 1, 0), np.minimum(after, len(known) - 1)
        needed = ~(ends & (known[high] - known[low] <= WINDOW) & (row[low] == row[high]))
    needed &= ~batch.column("copied").slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)[_rows(offsets, starts)]  # repeated anyway
    first = _first_prefix(at, starts)
    asked, there = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, bool)
    asked[first[needed]], there[first] = 1, True
    there = np.flatnonzero(there[:-1])
    return _rows(offsets, at[there]), name[there], name[there], asked[there]


def _other_windows(data, offsets, batch, a, b):
    """Windows that are not of the sample, at prefixes that some text asks about (or without one)."""
    sums = _PLACE.prefix(data)
    starts, sampled, at, name = candidates(data, offsets, batch, a, b, sums)
    starts = starts[~sampled]
    asked = np.ones(len(at) + 1, bool)
    asked[:-1] = KeyLists(batch.column("asked").slice(a, b - a), np.uint32).has(_rows(offsets, at), name)
    starts = starts[asked[_first_prefix(at, starts)]]
    return _rows(offsets, starts), _PLACE.spans(sums, starts, starts + WINDOW), _KEY.spans(_KEY.prefix(data), starts, starts + WINDOW)


def asked_texts(some: DataFrame, asked: DataFrame) -> DataFrame:
    """The texts whose windows `_other_windows` may report: those with asked prefixes, or with a window without one."""
    return some.join(asked.withColumnRenamed("keys", "asked").hint("shuffle_hash"), "name", "left").filter("asked is not null or bare")


_WHOLE = "struct<n_bytes:long,kept_sha256:string,open:boolean>"
_REMOVED = "name long, mark long, spans array<struct<start:long,n:long>>, n_removed long, kept binary"


def _whole(texts: pa.Array) -> pa.Array:
    """Of each text: bytes, digest, and whether it has a window without a sampled prefix."""
    data, offsets = text_bytes(texts)
    some = [np.empty(0, bool)]
    for a, b in runs(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        sampled = np.zeros(len(part), bool)
        sampled[_inside(at, chosen(picks(part), SPARSE), PREFIX)] = True
        bare = free_starts(sampled, at)
        some.append(np.bincount(_rows(at, bare), minlength=b - a) > 0)
    digests = [hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array(np.diff(offsets)), pa.array(digests, pa.string()), pa.array(np.concatenate(some))], ["n_bytes", "kept_sha256", "open"])


def _remove(batches):
    span = pa.struct([("start", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        names, marks, out = batch.column("name").to_pylist(), batch.column("mark").to_pylist(), []
        for a, b in runs(offsets):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts = free_starts(np.zeros(len(part), bool), at)
            keys = _KEY.windows(_KEY.prefix(part), WINDOW)[starts]
            gone = starts[KeyLists(batch.column("keys").slice(a, b - a)).has(_rows(at, starts), keys)]
            step = np.zeros(len(part) + 1, np.int64)
            step[gone] += 1
            step[gone + WINDOW] -= 1
            removed = np.cumsum(step)[:-1] > 0
            for r in np.unique(_rows(at, gone)).tolist():
                mask = removed[at[r] : at[r + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
                spans = [{"start": s, "n": e - s} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
                out.append({"name": names[a + r], "mark": marks[a + r], "spans": spans, "n_removed": int(mask.sum()), "kept": part[at[r] : at[r + 1]][~mask].tobytes()})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("name", pa.int64()), ("mark", pa.int64()), ("spans", pa.list_(span)), ("n_removed", pa.int64()), ("kept", pa.binary())]))


def repeated_bytes(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Of every row (name, mark, id, n_bytes, kept_sha256 of all bytes); and of each row that loses
    bytes, the removed spans, their total and the kept bytes.

    Rows of one text (by its SHA-256) of WINDOW bytes or more lose all bytes; the first of them goes on
    to be compared with other texts, but has nothing to ask itself."""
    spark, texts = docs.sparkSession, named(docs, key, text)
    hashed = stored(texts.select("name", "mark", "id", F.arrow_udf(_whole, _WHOLE)("text").alias("w")).select("name", "mark", "id", "w.n_bytes", "w.kept_sha256", "w.open"), "bytes")
    copied = hashed.filter(F.col("n_bytes") >= WINDOW).groupBy("kept_sha256").agg(F.count("*").alias("_n"), F.min(F.struct("name", "mark")).alias("_first")).filter("_n > 1")
    one = F.col("_first").isNull() | (F.struct("name", "mark") == F.col("_first"))
    every = stored(hashed.join(copied, "kept_sha256", "left").select("name", "mark", "id", "n_bytes", "kept_sha256", "open", F.col("_n").isNotNull().alias("copied"), one.alias("goes_on")), "rows")
    dropped(hashed)
    size = every.agg(F.sum("n_bytes")).first()[0] or 0
    sampled = buckets_for(spark, size / SPARSE)
    shared = shared_keys(texts, _prefix_keys, Shared(), sampled, key_type=np.uint32)
    wanted = shared.join(every.filter("open").select("name").distinct(), "name", "full_outer")
    wanted = every.filter("goes_on").select("name", "mark", "copied", F.col("open").alias("bare")).distinct().join(wanted, "name")
    some = stored(texts.join(wanted.hint("shuffle_hash"), ["name", "mark"]).withColumn("uid", F.monotonically_increasing_id()), "candidates")  # stored, so that a row keeps its number
    found = repeated_phrases(some)
    both = some.join(found.withColumnRenamed("keys", "found").hint("shuffle_hash"), "name", "left")
    asked = stored(shared_keys(both, _asked_prefixes, Asked(), sampled, key_type=np.uint32, extra=("keys", "found", "copied")), "asked")
    both = asked_texts(some, asked)
    rest = stored(shared_keys(both, _other_windows, Shared(), sampled, extra=("keys", "asked")), "starts")
    repeats = found.join(rest.withColumnRenamed("keys", "more"), "name", "full_outer")
    repeats = repeats.select("name", F.concat(F.coalesce("keys", F.lit(b"")), F.coalesce("more", F.lit(b""))).alias("keys"))
    removed = some.filter("not copied").select("name", "mark", "text").join(repeats, "name").dropDuplicates(["name", "mark"]).mapInArrow(_remove, _REMOVED)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("n")))
    gone = every.filter("copied").dropDuplicates(["name", "mark"]).select("name", "mark", whole.alias("spans"), F.col("n_bytes").alias("n_removed"), F.lit(b"").alias("kept"))
    return every.select("name", "mark", "id", "n_bytes", "kept_sha256"), removed.unionByName(gone)


def byte_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed spans."""
    every, removed = repeated_bytes(docs, key=key, text=text)
    gone = removed.select("name", "mark", "n_removed", F.sha2("kept", 256).alias("sha"), "spans")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:long,n:long>>"))
    return every.join(gone, ["name", "mark"], "left").select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.coalesce("sha", "kept_sha256").alias("kept_sha256"),
        spans.alias("spans"),
    )

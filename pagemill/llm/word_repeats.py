"""Repeated word passages, found through recompression and removed but for their first place.

Recompression renames a sequence of words level by level: runs of one word get a name, then
neighbours of which the first is in the left and the second in the right half of the
alphabet merge into a pair with a name of its own. Names are hashes of what they stand for,
so tasks name alike without asking each other, and the interior of equal passages is cut
alike wherever they stand: in WINDOW words without an inner run, every cut between words
MARGIN and WINDOW - MARGIN after LEVELS pair rounds depends on those words only, and there
is one at least. The words around each cut are exchanged; a window can repeat only if all
its certain cuts are shared, which leaves out almost all unique text. The windows that remain
(and those with an inner run, which have no certain cut) are compared by 64-bit keys of their 13
words, within hash buckets.

Defined results: a null text has no words; a row without id neither removes from others
nor loses words; rows of one id do not remove from each other; windows are judged on the
input; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Polynomial, buckets_for, mix, runs, stored, text_bytes, word_hash, word_spans
from pagemill.llm.exchange import LAST, KeyLists, Later, Shared, named, shared_keys

#: Fixed value: words of a window.
WINDOW = 13
#: Pair rounds; words on either side of a cut that its key has (a cut is certain from MARGIN words inside on).
LEVELS, MARGIN = 2, 4
_WORD, _CUT, _PLACE, _KEY = 1, Polynomial(2), Polynomial(3), Polynomial(4)


def symbols(data: np.ndarray, offsets: np.ndarray):
    """Hash of each word and its row."""
    starts, ends, row = word_spans(data, offsets)
    return word_hash(data, starts, ends, _WORD), row


def recompress(symbol: np.ndarray, row: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Indices of the words at which a name of the last level starts."""
    start = np.arange(len(symbol))
    if not len(start):
        return start
    fresh = np.ones(len(symbol), bool)
    fresh[1:] = (symbol[1:] != symbol[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(fresh)
    length = np.diff(np.append(start, len(symbol)))
    name, row = np.where(length > 1, mix(symbol[start] + mix(length)), symbol[start]), row[start]
    for level in range(levels):
        right = (mix(name ^ np.uint64(0x9E3779B97F4A7C15 + level)) & np.uint64(1)).astype(bool)
        pair = np.flatnonzero(~right[:-1] & right[1:] & (row[:-1] == row[1:]))
        merged = name.copy()
        merged[pair] = mix(name[pair] * np.uint64(0xD6E8FEB86659FD93) + mix(name[pair + 1]))
        keep = np.ones(len(name), bool)
        keep[pair + 1] = False
        name, row, start = merged[keep], row[keep], start[keep]
    return start


def cuts(symbol: np.ndarray, row: np.ndarray):
    """Word index and key of each cut with MARGIN words of its row on either side."""
    at = recompress(symbol, row)
    at = at[(at >= MARGIN) & (at + MARGIN <= len(symbol))]
    at = at[(row[at - MARGIN] == row[at]) & (row[at + MARGIN - 1] == row[at])]
    return at, _CUT.spans(_CUT.prefix(symbol), at - MARGIN, at + MARGIN)


def inner_runs(symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Is a word equal to the one before it in its row?"""
    same = np.zeros(len(symbol), bool)
    same[1:] = (symbol[1:] == symbol[:-1]) & (row[1:] == row[:-1])
    return same


def _within(flags: np.ndarray, starts: np.ndarray, first: int, last: int) -> np.ndarray:
    """How many flags are set from starts + first to starts + last, both included."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[np.minimum(starts + last + 1, len(flags))] - sums[np.minimum(starts + first, len(flags))]


def window_starts(row: np.ndarray, window: int = WINDOW) -> np.ndarray:
    starts = np.arange(max(len(row) - window + 1, 0))
    return starts[row[starts] == row[starts + window - 1]]


def window_keys(symbol: np.ndarray, starts: np.ndarray, window: int = WINDOW):
    """Placing hash and key of the windows from starts on."""
    return _PLACE.spans(_PLACE.prefix(symbol), starts, starts + window), _KEY.spans(_KEY.prefix(symbol), starts, starts + window)


def _cut_keys(data, offsets, batch, a, b):
    symbol, row = symbols(data, offsets)
    at, key = cuts(symbol, row)
    return row[at], key, key


def _candidate_keys(data, offsets, batch, a, b):
    symbol, row = symbols(data, offsets)
    at, key = cuts(symbol, row)
    lists = KeyLists(batch.column("keys").slice(a, b - a), np.uint32)
    unshared = np.zeros(len(symbol), bool)
    unshared[at[~lists.has(row[at], key)]] = True
    starts = window_starts(row)
    possible = (_within(unshared, starts, MARGIN, WINDOW - MARGIN) == 0) | (_within(inner_runs(symbol, row), starts, 1, WINDOW - 1) > 0)
    starts = starts[possible]
    return row[starts], *window_keys(symbol, starts)


def _whole(texts: pa.Array) -> pa.Array:
    """Of each text: number of words, digest of all its words, and whether two equal ones are neighbours."""
    n, some = [], []
    data, offsets = text_bytes(texts)
    for a, b in runs(offsets):
        symbol, row = symbols(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n.append(np.bincount(row, minlength=b - a))
        some.append(np.bincount(row, inner_runs(symbol, row), b - a) > 0)
    digests = [hashlib.sha256(b" ".join(bytes(t).split())).hexdigest() for t in (data[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))]
    none = np.empty(0, np.int64)
    return pa.StructArray.from_arrays([pa.array(np.concatenate([none, *n])), pa.array(digests, pa.string()), pa.array(np.concatenate([none.astype(bool), *some]))], ["n_words", "kept_sha256", "runs"])


_WHOLE = "struct<n_words:long,kept_sha256:string,runs:boolean>"
_REMOVED = "name long, mark long, spans array<struct<start:int,n:int>>, n_removed long, kept string"


def _remove(batches):
    """Spans of words to remove, their number and the kept words, of texts that lose some."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        names, marks, out = batch.column("name").to_pylist(), batch.column("mark").to_pylist(), []
        for a, b in runs(offsets):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            symbol, row = symbols(part, at)
            starts = window_starts(row)
            gone = starts[KeyLists(batch.column("keys").slice(a, b - a)).has(row[starts], _KEY.spans(_KEY.prefix(symbol), starts, starts + WINDOW))]
            step = np.zeros(len(symbol) + 1, np.int64)
            np.add.at(step, gone, 1)
            np.add.at(step, gone + WINDOW, -1)
            removed = np.cumsum(step)[:-1] > 0
            for r in np.unique(row[gone]).tolist():
                first, last = np.searchsorted(row, [r, r + 1])
                mask = removed[first:last]
                words = part[at[r] : at[r + 1]].tobytes().split()
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
                spans = [{"start": s, "n": e - s} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
                out.append({"name": names[a + r], "mark": marks[a + r], "spans": spans, "n_removed": int(mask.sum()), "kept": b" ".join(w for w, x in zip(words, mask.tolist(), strict=True) if not x).decode()})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("name", pa.int64()), ("mark", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))), ("n_removed", pa.int64()), ("kept", pa.string())]))


def repeated_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Of every row (name, id, n_words, kept_sha256 of all words); and of each name that loses
    words, the spans of removed words, their number and the kept text."""
    spark, texts = docs.sparkSession, named(docs, key, text)
    every = stored(texts.select("name", "mark", "id", F.arrow_udf(_whole, _WHOLE)("text").alias("w")).select("name", "mark", "id", "w.n_words", "w.kept_sha256", "w.runs"), "words")
    words = every.agg(F.sum("n_words")).first()[0] or 0
    buckets = buckets_for(spark, words)
    shared = shared_keys(texts, _cut_keys, Shared(by_id=True), buckets, key_type=np.uint32)
    wanted = shared.join(every.filter(f"runs and n_words >= {WINDOW}").select("name").distinct(), "name", "full_outer")
    some = stored(texts.filter("id is not null").join(wanted, "name"), "candidates")
    later = stored(shared_keys(some, _candidate_keys, Later(), buckets, extra=("keys",)), "repeats")
    removed = some.select("name", "mark", "text").join(later, "name").dropDuplicates(["name", "mark"]).mapInArrow(_remove, _REMOVED)
    return every.drop("runs"), removed


def word_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and the spans of removed words."""
    every, removed = repeated_words(docs, key=key, text=text)
    gone = removed.select("name", "mark", "n_removed", F.sha2("kept", 256).alias("sha"), "spans")
    return every.join(gone, ["name", "mark"], "left").select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("sha", "kept_sha256").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")).alias("spans"),
    )

"""Language-model scores: context-tree weighting over bytes, and the word unigram base.

The model reads a text as its words, A-Z lower-cased, joined by one space and ended by a
line feed. Each byte is eight binary decisions; a decision has a node for the context of the
last 0 to DEEP bytes, each with a Krichevsky-Trofimov estimate, and the estimates of all
depths are mixed by context-tree weights. Estimates and weights of a learnt corpus depend
only on how often each byte follows each context of DEEP bytes, counts that grow with the
corpus. Tasks fold some ten million bytes into distinct contexts, which are exchanged by a
hash of their last DEPTH + 1 bytes: a bucket has whole subtrees, weighs them from the leaves
up and passes on only the weights of their roots. Those of the contexts of at most DEPTH bytes,
256 ** DEPTH of them however large the corpus, are weighed at the driver and sent to the
executors; buckets then give each fold the log probability of those contexts that its texts have.

The base needs the count of every word in the whole corpus. Distinct words of a fold, cut by
hash bucket, go the same way.

Defined results: null and blank texts are the end alone; a row without id is not learnt
from and is not held out; repeated rows count as often as they occur; without anything learnt
every bit has probability one half; an empty table gives an empty result.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import LOWER, buckets_for, mix, runs, stored, text_bytes, word_hash, word_spans
from pagemill.llm.exchange import _groups, bucket_of

#: Bytes of the longest context, and of the longest one that is weighed at the driver.
DEEP, DEPTH = 6, 2
#: Bytes of text folded at once, and of those sorted at once; contexts of a bucket weighed at once.
FOLD_BYTES, SORT_BYTES, WEIGH = 8 << 20, 2 << 20, 1 << 17
END, GAP = 0x0A, 0x20
_PLACE, _KEY = 31, 32


def stream(data: np.ndarray, offsets: np.ndarray):
    """Words of each row joined by GAP and ended by END: bytes, offsets, and the words' spans and rows in data."""
    starts, ends, row = word_spans(data, offsets)
    taken = ends - starts + 1
    size = np.maximum(np.bincount(row, taken, len(offsets) - 1).astype(np.int64), 1)
    at = np.concatenate([[0], np.cumsum(size)])
    before = np.cumsum(taken) - taken
    first = np.searchsorted(row, row, "left")
    place = at[row] + before - before[first] if len(row) else before
    out = np.full(at[-1], GAP, np.uint8)
    source = np.repeat(starts, taken - 1) + np.arange(int((taken - 1).sum())) - np.repeat(before - np.arange(len(row)), taken - 1)
    out[np.repeat(place - starts, taken - 1) + source] = data[source]
    out[at[1:] - 1] = END
    return out, at, starts, ends, row


def contexts(out: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte of a stream: the DEPTH bytes before it (END before the start of a row) and itself, as one number."""
    last = np.concatenate([np.full(DEPTH, END, np.uint8), out]).astype(np.int64)
    code = np.zeros(len(out), np.int64)
    for back in range(DEPTH, -1, -1):
        byte = last[DEPTH - back : DEPTH - back + len(out)].copy()
        for step in range(back - 1):  # a row before ends in END, bytes before that are not context
            there = at[:-1] + step
            byte[there[there < at[1:]]] = END
        code = code << 8 | byte
    return code


def deep_contexts(out: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte of a stream: the DEEP bytes before it, the last one first, and itself, as one number.
    Contexts with the same last bytes stand together in order."""
    last = np.concatenate([np.full(DEEP, END, np.uint8), out])
    code = np.zeros(len(out), np.int64)
    for back in [*range(1, DEEP + 1), 0]:
        byte = last[DEEP - back : DEEP - back + len(out)]
        if back > 1:
            byte = byte.copy()
        for step in range(back - 1):
            there = at[:-1] + step
            byte[there[there < at[1:]]] = END
        code <<= 8
        code |= byte
    return code


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x >= 0.5, by Stirling's series after a shift of 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def node_counts(byte_counts: np.ndarray) -> np.ndarray:
    """Counts of the binary nodes of each row of byte counts: node n has children 2n and 2n+1, bytes are 256 to 511."""
    nodes = np.zeros((*byte_counts.shape[:-1], 512))
    nodes[..., 256:] = byte_counts
    for low in (128, 64, 32, 16, 8, 4, 2, 1):
        nodes[..., low : 2 * low] = nodes[..., 2 * low : 4 * low : 2] + nodes[..., 2 * low + 1 : 4 * low : 2]
    return nodes


def block_log(nodes: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov log probability of all decisions at each of nodes 1 to 255 (index 0 unused)."""
    zero, one = nodes[..., 0::2], nodes[..., 1::2]
    log = log_gamma(zero + 0.5) + log_gamma(one + 0.5) - log_gamma(zero + one + 1) - np.log(np.pi)
    log[(zero + one) == 0] = 0
    return log


def estimate(nodes: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probability of a one at each node."""
    return (nodes[..., 1::2] + 0.5) / (nodes[..., 0::2] + nodes[..., 1::2] + 1)


def byte_logs(one: np.ndarray) -> np.ndarray:
    """Log probability of each byte, given that of a one at each node."""
    logs = np.zeros((*one.shape[:-1], 512))
    for low in (1, 2, 4, 8, 16, 32, 64, 128):
        node = slice(low, 2 * low)
        logs[..., 2 * low : 4 * low : 2] = logs[..., node] + np.log1p(-one[..., node])
        logs[..., 2 * low + 1 : 4 * low : 2] = logs[..., node] + np.log(one[..., node])
    return logs[..., 256:]


@dataclass
class ContextTree:
    """The part of a context tree of at most DEPTH bytes. A bit has probability one (or zero) plus share
    times what deeper contexts give it; contexts never seen share a row by their last byte."""

    row: np.ndarray  # 65536: row of the tables
    one: np.ndarray  # rows x 256 nodes, float32
    zero: np.ndarray
    share: np.ndarray

    @classmethod
    def of(cls, code: np.ndarray, n: np.ndarray, deep: np.ndarray | None = None, below: np.ndarray | None = None) -> ContextTree:
        """From counts n of (two context bytes, byte) codes, and the summed log weights below of (two
        context bytes, node) codes deep, if there are deeper contexts. Works on one last byte at a time."""
        older, last, byte = code >> 16, code >> 8 & 255, code & 255
        seen = np.unique(last)
        count1 = np.zeros((256, 256))
        np.add.at(count1, (last, byte), n)
        nodes1, nodes0 = node_counts(count1), node_counts(count1.sum(axis=0))
        deeper1, parts = np.zeros((256, 256)), {}
        order = np.argsort(last, kind="stable")
        edges = np.searchsorted(last[order], np.arange(257))
        if deep is not None:
            deep_order = np.argsort(deep >> 8 & 255, kind="stable")
            deep_edges = np.searchsorted((deep >> 8 & 255)[deep_order], np.arange(257))
        for c in seen.tolist():
            mine = order[edges[c] : edges[c + 1]]
            olds, which = np.unique(older[mine], return_inverse=True)
            counts = np.zeros((len(olds), 256))
            np.add.at(counts, (which, byte[mine]), n[mine])
            nodes = node_counts(counts)
            own, weight = block_log(nodes), np.ones((len(olds), 256))
            if deep is not None:
                there, deeper = deep_order[deep_edges[c] : deep_edges[c + 1]], np.zeros((len(olds), 256))
                deeper[np.searchsorted(olds, deep[there] >> 16), deep[there] & 255] = below[there]
                weight = own_weight(own, deeper)
                own = np.log(0.5) + np.logaddexp(own, deeper)
            deeper1[c] = own.sum(axis=0)
            parts[c] = (olds, estimate(nodes), weight)
        own1, own0 = block_log(nodes1), block_log(nodes0)
        whole1 = np.log(0.5) + np.logaddexp(own1, deeper1)
        weight1, weight0 = own_weight(own1, deeper1), own_weight(own0, whole1[seen].sum(axis=0))
        half, one1, one0 = np.full((1, 256), 0.5), estimate(nodes1), estimate(nodes0)
        row, tables = np.empty(65536, np.int32), []
        used = 0
        for c in range(256):
            olds, one2, weight2 = parts.get(c, (np.empty(0, np.int64), half[:0], half[:0]))
            one2, weight2 = np.concatenate([one2, half]), np.concatenate([weight2, 2 * half])
            rest = (1 - weight0) * (1 - weight1[c])
            fixed = [weight0 * p0 + (1 - weight0) * weight1[c] * p1 + rest * weight2 * p2 for p0, p1, p2 in ((one0, one1[c], one2), (1 - one0, 1 - one1[c], 1 - one2))]
            tables.append([t.astype(np.float32) for t in (*fixed, rest * (1 - weight2))])
            row[np.arange(256) << 8 | c] = used + len(olds)
            row[olds << 8 | c] = used + np.arange(len(olds))
            used += len(olds) + 1
        return cls(row, *(np.concatenate(t) for t in zip(*tables, strict=True)))

    @property
    def table(self) -> np.ndarray:
        """log10 probability of each byte in each row, of a tree without deeper contexts."""
        return (byte_logs(self.one.astype(float)) / np.log(10)).astype(np.float32)

    def logs(self, code: np.ndarray, low: np.ndarray) -> np.ndarray:
        """log10 probability of the byte of each deep context, given what depths over DEPTH give its bits."""
        last, older, byte = code >> 8 * DEEP, code >> 8 * (DEEP - 1) & 255, code & 255
        row, total = self.row[older << 8 | last], np.zeros(len(code))
        for k in range(8):
            node, bit = 1 << k | byte >> 8 - k, byte >> 7 - k & 1
            total += np.log10(np.where(bit, self.one[row, node], self.zero[row, node]).astype(np.float64) + self.share[row, node] * low[:, k])
        return total


def own_weight(own: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    """Weight of a node's own estimate against those below it."""
    return 1 / (1 + np.exp(np.clip(deeper - own, -700, 700)))


class _Gammas:
    """Log gamma of n + 0.5 and n + 1 for whole n, from a table where n is small."""

    def __init__(self, size: int = 1 << 16):
        self.at = {x: log_gamma(np.arange(size) + x) for x in (0.5, 1.0)}

    def __call__(self, n: np.ndarray, x: float) -> np.ndarray:
        found = self.at[x][np.minimum(n, len(self.at[x]) - 1)]
        large = np.flatnonzero(n >= len(self.at[x]))
        found[large] = log_gamma(n[large] + x)
        return found


_GAMMA = _Gammas()


def weigh_subtrees(code: np.ndarray, n: np.ndarray):
    """What contexts of over DEPTH bytes give each bit of the byte of each code, and what they pass up.

    code is sorted and has whole subtrees, n says how often each was learnt. Returns the probability
    of each bit (codes x 8), counts by (DEPTH bytes, byte) and log weights by (DEPTH bytes, node)."""
    level, counts, up = [(code, n, None)], n, None
    for _ in range(DEEP - DEPTH):  # codes of each depth, and where those of the one below are in them
        below = level[-1][0]
        there, up = np.unique(below >> 16 << 8 | below & 255, return_inverse=True)
        counts = np.bincount(up, counts, len(there)).astype(np.int64)
        level.append((there, counts, up))
    low = np.empty((len(code), 8), np.float32)
    roots, passed = [], []
    for k in range(8):
        deeper, steps = None, []
        for depth, (there, counts, up) in enumerate(level[:-1]):
            node = there >> 8 - k
            first = _groups(node)
            which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(node))))
            total = np.add.reduceat(counts, first)
            one = np.add.reduceat(np.where(there >> 7 - k & 1, counts, 0), first)
            whole = _GAMMA(total - one, 0.5) + _GAMMA(one, 0.5) - _GAMMA(total, 1.0) - np.log(np.pi)
            whole[total == 0] = 0
            weight = np.ones(len(first))
            if deeper is not None:
                sums = np.bincount(which[level[depth][2][below]], deeper, len(first))
                weight = own_weight(whole, sums)
                whole = np.log(0.5) + np.logaddexp(whole, sums)
            steps.append(((one + 0.5) / (total + 1), weight, which))
            deeper, below = whole, first
        parent = level[-1][0][level[-1][2][below]]  # of the first code of each root
        roots.append((parent >> 8) << 8 | 1 << k | (parent & 255) >> 8 - k)
        passed.append(deeper)
        place, p = np.arange(len(code)), None
        for (estimated, weight, which), (_, _, up) in zip(steps, level[:-1], strict=True):
            place = place if up is None else up[place]
            node = which[place]
            p = estimated[node] if p is None else weight[node] * estimated[node] + (1 - weight[node]) * p
        low[:, k] = np.where(code >> 7 - k & 1, p, 1 - p)
    nodes, which = np.unique(np.concatenate(roots), return_inverse=True)
    return low, level[-1][0], level[-1][1], nodes, np.bincount(which, np.concatenate(passed), len(nodes))


class Table:
    """Values of 64-bit keys. Those that come first get a slot of their own, the rest are searched."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = keys.view(np.uint64)
        self.shift = np.uint64(64 - max(int(np.ceil(np.log2(2 * len(keys) + 1))), 1))
        slot = self._slot(keys)
        self.keys = np.zeros(1 << 64 - int(self.shift), np.uint64)
        self.values = np.zeros(len(self.keys), values.dtype)
        self.keys[slot[::-1]], self.values[slot[::-1]] = keys[::-1], values[::-1]
        rest = np.flatnonzero(self.keys[slot] != keys)
        rest = rest[np.argsort(keys[rest])]
        self.rest, self.rest_values = keys[rest], values[rest]

    def _slot(self, keys):
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64)
        slot = self._slot(keys)
        found = self.values[slot]
        missed = np.flatnonzero(self.keys[slot] != keys)
        if len(missed) and len(self.rest):
            found[missed] = self.rest_values[np.searchsorted(self.rest, keys[missed])]
        return found


def _lowered(texts):
    data, offsets = text_bytes(texts)
    for a, b in runs(offsets):
        yield a, b, LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]


_FOLDED = "fold long, doc_ids array<long>, learnt array<boolean>, edges binary, size long, text binary"
_CUT = "bucket int, fold long, keys binary, trained binary, codes binary, learnt binary"
_WEIGHED = "bucket int, folds array<long>, counts array<binary>, there array<binary>, n_distinct long, n_all long, codes binary, low binary, up binary, up_n binary, nodes binary, below binary"
_ANSWERS = "fold long, bucket int, counts binary, logs binary"
_SCORED = "doc_id long, learnt boolean, n_tokens long, n_bytes long, n_known long, base double, score double"


def _pack(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little") * np.dtype(kind).itemsize, codec="zstd"), kind)


def _fold_texts(batches):
    """Texts as they are read, some ten million bytes a row."""
    held, size = [], 0

    def row():
        out, at, ids, learnt = zip(*held, strict=True)
        edges = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for a in at]))]).astype(np.int64)
        rows = [{"fold": secrets.randbits(62), "doc_ids": pa.concat_arrays(ids).to_pylist(), "learnt": pa.concat_arrays(learnt).to_pylist(), "edges": _pack(edges), "size": int(edges[-1]), "text": _pack(np.concatenate(out))}]
        return pa.RecordBatch.from_pylist(rows, pa.schema([("fold", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("learnt", pa.list_(pa.bool_())), ("edges", pa.binary()), ("size", pa.int64()), ("text", pa.binary())]))

    for batch in batches:
        for a, b, data, offsets in _lowered(batch.column(0)):
            out, at, *_ = stream(data, offsets)
            held.append((out, at, batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)))
            size += len(out)
            if size >= FOLD_BYTES:
                yield row()
                held, size = [], 0
    if held:
        yield row()


def _words_of(out: np.ndarray, at: np.ndarray):
    """Placing hash, key and row of the words of each run of a stream."""
    for a, b in runs(at):
        data = out[at[a] : at[b]]
        starts, ends, row = word_spans(data, at[a : b + 1] - at[a])
        yield word_hash(data, starts, ends, _PLACE), word_hash(data, starts, ends, _KEY), a + row


def _by_bucket(bucket: np.ndarray, buckets: int):
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _summed(keys: np.ndarray, *counts: np.ndarray):
    """Distinct keys, the first place of each, and sums of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = _groups(keys)
    return keys[first], order[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in counts)


def _fold_words(out, at, learnt: np.ndarray, buckets: int):
    """Distinct words of a fold by bucket: keys, how often learnt, edges of the buckets."""
    parts = [(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))]
    for place, key, row in _words_of(out, at):
        distinct, first, times = _summed(key, learnt[row].astype(np.int64))
        parts.append((distinct, place[first], times))
    key, place, times = (np.concatenate(c) for c in zip(*parts, strict=True))
    key, first, times = _summed(key, times)
    order, edges = _by_bucket(bucket_of(place[first], buckets), buckets)
    return key[order], times[order], edges


def _fold_codes(out, at, learnt: np.ndarray, buckets: int):
    """Distinct deep contexts with their byte, by bucket and in order: codes, how often learnt, edges."""
    parts = []
    for a, b in runs(at, SORT_BYTES):
        both = deep_contexts(out[at[a] : at[b]], at[a : b + 1] - at[a]) << 1 | np.repeat(learnt[a:b], np.diff(at[a : b + 1]))
        both.sort()
        first = _groups(both)
        parts.append((both[first], np.diff(np.append(first, len(both)))))
    both, times = (np.concatenate(c) for c in zip(*parts, strict=True))
    code, _, times = _summed(both >> 1, np.where(both & 1, times, 0))
    order, edges = _by_bucket(bucket_of(mix(code >> 8 * (DEEP - DEPTH)), buckets), buckets)
    return code[order], times[order], edges


def _read(row):
    return _unpack(row["text"], np.uint8), _unpack(row["edges"], np.int64), np.array(row["learnt"], bool)


def _cut_fold(buckets):
    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                out, at, learnt = _read(row)
                key, trained, word_at = _fold_words(out, at, learnt, buckets)
                code, times, code_at = _fold_codes(out, at, learnt, buckets)
                rows = []
                for k in np.flatnonzero(np.diff(word_at) + np.diff(code_at)).tolist():
                    w, c = slice(word_at[k], word_at[k + 1]), slice(code_at[k], code_at[k + 1])
                    rows.append({"bucket": k, "fold": row["fold"], "keys": _pack(key[w]), "trained": _pack(trained[w]), "codes": _pack(np.diff(code[c], prepend=0)), "learnt": _pack(times[c])})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("fold", pa.int64())] + [(c, pa.binary()) for c in ("keys", "trained", "codes", "learnt")]))

    return cut


def _weigh_bucket(rows: pa.Table) -> pa.Table:
    """Corpus counts of the words of one bucket and weights of its contexts, and which each fold has."""
    lists = {c: [_unpack(k, t) for k in rows[c].to_pylist()] for c, t in (("keys", np.uint64), ("trained", np.int64), ("codes", np.int64), ("learnt", np.int64))}
    key, which = np.unique(np.concatenate(lists["keys"]), return_inverse=True)
    counts = np.bincount(which, np.concatenate(lists["trained"]), len(key)).astype(np.int64)
    words = np.split(counts[which], np.cumsum([len(k) for k in lists["keys"]])[:-1])
    each = [np.cumsum(c) for c in lists["codes"]]
    code, _, times = _summed(np.concatenate(each), np.concatenate(lists["learnt"]))
    there = [_pack(np.diff(np.searchsorted(code, c), prepend=0).astype(np.uint32)) for c in each]
    tops = np.append(_groups(code >> 8 * (DEEP - DEPTH)), len(code))
    found, a = [], 0
    while a < len(code):  # whole subtrees, about WEIGH contexts at once
        b = tops[max(np.searchsorted(tops, a + WEIGH, "right") - 1, np.searchsorted(tops, a, "right"))]
        found.append(weigh_subtrees(code[a:b], times[a:b]))
        a = b
    kinds = (np.float32, np.int64, np.int64, np.int64, np.float64)
    low, up, up_n, nodes, below = (np.concatenate([x.ravel() for x in c]) for c in zip(*found, strict=True)) if found else (np.empty(0, k) for k in kinds)
    row = {"bucket": rows["bucket"][0].as_py(), "folds": rows["fold"].to_pylist(), "counts": [_pack(w) for w in words], "there": there, "n_distinct": int((counts > 0).sum()), "n_all": int(counts.sum())}
    row |= {"codes": _pack(np.diff(code, prepend=0)), "low": _pack(low), "up": _pack(up), "up_n": _pack(up_n), "nodes": _pack(nodes), "below": _pack(below)}
    return pa.Table.from_pylist([row], pa.schema([("bucket", pa.int32()), ("folds", pa.list_(pa.int64())), ("counts", pa.list_(pa.binary())), ("there", pa.list_(pa.binary())), ("n_distinct", pa.int64()), ("n_all", pa.int64())] + [(c, pa.binary()) for c in ("codes", "low", "up", "up_n", "nodes", "below")]))


def _roots(batches):
    for batch in batches:
        for row in batch.to_pylist():
            up, n, nodes, below = (_unpack(row[c], t) for c, t in (("up", np.int64), ("up_n", np.int64), ("nodes", np.int64), ("below", np.float64)))
            yield pa.RecordBatch.from_pydict({"code": np.concatenate([up, nodes]), "node": np.arange(len(up) + len(nodes)) >= len(up), "n": np.concatenate([n, np.zeros(len(nodes), np.int64)]), "below": np.concatenate([np.zeros(len(up)), below])})


def fit_top(weighed: DataFrame) -> ContextTree:
    """The contexts of at most DEPTH bytes: at most 256 ** (DEPTH + 1) counts and as many weights."""
    roots = weighed.select("up", "up_n", "nodes", "below").mapInArrow(_roots, "code long, node boolean, n long, below double")
    in_order = F.aggregate(F.array_sort(F.collect_list("below")), F.lit(0.0), lambda a, b: a + b)  # the same sum in every run
    found = roots.groupBy("code", "node").agg(F.sum("n").alias("n"), in_order.alias("below")).toPandas()
    code, node = found["code"].to_numpy(np.int64), found["node"].to_numpy(bool)
    code = (code >> 8 & 255) << 16 | code >> 16 << 8 | code & 255
    return ContextTree.of(code[~node], found["n"].to_numpy(np.float64)[~node], code[node], found["below"].to_numpy(np.float64)[node])


def _answer(model):
    """For each fold of a bucket: corpus counts of its words, log probabilities of its contexts."""

    def answer(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                code, low = np.cumsum(_unpack(row["codes"], np.int64)), _unpack(row["low"], np.float32).reshape(-1, 8)
                logs = model.value.logs(code, low).astype(np.float32)
                found = [_pack(logs[np.cumsum(_unpack(t, np.uint32), dtype=np.int64)]) for t in row["there"]]
                yield pa.RecordBatch.from_pydict({"fold": pa.array(row["folds"], pa.int64()), "bucket": pa.array([row["bucket"]] * len(found), pa.int32()), "counts": pa.array(row["counts"], pa.binary()), "logs": pa.array(found, pa.binary())})

    return answer


def _score_fold(total: int, distinct: int, ends: int, buckets: int):
    """Scores of the documents of a fold from its words and contexts and what the corpus says of them."""

    def score(fold: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        parts = sorted(zip(answers["bucket"].to_pylist(), answers["counts"].to_pylist(), answers["logs"].to_pylist(), strict=True))
        counts = np.concatenate([np.empty(0, np.int64), *(_unpack(c, np.int64) for _, c, _ in parts)])
        logs = np.concatenate([np.empty(0, np.float32), *(_unpack(c, np.float32) for _, _, c in parts)])
        for row in fold.to_pylist():
            text, at, learnt = _read(row)
            n = len(at) - 1
            keys, times, _ = _fold_words(text, at, learnt, buckets)
            often = np.argsort(-times, kind="stable")
            words = Table(keys[often], np.log10(counts + 1)[often])
            code, times, _ = _fold_codes(text, at, learnt, buckets)
            often = np.argsort(-times, kind="stable")
            bytes_of = Table(code[often], logs[often])
            del keys, code, times, often
            n_words, known, sums, scores = np.zeros(n, np.int64), np.full(n, int(ends > 0)), np.full(n, np.log10(ends + 1)), np.zeros(n)
            for _, key, doc in _words_of(text, at):
                each = words[key]
                n_words += np.bincount(doc, minlength=n)
                known += np.bincount(doc[each > 0], minlength=n)
                sums += np.bincount(doc, each, n)
            for a, b in runs(at):
                here = at[a : b + 1] - at[a]
                scores[a:b] = np.add.reduceat(bytes_of[deep_contexts(text[at[a] : at[b]], here)].astype(np.float64), here[:-1])
            base = sums - (n_words + 1) * np.log10(total + distinct + 1)
            out.append(pa.Table.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "learnt": pa.array(row["learnt"], pa.bool_()), "n_tokens": n_words + 1, "n_bytes": np.diff(at), "n_known": known.astype(np.int64), "base": base, "score": scores}))
        return pa.concat_tables(out) if out else pa.schema([("doc_id", pa.int64()), ("learnt", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]).empty_table()

    return score


def score_documents(docs: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, learnt, n_tokens, n_known, train_tokens, base_score and score (log10
    probabilities), and bits_per_byte, the model's code length of the text as it reads it. The
    model and the base learn from the rows where learn is true."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col(key).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learnt"))
    size, ends = rows.agg(F.sum(F.octet_length("text")), F.count(F.when(F.col("learnt"), 1))).first()
    buckets = buckets_for(spark, (size or 0) / 16)
    folds = stored(rows.mapInArrow(_fold_texts, _FOLDED), "folds")
    weighed = stored(folds.mapInArrow(_cut_fold(buckets), _CUT).groupBy("bucket").applyInArrow(_weigh_bucket, _WEIGHED), "weights")
    distinct, total = weighed.agg(F.coalesce(F.sum("n_distinct"), F.lit(0)), F.coalesce(F.sum("n_all"), F.lit(0))).first()
    distinct, total = distinct + (ends > 0), total + ends
    model = spark.sparkContext.broadcast(fit_top(weighed))
    answers = weighed.select("bucket", "folds", "counts", "there", "codes", "low").mapInArrow(_answer(model), _ANSWERS)
    scored = folds.groupBy("fold").cogroup(answers.groupBy("fold")).applyInArrow(_score_fold(total, distinct, ends, buckets), _SCORED)
    return scored.select("doc_id", "learnt", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", (-F.col("score") / F.lit(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))

"""Language ID by unigram pieces, with all segmentations of a text summed.

Each language has a probability for every piece of a fixed public vocabulary; the
probability of a text is the sum over all ways to cut it into pieces, computed by the
forward algorithm. Pieces do not cross white space, so a text's probability is a product
over its words and a worker scores a distinct word once. Words are lower-cased (A-Z) and led
by a space; words of any length are walked whole, and pieces of any length take part.

Probabilities come from expectation maximisation over a bounded sample of labelled rows,
PER_LANG a language. The words of the sample stay in Spark: each round sends the
probabilities to the executors, which add up the expected counts of pieces, and the driver
holds one number for each piece and language that occur together.

Defined results: a text that is null or has no letter is `und` with score 0, and so is
every text if there was nothing to learn from; ties go to the language first in
alphabetical order; repeated rows repeat their result; other columns pass through.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import LOWER, SPACE, bounded_batches, dropped, mix, runs, stored, text_bytes, word_hash, word_spans

#: Labelled rows to learn from, a language at most: the documented bound of the sample.
PER_LANG = 400
#: Rounds of learning, least expected count of a piece.
ROUNDS, FLOOR = 3, 1e-3
UNKNOWN = "und"
#: Bytes of a piece that are its key; longer ones are told apart by their bytes. Bytes of words up to
#: which probabilities fit a float; beyond, logarithms are added.
KEY, PLAIN = 8, 24
#: Words a worker remembers, bytes of words walked at once, and parts of one in which expected counts are summed.
REMEMBER, WALK_BYTES, UNIT = 1 << 20, 1 << 16, 1 << 20


def vocabulary_path() -> str:
    """Pieces of the public 50k byte-level BPE vocabulary."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    return np.ndarray(len(data) + 1, np.uint64, np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


@dataclass
class Pieces:
    """The vocabulary's pieces, lower-cased: for each length the sorted keys and the number of the
    first. The key of a piece is its bytes packed little-endian, or a mixture of its first
    KEY bytes and its last if it is longer; then its bytes are kept for comparing."""

    keys: dict = field(default_factory=dict)
    first: dict = field(default_factory=dict)
    raw: dict = field(default_factory=dict)
    leads: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # first KEY bytes of longer pieces
    n: int = 0

    @classmethod
    def of(cls, path: str) -> Pieces:
        with open(path, "rb") as lines:
            found = {base64.b64decode(line.split()[0]).lower() for line in lines}
        found |= {bytes([b]) for b in range(256)}
        space = bytes(np.flatnonzero(SPACE).tolist())
        by_size: dict[int, list] = {}
        for piece in found:
            if not any(c in space for c in piece[1:]):
                by_size.setdefault(len(piece), []).append(piece)
        made, leads = cls(), []
        for length, some in sorted(by_size.items()):
            table = np.frombuffer(b"".join(sorted(some)), np.uint8).reshape(len(some), length)
            flat = table.ravel()
            key = cls.key(_eights(flat), np.arange(0, len(flat), length), length)
            order = np.argsort(key, kind="stable")
            made.keys[length], made.first[length], made.raw[length] = key[order], made.n, table[order]
            if length > KEY:
                leads.append(_eights(flat)[np.arange(0, len(flat), length)])
            made.n += len(some)
        made.leads = np.unique(np.concatenate([made.leads, *leads]))
        return made

    @staticmethod
    def key(eights: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        if length < KEY:
            return eights[at] & np.uint64((1 << 8 * length) - 1)
        return eights[at] if length == KEY else mix(eights[at]) + eights[at + length - KEY]

    def find(self, data: np.ndarray, eights: np.ndarray, at: np.ndarray, length: int):
        """Which of the places hold a piece of this length, and its number."""
        keys = self.keys[length]
        key = self.key(eights, at, length)
        i = np.searchsorted(keys, key)
        i[i == len(keys)] = 0
        there = np.flatnonzero(keys[i] == key)
        if length > KEY and len(there):  # several pieces may have one key only by chance; then the first counts
            same = (data[at[there][:, None] + np.arange(length)] == self.raw[length][i[there]]).all(axis=1)
            there = there[same]
        return there, i[there] + self.first[length]


class Lattice:
    """All pieces at all places of some words, each led by a space."""

    def __init__(self, pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts + 1
        self.base = np.cumsum(size) - size  # of each word in the flat text; node base + word number + place
        flat = np.full(int(size.sum()), 0x20, np.uint8)
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(flat)) - self.base[word]
        inside = place > 0
        flat[inside] = data[(starts[word] + place - 1)[inside]]
        left = size[word] - place
        eights = _eights(flat)
        parts = [(np.empty(0, np.int64),) * 3]
        some = np.arange(len(flat))
        for length in pieces.keys:
            if length == KEY + 1 and len(pieces.leads):
                i = np.searchsorted(pieces.leads, eights[some])
                some = some[pieces.leads[np.minimum(i, len(pieces.leads) - 1)] == eights[some]]
            some = some[left[some] >= length]
            there, piece = pieces.find(flat, eights, some, length)
            at = some[there]
            parts.append((at + word[at], np.full(len(at), length), piece))
        begin, length, self.piece = (np.concatenate(c) for c in zip(*parts, strict=True))
        self.begin, self.end = begin, begin + length
        self.first, self.last = self.base + np.arange(len(size)), self.base + np.arange(len(size)) + size
        self.nodes = len(flat) + len(size)
        self.size, self.length = size, length

    def _steps(self, ends: bool):
        """Arcs of one step (all that end, or begin, at one place of their word), and where groups by node start."""
        first_of = np.repeat(self.first, self.size + 1)
        node = self.end if ends else self.begin
        place = node - first_of[node]
        order = np.lexsort((node, place))
        edges = np.flatnonzero(np.diff(place[order], prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
            arcs = order[a:b]
            yield arcs, np.flatnonzero(np.diff(node[arcs], prepend=-1))

    def forward(self, prob: np.ndarray, logs: bool = False) -> np.ndarray:
        """Probability (or its logarithm) of all segmentations of each word up to each node, a column a language."""
        alpha = np.full((self.nodes, prob.shape[1]), -np.inf if logs else 0.0)
        alpha[self.first] = 0 if logs else 1
        for arcs, group in self._steps(ends=True):
            self._add(alpha, self.end[arcs][group], alpha[self.begin[arcs]], prob[self.piece[arcs]], group, logs)
        return alpha

    def backward(self, prob: np.ndarray, logs: bool = False) -> np.ndarray:
        """The same from each node to the end of its word."""
        beta = np.full((self.nodes, prob.shape[1]), -np.inf if logs else 0.0)
        beta[self.last] = 0 if logs else 1
        for arcs, group in reversed(list(self._steps(ends=False))):
            self._add(beta, self.begin[arcs][group], beta[self.end[arcs]], prob[self.piece[arcs]], group, logs)
        return beta

    @staticmethod
    def _add(table, nodes, before, prob, group, logs):
        if logs:
            each = before + prob
            most = np.maximum.reduceat(each, group)
            size = np.diff(np.append(group, len(each)))
            table[nodes] = most + np.log(np.add.reduceat(np.exp(each - np.repeat(most, size, axis=0)), group))
        else:
            table[nodes] = np.add.reduceat(before * prob, group)

    def totals(self, prob: np.ndarray, logs: bool) -> np.ndarray:
        """Log probability of each word."""
        alpha = self.forward(np.log(prob) if logs else prob, logs)[self.last]
        return alpha if logs else np.log(alpha)

    def expected(self, prob: np.ndarray, weight: np.ndarray, logs: bool) -> np.ndarray:
        """Expected count of each piece, given how often each word occurs in each language."""
        p = np.log(prob) if logs else prob
        alpha, beta = self.forward(p, logs), self.backward(p, logs)
        word = np.repeat(np.arange(len(self.size)), self.size + 1)[self.begin]
        total = alpha[self.last][word]
        share = np.exp(alpha[self.begin] + p[self.piece] + beta[self.end] - total) if logs else alpha[self.begin] * p[self.piece] * beta[self.end] / total
        share *= weight[word]
        return np.stack([np.bincount(self.piece, share[:, lang], len(prob)) for lang in range(prob.shape[1])], axis=1)


def lattices(pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(indices of words, their lattice, whether to add logarithms): words of like size, some at once."""
    order = np.argsort(ends - starts, kind="stable")
    size = (ends - starts)[order] + 1
    sums, long, a = np.cumsum(size), int(np.searchsorted(size, PLAIN, "right")), 0
    while a < len(order):
        b = max(int(np.searchsorted(sums, (sums[a - 1] if a else 0) + WALK_BYTES, "right")), a + 1)
        if a < long < b:
            b = long
        some = order[a:b]
        yield some, Lattice(pieces, data, starts[some], ends[some]), a >= long
        a = b


class Scorer:
    """Log probabilities of words in each language; remembers the words it has scored."""

    def __init__(self, pieces: Pieces, prob: np.ndarray):
        self.pieces, self.prob = pieces, prob
        self.forget()

    def forget(self) -> None:
        self.known, self.logs = np.empty(0, np.uint64), np.empty((0, self.prob.shape[1]))

    def fresh(self, data, starts, ends) -> np.ndarray:
        logs = np.empty((len(starts), self.prob.shape[1]))
        for some, lattice, long in lattices(self.pieces, data, starts, ends):
            logs[some] = lattice.totals(self.prob, long)
        return logs

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sum over the words of each row."""
        starts, ends, rows = word_spans(data, offsets)
        words, first, which = np.unique(word_hash(data, starts, ends, 11), return_index=True, return_inverse=True)
        new = ~np.isin(words, self.known, assume_unique=True)
        if new.any():
            logs = self.fresh(data, starts[first[new]], ends[first[new]])
            if len(self.known) + len(logs) > REMEMBER:
                self.forget()
                new = np.ones(len(words), bool)
                logs = self.fresh(data, starts[first], ends[first])
            at = np.searchsorted(self.known, words[new])
            self.known, self.logs = np.insert(self.known, at, words[new]), np.insert(self.logs, at, logs, axis=0)
        logs = self.logs[np.searchsorted(self.known, words)]
        n = len(offsets) - 1
        return np.stack([np.bincount(rows, logs[which, k], n) for k in range(logs.shape[1])], axis=1) if len(rows) else np.zeros((n, self.prob.shape[1]))


@dataclass
class LanguageModel:
    langs: list[str]
    pieces: Pieces
    prob: np.ndarray  # piece x language


def chosen_rows(labelled: DataFrame, *, key: str, text: str, lang: str, per_lang: int) -> DataFrame:
    """(text, lang) of at most per_lang rows of each language, those of least hashed id."""
    usable = labelled.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null and id is not null").withColumn("place", F.xxhash64("id"))
    # a hash bound leaves a few times per_lang rows of a language, however many it has
    bounds = usable.groupBy("lang").agg(F.count("*").alias("n")).select(F.col("lang").alias("_lang"), F.expr(f"least(1.0D, {4 * per_lang}D / n)").alias("part"))
    near = usable.join(F.broadcast(bounds), F.col("lang") == F.col("_lang")).filter(f"part >= 1 or place / {2.0**64} + 0.5 <= part")
    nth = F.row_number().over(W.partitionBy("lang").orderBy("place", "id", F.xxhash64("text")))
    return near.withColumn("nth", nth).filter(F.col("nth") <= per_lang).select("text", "lang")


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) of (text, lang): lower-cased words of each language with their counts."""

    def count(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            data = LOWER[data]
            starts, ends, rows = word_spans(data, offsets)
            raw = data.tobytes()
            yield pa.RecordBatch.from_pydict({"lang": batch.column(1).take(pa.array(rows)), "word": pa.array([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())})

    return labelled.select("text", "lang").mapInArrow(count, "lang string, word binary").groupBy("lang", "word").agg(F.count("*").alias("n"))


def expected_counts(words: DataFrame, model) -> DataFrame:
    """(lang, piece, n): expected counts in UNITs under the broadcast (pieces, probabilities, languages)."""

    def count(batches):
        pieces, prob, langs = model.value
        sums = np.zeros_like(prob)
        for batch in batches:
            if batch.num_rows:
                data, offsets = text_bytes(batch.column("word"))
                weight = np.zeros((batch.num_rows, len(langs)))
                weight[np.arange(batch.num_rows), np.searchsorted(np.array(langs, object), np.array(batch.column("lang").to_pylist(), object))] = batch.column("n").to_numpy()
                for some, lattice, long in lattices(pieces, data, offsets[:-1], offsets[1:]):
                    sums += np.rint(lattice.expected(prob, weight[some], long) * UNIT)
        piece, lang = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.int32()), "piece": pa.array(piece, pa.int32()), "n": pa.array(sums[piece, lang].astype(np.int64))})

    return words.mapInArrow(count, "lang int, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def fit_language(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, path: str | None = None) -> LanguageModel:
    """Learn piece probabilities from at most per_lang rows of each language, those of least hashed id.
    The driver holds a number for each piece of the vocabulary and language, whatever the corpus."""
    spark = labelled.sparkSession
    words = stored(word_counts(chosen_rows(labelled, key=key, text=text, lang=lang, per_lang=per_lang)).repartition("word").sortWithinPartitions("word", "lang"), "words")
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    pieces = Pieces.of(path or vocabulary_path())
    prob = np.full((pieces.n, len(langs)), 1e-3)
    for _ in range(ROUNDS if langs else 0):
        shared = spark.sparkContext.broadcast((pieces, prob, langs))
        found = expected_counts(words, shared).toArrow()
        counts = np.full_like(prob, FLOOR)
        counts[found["piece"].to_numpy(), found["lang"].to_numpy()] += found["n"].to_numpy() / UNIT
        prob = counts / counts.sum(axis=0)
        shared.destroy()
    dropped(words)
    return LanguageModel(langs, pieces, prob)


def language_of(text: Column, model: LanguageModel, spark) -> Column:
    """struct<lang, score> of a text column: the likeliest language and its posterior probability."""
    bounded_batches(spark)
    shared, workers = spark.sparkContext.broadcast((model.pieces, model.prob, model.langs)), {}

    @F.arrow_udf("struct<lang:string,score:double>")
    def identify(texts: pa.Array) -> pa.Array:
        pieces, prob, langs = shared.value
        scorer = workers.setdefault("scorer", Scorer(pieces, prob))
        data, offsets = text_bytes(texts)
        sums = [scorer.rows(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]) for a, b in runs(offsets)]
        logs = np.concatenate([np.zeros((0, len(langs))), *sums])
        best = logs.argmax(axis=1)
        score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array([langs[b] for b in best], pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if not model.langs:
        return nothing
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), identify(text)).otherwise(nothing)


def identify_languages(docs: DataFrame, model: LanguageModel, *, text: str = "text", out: str = "language") -> DataFrame:
    """docs with an added struct<lang, score>."""
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    return docs.withColumn(out, language_of(F.col(text), model, docs.sparkSession))

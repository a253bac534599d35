"""Collocations: phrases of two to four words, counted in a weighted de Bruijn graph.

Texts are split into pieces and pieces into words, per language. Nodes of the graph are three
words, edges are four words, which join two nodes that overlap; an edge's weight is its number of
occurrences, and the last words of a piece, which start no edge, are kept as ends. Only edges and
ends are counted, once each; every shorter count is derived: the flow through a node is what its
edges and ends weigh, the count of two words is the flow of the nodes they start and of their
ends, and so on down to single words. A node with one edge and no end has that edge's weight, so
it is not kept by itself but compacted into the edge, and a path of such nodes with it.

No phrase of a count of LEAST has two neighbours that occur together less often. So tasks first
exchange counts of neighbours, and the graph is built from what is left, where a rare pair ends a
piece: the ends make up for it, and counts of words stay whole. A task folds some million words;
it sends each distinct pair, edge and end once, dictionary-coded by bucket of the first two words.
Edges of very common pairs (known from the first exchange) are dealt by three words instead.

Words are 64-bit hashes that include their language (see `word_hash`); among n distinct words
n * n / 2**65 wrong equalities are expected. Everything else is exact: pairs are compared by
shorter keys only to leave out rare ones, where a wrong equality leaves one in.

Defined results: a null text has no words, a null language is `und`; empty pieces are none; words
are of any length; equal rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import LOWER, buckets_for, dropped, mix, runs, stored, text_bytes, word_hash
from pagemill.operators.ordered import place_overall

#: Least count of a phrase, per cent of it that a longer phrase has to reach to stand for it, phrases of a language, language of rows without one.
LEAST, COVERED, BEST, UNKNOWN = 30, 80, 2000, "und"
#: Words folded at once.
FOLD = 1_000_000

#: Bytes that end a piece, and bytes between words.
_END = np.zeros(256, bool)
_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _END.copy()
_GAP[[0x20, 0x09]] = True
_U = np.uint64


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Start, end and row of each word, and whether its piece ends with it."""
    solid = ~_GAP[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before = np.concatenate([[False], solid[:-1]])
    after = np.concatenate([solid[1:], [False]])
    starts = np.flatnonzero(solid & (~before | border[:-1]))
    ends = np.flatnonzero(solid & (~after | border[1:])) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    marks = np.concatenate([[0], np.cumsum(_END[data])])
    last = np.ones(len(starts), bool)
    if len(starts):
        last[:-1] = (row[1:] != row[:-1]) | (marks[starts[1:]] != marks[ends[:-1]])
    return starts, ends, row, last


def _language(name: str) -> int:
    raw = np.frombuffer(name.encode(), np.uint8)
    return int(word_hash(raw, np.array([0]), np.array([len(raw)]), 8)[0])


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0x9E3779B97F4A7C15) ^ mix(b))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


class Fold:
    """Words of a fold by their place in its dictionary, which ids has; last: the piece ends."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.word, self.last = ids, (codes >> 1).astype(np.int64), (codes & 1).astype(bool)

    def pairs(self, buckets: int):
        """Distinct neighbours in the order in which they are sent: (first, second, count, bucket, key), and their number at each place (-1: none)."""
        at = np.flatnonzero(~self.last)
        code, inverse, count = np.unique(self.word[at] * len(self.ids) + self.word[np.minimum(at + 1, len(self.word) - 1)], return_inverse=True, return_counts=True)
        first, second = np.divmod(code, max(len(self.ids), 1))
        key = _pair_key(self.ids[first], self.ids[second])
        bucket, short = _bucket(key, buckets), (key & _U(0xFFFFFFFF)).astype(np.uint32)
        order = np.lexsort((code, short, bucket))
        number = np.full(len(self.word), -1)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        number[at] = place[inverse]
        return first[order], second[order], count[order], bucket[order], short[order], number


def _edges(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first, after last) of the runs of a sorted array."""
    if not len(sorted_values):
        return []
    start = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))
    return list(zip(sorted_values[start].tolist(), start.tolist(), np.append(start[1:], len(sorted_values)).tolist(), strict=True))


_FOLDS = "fold long, ids binary, codes binary, texts array<string>, langs array<string>, n array<struct<lang string, n long>>"
_FOLDS_ARROW = pa.schema([("fold", pa.int64()), ("ids", pa.binary()), ("codes", pa.binary()), ("texts", pa.list_(pa.string())), ("langs", pa.list_(pa.string())), ("n", pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])))])


def _fold_texts(batches):
    """Folds of consecutive texts: dictionary (commonest first), its texts and languages, and the words."""
    held, size = [], 0

    def flush():
        ids, last, lang, data, starts, ends = (np.concatenate(c) for c in zip(*held, strict=True))
        known, first, inverse, count = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = (place[inverse] << 1 | last).astype(np.uint32)
        raw = data.tobytes()
        texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[first[order]].tolist(), ends[first[order]].tolist(), strict=True)]
        names = [languages[i] for i in lang[first[order]].tolist()]
        totals = np.bincount(lang, minlength=len(languages))
        row = {"fold": 0, "ids": known[order].tobytes(), "codes": codes.tobytes(), "texts": texts, "langs": names, "n": [{"lang": languages[i], "n": int(t)} for i, t in enumerate(totals.tolist()) if t]}
        return pa.RecordBatch.from_pylist([row], _FOLDS_ARROW)

    languages: list[str] = []
    number: dict[str, int] = {}
    seeds: list[int] = []
    at = 0  # bytes held
    for batch in batches:
        whole, offsets = text_bytes(batch.column("text"))
        names = batch.column("lang").fill_null(UNKNOWN).to_pylist()
        for name in names:
            if name not in number:
                number[name] = len(languages)
                languages.append(name)
                seeds.append(_language(name))
        which = np.array([number[name] for name in names], np.int64)
        for a, b in runs(offsets):
            data = LOWER[whole[offsets[a] : offsets[b]]]
            starts, ends, row, last = words_of(data, offsets[a : b + 1] - offsets[a])
            if not len(starts):
                continue
            lang = which[a + row]
            ids = mix(word_hash(data, starts, ends, 7) ^ mix(np.array(seeds, np.uint64)[lang]))
            ids[ids == 0] = 1  # 0 stands for no word
            held.append((ids, last, lang, data, starts + at, ends + at))
            size, at = size + len(ids), at + len(data)
            if size >= FOLD:
                yield flush()
                held, size, at = [], 0, 0
    if size:
        yield flush()


_PAIRS = "bucket int, fold long, keys binary, counts binary"


def _send_pairs(buckets: int):
    def send(batches):
        for batch in batches:
            for name, ids, codes in zip(*(batch.column(c).to_pylist() for c in ("fold", "ids", "codes")), strict=True):
                _, _, count, bucket, short, _ = Fold(np.frombuffer(ids, np.uint64), np.frombuffer(codes, np.uint32)).pairs(buckets)
                rows = [{"bucket": k, "fold": name, "keys": short[a:b].tobytes(), "counts": np.minimum(count[a:b], 2**32 - 1).astype(np.uint32).tobytes()} for k, a, b in _edges(bucket)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("fold", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return send


def _judge_pairs(least: int, hot: int):
    def judge(rows: pa.Table) -> pa.Table:
        """For each pair of each fold: 0 rare, 1 of a count of least, 2 very common."""
        keys = [np.frombuffer(k, np.uint32) for k in rows["keys"].to_pylist()]
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in rows["counts"].to_pylist()]).astype(np.float64)
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, counts)
        told = ((total >= least).astype(np.uint8) + (total >= hot))[inverse].astype(np.uint8)
        ends = np.cumsum([len(k) for k in keys])
        parts = [told[e - len(k) : e].tobytes() for e, k in zip(ends.tolist(), keys, strict=True)]
        return pa.table({"fold": rows["fold"], "bucket": rows["bucket"], "told": pa.array(parts, pa.binary())})

    return judge


_GRAMS = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("places", pa.binary()), ("counts", pa.binary())])


def _send_grams(buckets: int):
    def send(folds: pa.Table, told: pa.Table) -> pa.Table:
        """Edges and ends of a fold, by bucket: distinct words, places of the four words of each among them, and counts."""
        rows = []
        if folds.num_rows:
            fold = Fold(np.frombuffer(folds["ids"][0].as_py(), np.uint64), np.frombuffer(folds["codes"][0].as_py(), np.uint32))
            first, second, _, _, _, number = fold.pairs(buckets)
            said = sorted(zip(told["bucket"].to_pylist(), told["told"].to_pylist(), strict=True))
            state = np.frombuffer(b"".join(s for _, s in said), np.uint8)
            n, none = len(fold.word), len(first) + len(fold.ids)
            linked = np.zeros(n + 3, bool)
            linked[:n] = (number >= 0) & (np.append(state, 0)[number] > 0)
            # A gram is two halves: a pair, a single word, or nothing.
            half = np.full(n + 3, none)
            half[:n] = np.where(linked[:n], number, len(first) + fold.word)
            rest = np.where(linked[:n] & linked[1 : n + 1], half[2 : n + 2], none)
            code, count = np.unique(half[:n] * (none + 1) + rest, return_counts=True)
            left, right = np.divmod(code, none + 1)
            empty = len(fold.ids)  # no word
            ones = np.concatenate([first, np.arange(len(fold.ids)), [empty]])
            twos = np.concatenate([second, np.full(len(fold.ids) + 1, empty)])
            gram = np.stack([ones[left], twos[left], ones[right], twos[right]])
            ids = np.append(fold.ids, _U(0))
            key = _pair_key(ids[gram[0]], ids[gram[1]])
            common = np.concatenate([state == 2, np.zeros(len(fold.ids) + 1, bool)])[left]
            key = np.where(common, _pair_key(key, ids[gram[2]]), key)
            bucket = _bucket(key, buckets)
            order = np.lexsort((code, bucket))
            gram, count = gram[:, order], count[order]
            for k, a, b in _edges(bucket[order]):
                own, places = np.unique(gram[:, a:b], return_inverse=True)
                kind = np.uint16 if len(own) < 1 << 16 else np.uint32
                rows.append({"bucket": k, "words": ids[own].tobytes(), "places": places.astype(kind).tobytes(), "counts": count[a:b].astype(np.uint32).tobytes()})
        return pa.Table.from_pylist(rows, _GRAMS)

    return send


_COUNTS = "size int, w1 long, w2 long, w3 long, w4 long, f long, alone boolean"
_COUNTS_ARROW = pa.schema([("size", pa.int32()), *((f"w{i}", pa.int64()) for i in range(1, 5)), ("f", pa.int64()), ("alone", pa.bool_())])


def _weigh(least: int):
    def weigh(rows: pa.Table) -> pa.Table:
        """Counts of a bucket: edges of a weight of least (alone: their node is compacted into them), other
        nodes of such a flow, and the flow of each pair and word that its nodes and ends here give."""
        parts, counts = [], []
        for words, places, count in zip(*(rows[c].to_pylist() for c in ("words", "places", "counts")), strict=True):
            weight = np.frombuffer(count, np.uint32)
            kind = np.uint16 if len(places) == 8 * len(weight) else np.uint32
            parts.append(np.frombuffer(words, np.uint64)[np.frombuffer(places, kind).reshape(4, -1)])
            counts.append(weight)
        gram, weight = np.concatenate(parts, axis=1), np.concatenate(counts).astype(np.int64)
        order = np.lexsort(gram[::-1])
        gram, weight = gram[:, order], weight[order]
        out: list[tuple] = []

        def summed(depth: int):
            """Runs of equal first words: start of each, and weight."""
            new = np.append(True, (gram[:depth, 1:] != gram[:depth, :-1]).any(axis=0))
            start = np.flatnonzero(new)
            return start, np.add.reduceat(weight, start)

        def give(size: int, start: np.ndarray, f: np.ndarray, alone: np.ndarray):
            blank = [gram[i, start] if i < size else np.zeros(len(start), np.uint64) for i in range(4)]
            out.append((np.full(len(start), size, np.int32), *(b.view(np.int64) for b in blank), f, alone))

        start, f = summed(4)
        node, flow = summed(3)
        one = np.diff(np.append(np.searchsorted(start, node), len(start))) == 1
        only = np.repeat(one, np.diff(np.append(np.searchsorted(start, node), len(start))))
        edge = (gram[3, start] > 0) & (f >= least)
        give(4, start[edge], f[edge], only[edge])
        kept = (gram[2, node] > 0) & (flow >= least) & ~(one & (gram[3, node] > 0))
        give(3, node[kept], flow[kept], np.zeros(int(kept.sum()), bool))
        pair, flow = summed(2)
        kept = gram[1, pair] > 0
        give(2, pair[kept], flow[kept], np.zeros(int(kept.sum()), bool))
        give(1, pair[~kept], flow[~kept], np.zeros(int((~kept).sum()), bool))
        return pa.Table.from_arrays([pa.array(np.concatenate(c), t.type) for c, t in zip(zip(*out, strict=True), _COUNTS_ARROW, strict=True)], schema=_COUNTS_ARROW)

    return weigh


def _phrase_counts(docs: DataFrame, lang: str, text: str, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored: counts (see _weigh), lexicon (word, lang, text, f) of words of a count of least, and n of each language."""
    spark = docs.sparkSession
    texts = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    folds = stored(texts.mapInArrow(_fold_texts, _FOLDS).withColumn("fold", F.monotonically_increasing_id()), "folds")
    totals = stored(folds.select(F.explode("n").alias("n")).groupBy("n.lang").agg(F.sum("n.n").alias("n")), "totals")
    n = totals.agg(F.sum("n")).first()[0] or 0
    buckets = buckets_for(spark, n)
    codes = folds.select("fold", "ids", "codes")
    told = stored(codes.mapInArrow(_send_pairs(buckets), _PAIRS).groupBy("bucket").applyInArrow(_judge_pairs(least, max(least, n // (8 * buckets))), "fold long, bucket int, told binary"), "told")
    grams = codes.groupBy("fold").cogroup(told.groupBy("fold")).applyInArrow(_send_grams(buckets), "bucket int, words binary, places binary, counts binary")
    counts = stored(grams.groupBy("bucket").applyInArrow(_weigh(least), _COUNTS), "counts")
    dropped(told)
    frequent = counts.filter("size <= 2").groupBy("w1").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    words = folds.select(F.col("ids"), "texts", "langs").mapInArrow(_dictionary, "word long, text string, lang string")
    lexicon = stored(words.join(frequent.withColumnRenamed("w1", "word"), "word").groupBy("word", "f").agg(F.min("lang").alias("lang"), F.min("text").alias("text")), "lexicon")
    dropped(folds)
    return counts, lexicon, totals


def _dictionary(batches):
    for batch in batches:
        for ids, texts, langs in zip(batch.column("ids").to_pylist(), batch.column("texts"), batch.column("langs"), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), texts.values, langs.values], names=["word", "text", "lang"])


def collocations(docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = LEAST, covered: int = COVERED, best: int = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language, by their least sure cut."""
    counts, lexicon, totals = _phrase_counts(docs, lang, text, least)
    words, no = ["w1", "w2", "w3", "w4"], F.lit(0).cast("long")
    fours = counts.filter("size = 4").select(*words, "f", "alone")
    threes = counts.filter("size = 3").select("w1", "w2", "w3", "f").union(fours.filter("alone").select("w1", "w2", "w3", "f"))
    twos = stored(counts.filter("size = 2").groupBy("w1", "w2").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "twos")

    # What stands for a shorter phrase: the commonest longer one that holds it.
    def inside(longer: DataFrame, *starts: tuple[int, int]) -> DataFrame:
        subs = [F.struct(*((F.col(words[a + i]) if i < b - a else no).alias(words[i]) for i in range(4))) for a, b in starts]
        return longer.select("f", F.explode(F.array(*subs)).alias("p")).select("p.*", F.col("f").alias("more"))

    subs = inside(fours, (0, 3), (1, 4), (0, 2), (1, 3), (2, 4)).union(inside(threes.select("*", no.alias("w4")), (0, 2), (1, 3)))
    subs = subs.groupBy(*words).agg(F.max("more").alias("more"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    # A compacted node is inside its edge, of the same count.
    shorter = counts.filter("size = 3").select(*words, "f").union(twos.select("w1", "w2", no.alias("w3"), no.alias("w4"), "f"))
    open_ones = shorter.join(subs, words, "left").filter(F.coalesce(100 * big("more") < covered * big("f"), F.lit(True))).drop("more")
    kept = stored(open_ones.union(fours.select(*words, "f")), "phrases")

    def count_of(rows: DataFrame, table: DataFrame, keys: list[str], out: str) -> DataFrame:
        own = table.select(*(F.col(f"w{i + 1}").alias(f"_{k}") for i, k in enumerate(keys)), F.col("f").alias(out))
        for k in keys:
            rows = rows.withColumn(f"_{k}", F.col(k))
        return rows.join(own, [f"_{k}" for k in keys]).drop(*(f"_{k}" for k in keys))

    ones = lexicon.select(F.col("word").alias("w1"), "f")

    def scored(size: int) -> DataFrame:
        rows = kept.filter((F.col("w3") == 0) if size == 2 else (F.col("w3") != 0) & ((F.col("w4") == 0) if size == 3 else (F.col("w4") != 0)))
        tables = {1: ones, 2: twos, 3: threes}
        cuts = []
        for k in range(1, size):
            rows = count_of(count_of(rows, tables[k], words[:k], f"l{k}"), tables[size - k], words[k:size], f"r{k}")
            score = F.expr(f"cast((cast(f as decimal(20,0)) * 2000000) div (cast(l{k} as decimal(20,0)) + r{k}) as long)")
            cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        cut = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        return rows.withColumn("cut", cut).select(*words, F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")

    found = scored(2).union(scored(3)).union(scored(4))
    found = found.join(lexicon.select(F.col("word").alias("w1"), "lang", F.col("text").alias("t1")), "w1")
    # Of each language the best of each part, with all that tie; texts and places of these only.
    salt = F.pmod(F.xxhash64(*words), F.lit(64))
    placing = F.rank().over(W.partitionBy("lang", salt).orderBy(F.desc("score"), F.desc("a")))
    few = found.withColumn("n", placing).filter(F.col("n") <= best).drop("n")
    for i in (2, 3, 4):
        few = few.join(lexicon.select(F.col("word").alias(f"w{i}"), F.col("text").alias(f"t{i}")), f"w{i}", "left")
    few = stored(few.select("lang", F.concat_ws(" ", "t1", "t2", "t3", "t4").alias("phrase"), "a", "l", "r", "score"), "few")
    placed = stored(place_overall(few, ["lang", F.desc("score"), F.desc("a"), "phrase"]), "placed")
    firsts = placed.groupBy("lang").agg(F.min("place").alias("first")).join(totals, "lang")
    ranked = placed.join(firsts, "lang").withColumn("rank", (F.col("place") - F.col("first") + 1).cast("long")).filter(F.col("rank") <= best)
    dropped(counts, kept)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""The suffix sort by a difference cover against sorting suffixes in plain Python."""

import random

from pyspark.sql import functions as F

from pagemill.llm import byte_repeats, suffix_sort


def rows_of(spark, sequences):
    rows = [(i, 0, k, 10 * k, s, i * 1000 + k) for i, seq in enumerate(sequences) for k, s in enumerate(seq)]
    return spark.createDataFrame(rows, "uid long, part int, k int, pos int, symbol long, value long")


def test_sample_names_are_in_suffix_order(spark):
    rng = random.Random(2)
    sequences = [[rng.randint(1, 3) for _ in range(rng.randint(1, 40))] for _ in range(12)] + [[1] * 30, [1] * 30, [2]]
    named = suffix_sort.sample_names(rows_of(spark, sequences), depth=10_000).collect()
    sample = [(tuple(sequences[r.uid][r.k :]), r.name) for r in named if r.k % 3]
    assert sample and all(r.name is None for r in named if not r.k % 3)
    for (a, x), (b, y) in zip(sorted(sample), sorted(sample)[1:]):
        assert (x < y) if a < b else (x == y)


def test_sequences_that_are_deep_enough_stay_apart_from_later_rounds(spark, monkeypatch):
    """Sequence 0 has short symbols and goes on for some rounds, sequence 1 is done after the first of them."""
    rng = random.Random(5)
    sequences = [[1] * 150, [rng.randint(1, 2) for _ in range(40)], [1] * 4]
    rows = [(i, 0, k, k if i == 0 else 10 * k, s) for i, seq in enumerate(sequences) for k, s in enumerate(seq)]
    rounds, keep = [], suffix_sort.stored

    def stored(df, label):
        out = keep(df, label)
        if label == "some":
            rounds.append({r.uid for r in out.select("uid").distinct().collect()})
        return out

    monkeypatch.setattr(suffix_sort, "stored", stored)
    named = suffix_sort.sample_names(spark.createDataFrame(rows, "uid long, part int, k int, pos int, symbol long"), depth=120).collect()
    assert len(rounds) > 1 and rounds[0] == {0, 1} and rounds[-1] == {0}
    assert len(named) == len(rows)
    sample = sorted((tuple(sequences[r.uid][r.k :]), r.name) for r in named if r.k % 3)
    for (a, x), (b, y) in zip(sample, sample[1:]):
        assert x <= y if a[:120] == b[:120] else x < y


def test_names_reach_as_deep_as_asked(spark):
    sequences = [[1, 2, 3, 4, 5, 6, 7, 8, 9] * 4, [1, 2, 3, 4, 5, 6, 7, 8, 9] * 4]
    shallow = suffix_sort.sample_names(rows_of(spark, sequences), depth=10).collect()
    assert len({r.name for r in shallow if r.k in (1, 10)}) == 1  # three symbols are ten deep
    deep = suffix_sort.sample_names(rows_of(spark, sequences), depth=100_000).collect()
    assert len({r.name for r in deep if r.k in (1, 10)}) == 2


def test_neighbours_meet_over_all_pairs_of_classes(spark):
    rng = random.Random(3)
    depth, sequences = 8, [[rng.randint(1, 2) for _ in range(60)] for _ in range(6)]
    strings = {}
    for i, seq in enumerate(sequences):
        for k in range(len(seq) - depth + 1):
            strings.setdefault(tuple(seq[k : k + depth]), []).append((i, k))
    value = {place: n for n, places in enumerate(strings.values()) for place in places}
    rows = [(i, 0, k, k, s, value.get((i, k))) for i, seq in enumerate(sequences) for k, s in enumerate(seq)]
    named = suffix_sort.sample_names(spark.createDataFrame(rows, "uid long, part int, k int, pos int, symbol long, value long"), depth=depth)
    got = {r.value for r in suffix_sort.neighbours(named, "value").collect()}
    assert got == {n for n, places in enumerate(strings.values()) if len(places) > 1}
    for classes in ({0, 1}, {0, 2}, {1, 2}, {0}, {1}, {2}):  # each pair of classes alone
        only = named.withColumn("value", F.when((F.col("k") % 3).isin(*classes), F.col("value")))
        want = {n for n, places in enumerate(strings.values()) if sum(k % 3 in classes for _, k in places) > 1}
        assert {r.value for r in suffix_sort.neighbours(only, "value").collect()} == want


def test_empty_sequences(spark):
    none = rows_of(spark, [])
    assert suffix_sort.neighbours(suffix_sort.sample_names(none, depth=5), "value").count() == 0


def test_phrases_of_equal_stretches_are_alike():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 1500).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, n).astype(np.uint8), passage, rng.integers(97, 123, 50).astype(np.uint8)]) for n in (10, 333)]
    data, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    at, name = byte_repeats.prefixes(data, offsets, byte_repeats.picks(data))
    row = byte_repeats._rows(offsets, at)
    shared = [np.intersect1d(name[row == 0], name[row == 1]).astype(np.uint32).tobytes()] * 2
    batch = pa.RecordBatch.from_pydict({"keys": pa.array(shared, pa.binary())})
    where, part, k, pos, phrase, key = byte_repeats.phrases(data, offsets, batch, 0, 2)
    cut = [[p for p, w in zip(phrase.to_pylist(), where.tolist()) if w == i] for i in range(2)]
    assert len(cut[0]) > 10 and cut[0][:-1] == cut[1][:-1]
    assert all(not b.startswith(a) for a in set(cut[0]) for b in set(cut[0]) if a != b and len(a) < byte_repeats.WINDOW)
    keys = [[v for v, w in zip(key.to_pylist(), where.tolist()) if w == i and v is not None] for i in range(2)]
    inside = int(np.sum(np.array(pos)[np.array(where) == 0] <= 10 + 1500 - byte_repeats.WINDOW))
    assert keys[0][:inside] == keys[1][:inside] and inside > 10  # later windows reach behind the passage

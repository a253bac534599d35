import collections
import itertools
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import quality, scoring, search


def test_top_k_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, -0.2, 0.0, 0.1, 0.4]) for _ in range(6)]) for i in range(300)]
    rows += [(1000, None), (1001, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1004, [0.3] * 4), (1005, [0.2] * 4), (None, [0.1] * 6), (7, rows[7][1]), (50, [0.4] * 6), (50, [0.4] * 6), (2000, [1e5, -1e5, 0.0, 0.0, 0.0, 0.0]), (2010, [3e6, 0.0, 0.0, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, score int")
    got = search.top_inner_products(vectors, F.col("vec_id") % 10 == 0, shard=64, block=7)
    table = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, asked) in enumerate(table):
        scored = sorted((-sum(a * b for a, b in zip(asked, v, strict=True)), i) for m, (i, v) in enumerate(table) if m != n and len(v) == len(asked))
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:5])] if q % 10 == 0 else []
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert search.top_inner_products(vectors.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_base_score_matches_definition(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choice(["The", "the", "é", "of", f"w{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(3, "the of"), (100, None), (101, " "), (None, "the")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fold int")
    learn = F.col("doc_id") % 3 != 0
    got = scoring.score_documents(docs, learn).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), 0]
    counts = collections.Counter(w for i, t in rows if i is not None and i % 3 for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((i is None, i or 0, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens(t)), 8)) for i, t in rows)
    assert want == sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8)) for r in got)
    assert all(r.score < 0 < r.bits_per_byte < 40 for r in got)
    assert scoring.score_documents(docs.limit(0), learn).count() == 0
    unlearnt = scoring.score_documents(docs, F.lit(False)).collect()
    assert all(math.isclose(r.score, -8 * (len(b" ".join((dict(rows)[r.doc_id] or "").encode().split())) + 1) * math.log10(2), rel_tol=1e-6) for r in unlearnt if r.doc_id == 101)


def naive_tree(text):
    """Context-tree weighting of depth 2 over bytes by the definition: block probabilities of every
    node, and the probability of one more byte as a ratio of them."""

    def block(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) if a + b else 0.0

    def weighted(pairs):
        counts = collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0]))
        for old, last, byte in pairs:
            for bit in range(8):
                node = (1 << bit) | (byte >> (8 - bit))
                for context in ((), (last,), (last, old)):
                    counts[node][context][byte >> (7 - bit) & 1] += 1
        total = 0.0
        for contexts in counts.values():
            deep = {c: block(*n) for c, n in contexts.items() if len(c) == 2}
            one = {c: math.log(0.5) + np.logaddexp(block(*n), sum(v for d, v in deep.items() if d[0] == c[0])) for c, n in contexts.items() if len(c) == 1}
            total += math.log(0.5) + np.logaddexp(block(*contexts[()]), sum(one.values()))
        return total

    history = [scoring.END, scoring.END, *text]
    pairs = [tuple(history[i : i + 3]) for i in range(len(text))]
    base = weighted(pairs)
    return lambda old, last, byte: weighted([*pairs, (old, last, byte)]) - base


def test_context_tree_matches_definition():
    text = b"abab abba ab\n"
    out, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    code, n = np.unique(scoring.contexts(out, at), return_counts=True)
    tree, exact = scoring.ContextTree.of(code, n.astype(float)), naive_tree(text)
    for old, last, byte in [(97, 98, 97), (97, 98, 32), (98, 98, 97), (122, 97, 98), (122, 122, 97), (10, 10, 97)]:
        assert math.isclose(tree.table[tree.row[old << 8 | last], byte] * math.log(10), exact(old, last, byte), rel_tol=1e-4, abs_tol=1e-5)
    sums = (10.0 ** tree.table.astype(float)).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-4)


def test_stream_and_contexts():
    rows = [b" ab  c ", b"", b"d", b"\t"]
    data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    out, at, *_ = scoring.stream(data, offsets)
    assert [out[a:b].tobytes() for a, b in itertools.pairwise(at)] == [b"ab c\n", b"\n", b"d\n", b"\n"]
    code = scoring.contexts(out, at)
    assert [hex(c) for c in code[at[:-1]]] == ["0xa0a61", "0xa0a0a", "0xa0a64", "0xa0a0a"]
    assert hex(code[1]) == "0xa6162" and hex(code[at[2] + 1]) == "0xa640a"


def test_quality_learns_and_scores_every_row(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "house", "stands", "alone."]) for _ in range(rng.randint(20, 90)))
    bad = lambda: " ".join(rng.choice(["the%%%", "x|", "###", "q$$$"]) for _ in range(rng.randint(20, 90)))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(400)]
    odd = [(1000, None), (1001, ""), (1002, "x" * 200_000), (None, "text"), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows] + [(*r, 0) for r in odd], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(7, None), (9999, 1)], "doc_id long, quality int")
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    got = quality.score_quality(docs, labels, learn).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    truth = {i: q for i, _, q in rows}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([p == q for p, q in held]) > 0.97
    bounded = quality.score_quality(docs, labels, learn, sample=60).collect()
    assert np.mean([r.predicted == truth[r.doc_id] for r in bounded if r.doc_id in truth]) > 0.9
    assert {r.score for r in quality.score_quality(docs, labels.limit(0), learn).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels, learn).count() == 0

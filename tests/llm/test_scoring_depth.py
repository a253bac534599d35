import collections
import math

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import scoring

DEPTH = 6


def naive_tree(texts):
    """Context-tree weighting of depth 6 over bytes by the definition: the probability of one more byte
    as a ratio of block probabilities, over contexts as strings."""
    pairs = []
    for text in texts:
        history = b"\n" * DEPTH + text
        pairs += [(history[i : i + DEPTH], history[i + DEPTH]) for i in range(len(text))]

    def block(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(pairs):
        total = 0.0
        for k in range(8):
            by_node = collections.defaultdict(list)
            for context, byte in pairs:
                by_node[byte >> (8 - k)].append((context, byte >> (7 - k) & 1))

            def below(items, depth):
                own = block(sum(not b for _, b in items), sum(b for _, b in items))
                if depth == DEPTH:
                    return own
                split = collections.defaultdict(list)
                for context, b in items:
                    split[context[DEPTH - 1 - depth]].append((context, b))
                return math.log(0.5) + np.logaddexp(own, sum(below(part, depth + 1) for part in split.values()))

            total += sum(below(items, 0) for items in by_node.values())
        return total

    base = weighted(pairs)
    return lambda context, byte: weighted([*pairs, (context, byte)]) - base


def test_scores_mix_all_depths(spark, monkeypatch):
    learnt = ["abcabcab abcabcax", "the cat sat", "The hat  sat", None, "abcabcab abcabcab"]
    asked = ["abcabcab", "the cat", "zq", "é sat", ""]
    rows = [(i, t, True) for i, t in enumerate(learnt)] + [(10 + i, t, False) for i, t in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, l boolean").repartition(3)
    read = lambda t: b" ".join((t or "").encode().lower().split()) + b"\n"
    log = naive_tree([read(t) for t in learnt])
    want = {}
    for i, t, _ in rows:
        history = b"\n" * DEPTH + read(t)
        want[i] = sum(log(history[j : j + DEPTH], history[j + DEPTH]) for j in range(len(history) - DEPTH)) / math.log(10)
    got = {r.doc_id: r.score for r in scoring.score_documents(docs, F.col("l")).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-5) for i in want)

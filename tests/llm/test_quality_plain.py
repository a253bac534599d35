"""The quality query against plain Python: statistics, kept rules and weights, row by row."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import quality


def plain_statistics(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
    share = lambda part, of: part / of if of else 0.0
    n, count = len(text), lambda chars: sum(c in chars for c in text)
    return {
        "log_chars": math.log1p(n),
        "log_words": math.log1p(len(words)),
        "word_length": share(n, len(words)),
        "distinct_words": share(len(set(words)), len(words)),
        "symbols": share(count("#$%&*@^~<>{}[]\\=+_".replace("\\\\", "\\")), n),
        "bars": share(count("|"), n),
        "digits": share(count("0123456789"), n),
        "stops": share(count(".,;:!?"), n),
        "lines": share(count("\n"), len(words)),
        "capitals": share(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n),
        "bytes": share(len(text.encode()), n),
        "short_words": share(sum(len(w) <= 3 for w in words), len(words)),
    }


def corpus():
    rng = random.Random(11)
    rows = []
    for i in range(300):
        words = ["The", "house", "stands", "é", "42", "alone."] if i % 3 else ["x|", "#%&", "q_q", "Z~", "a"]
        rows.append((i, rng.choice([" ", "\n", "\t ", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 60))), int(i % 3 > 0)))
    return rows + [(1000, None, None), (1001, "", None), (1002, " \n ", None), (1003, "y" * 100_000, None), (5, rows[5][1], 1), (None, "The house", None)]


def test_statistics_match_plain_ones(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "i long, text string")
    stats = quality.statistics(F.col("text"))
    for r in docs.select("i", "text", *(c.alias(n) for n, c in stats.items())).collect():
        want = plain_statistics(r.text)
        assert all(math.isclose(r[name], value, rel_tol=1e-9, abs_tol=1e-12) for name, value in want.items()), (r.i, r.text[:50])


def test_scores_are_those_of_the_rules_row_by_row(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "c") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows[:300] if q is not None], "doc_id long, quality int")
    learn = F.col("doc_id") % 4 != 2
    known = sorted((i, tuple(plain_statistics(t).values()), q) for i, t, q in rows if i is not None and q is not None and i % 4 != 2)
    names = list(plain_statistics(""))
    model = quality.fit_rules(np.array([s for _, s, _ in known]), np.array([q for _, _, q in known], float), names)
    assert model.rules

    def score(text):
        values, margin = plain_statistics(text), model.bias
        for rule, weight in model.rules:
            if all((values[names[k]] > bound) == above for k, bound, above in rule):
                margin += weight
        return 1 / (1 + math.exp(-margin))

    got = quality.score_quality(docs, labels, learn).collect()
    want = sorted(((i is None, i or 0), round(score(t), 9), int(score(t) >= quality.THRESHOLD)) for i, t, _ in rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), round(r.score, 9), r.predicted) for r in got) == want


def test_ties_of_labels_and_rows(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = {r.score for r in quality.score_quality(docs, labels, F.lit(True)).collect()}
    assert len(got) == 1 and abs(got.pop() - 0.5) < 1e-6

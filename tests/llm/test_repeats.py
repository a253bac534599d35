import collections
import hashlib
import random

from pagemill.llm import byte_repeats, word_repeats


def word_brute(rows, width=13):
    first, out = {}, []
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - width + 1):
            g = tuple(w[s : s + width])
            if i is not None and i < first.get(g, 2**63):
                first[g] = i
    for i, w in words:
        gone = set()
        for s in range(len(w) - width + 1):
            if i is not None and first[tuple(w[s : s + width])] < i:
                gone.update(range(s, s + width))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(map(repr, out))


def byte_brute(rows, width=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[s : s + width] for _, b in texts for s in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        mask = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1:
                mask[s : s + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if mask[k] and not (k and mask[k - 1]))
        out.append((i, len(b), sum(mask), spans, hashlib.sha256(bytes(x for x, m in zip(b, mask, strict=True) if not m)).hexdigest()))
    return sorted(map(repr, out))


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdé" for b in "xyzwv"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 90))) for _ in range(12)]
    passages += [" ".join(["same"] * 40), " ".join(["ab", "cd"] * 30), "long" * 80]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))
            if rng.random() < 0.2:
                p = p[: rng.randint(0, len(p))]
            parts.append(p)
        rows.append((rng.randint(0, n), rng.choice([" ", "\n", "  "]).join(parts)))
    return rows + [(None, passages[0] * 3), (None, passages[0] * 3), (n + 1, None), (n + 2, ""), (n + 3, " \t "), (3, passages[13]), (3, passages[13]), (n + 4, "q" * 199), (n + 5, "q" * 450)]


def test_words_match_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = word_repeats.word_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("spans").collect()
        assert sorted(repr(tuple(r)) for r in got) == word_brute(rows)


def test_bytes_match_brute_force(spark):
    for seed in (3, 4):
        rows = corpus(seed)
        got = byte_repeats.byte_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("spans").collect()
        assert sorted(repr(tuple(r)) for r in got) == byte_brute(rows)


def test_extra_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "n"), (2, "a b", "n")], "doc_id long, text string, name string")
    assert word_repeats.word_repeats(docs).count() == byte_repeats.byte_repeats(docs).count() == 2
    assert word_repeats.word_repeats(docs.limit(0)).count() == byte_repeats.byte_repeats(docs.limit(0)).count() == 0


def test_recompression_cuts_equal_passages_alike():
    import numpy as np

    rng = np.random.default_rng(0)
    passage = np.cumsum(rng.integers(1, 50, 60)).astype(np.uint64)
    cuts = []
    for lead in (5, 9):
        sequence = np.concatenate([rng.integers(10**6, 10**9, lead).astype(np.uint64), passage, rng.integers(10**6, 10**9, 7).astype(np.uint64)])
        at = word_repeats.recompress(sequence, np.zeros(len(sequence), np.int64)) - lead
        cuts.append({int(a) for a in at if word_repeats.MARGIN <= a <= len(passage) - word_repeats.MARGIN})
    assert cuts[0] == cuts[1] and cuts[0]


def test_texts_nobody_asks_about_are_not_read_again(spark):
    """But those with a window that holds no sampled prefix are."""
    some = spark.createDataFrame([(1, False), (2, False), (3, True)], "name long, bare boolean")
    asked = spark.createDataFrame([(1, bytearray(b"1234"))], "name long, keys binary")
    assert {(r.name, r.asked is None) for r in byte_repeats.asked_texts(some, asked).collect()} == {(1, False), (3, True)}

import random
import re
from collections import Counter

import numpy as np

from pagemill.llm import collocations
from pagemill.llm.common import text_bytes


def plain(docs, best=2000, least=30):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            words = tuple(w for w in re.split("[ \t]", piece) if w)
            n[lang] += len(words)
            f.update((lang, words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    kept = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = set()
    for (lang, words), a in kept.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * a >= 80 * f[lang, words[i : i + k]]:
                    gone.add((lang, words[i : i + k]))
    by = {}
    for (lang, words), a in kept.items():
        if (lang, words) not in gone:
            cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            by.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, rows in by.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:best], 1))


def found(spark, docs, **options):
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "lang string, text string, n long, place int")
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.collocations(df, **options).collect())


def speech(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "OF", "été", "x" * 300]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = []
    for i in range(n):
        text = "".join(w + rng.choice([" ", " ", " ", " ", "\t", ". ", ", ", "\n"]) for w in rng.choices(words, weights, k=rng.randint(0, 60)))
        docs.append((rng.choice(["en", "en", "de", None, "und"]), text if i % 3 else text + "in the united states of america"))
    return docs


def test_equals_plain_counts(spark):
    docs = speech(1, 600)
    got = found(spark, docs)
    assert got == plain(docs) and len(got) > 30


def test_folds_and_small_reports(spark, monkeypatch):
    """Many folds, common pairs dealt by three words, and ties at the last rank."""
    monkeypatch.setattr(collocations, "FOLD", 500)
    docs = speech(2, 400) + [("en", "a b c d a b c d e")] * 200
    for best in (1, 7, 2000):
        assert found(spark, docs, best=best) == plain(docs, best=best)


def test_repeats_runs_and_long_texts(spark):
    docs = [("en", "no no no no no no")] * 20 + [("en", "word " * 60_000)] + [("fr", "a, b. c")] * 40 + [("de", "x y")] * 29 + [("es", "x y")] * 30
    got = found(spark, docs)
    assert got == plain(docs)
    assert ("es", 1, "x y", 30, 30, 30, 60, 1_000_000) in got and not [r for r in got if r[0] in ("de", "fr")]


def test_nulls_and_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None), ("en", ""), ("en", " .,\n"), (None, "one")]) == []
    docs = [(None, "p q")] * 16 + [("und", "P Q")] * 16
    assert found(spark, docs) == plain(docs) == [("und", 1, "p q", 32, 32, 32, 64, 1_000_000)]


def test_pieces_and_words_at_borders_of_texts():
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(["a b", "c. d\x1ce ", None, "\t", "f,,g"]))
    starts, ends, row, last = collocations.words_of(data, offsets)
    assert [data[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)] == ["a", "b", "c", "d\x1ce", "f", "g"]
    assert row.tolist() == [0, 0, 1, 1, 4, 4] and np.asarray(last).tolist() == [False, True, True, True, True, True]

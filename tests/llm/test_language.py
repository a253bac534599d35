import math
import random

import numpy as np

from pagemill.llm import language


def all_segmentations(word, prob):
    """Sum over every way to cut a word into pieces, shortest rests first."""
    total = {len(word): 1.0}
    for at in range(len(word) - 1, -1, -1):
        total[at] = sum(prob[word[at:end]] * total[end] for end in range(at + 1, len(word) + 1) if word[at:end] in prob)
    return total[0]


def odd_vocabulary(tmp_path):
    import base64

    pieces = [b" t", b"he", b"the", b" the", b"h", b"e", b"t", b" ", b"an", b"and", b" an", b"d", b"andandand", b"andandanda", b"thehathat", b"hehehehehehehehehehe", "ü".encode(), b"\xbcx"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % i for i, p in enumerate(pieces)))
    vocabulary = language.Pieces.of(str(path))
    prob = np.random.default_rng(0).random((vocabulary.n, 2)) / vocabulary.n
    named = [{bytes(raw): prob[vocabulary.first[n] + i, lang] for n, table in vocabulary.raw.items() for i, raw in enumerate(table.tolist())} for lang in range(2)]
    assert set(pieces) <= set(named[0])
    return vocabulary, prob, named


def test_forward_sums_all_segmentations(tmp_path):
    vocabulary, prob, named = odd_vocabulary(tmp_path)
    words = [b"the", b"and", b"t", b"theand", b"hhh", b"andandandandandtheand", b"he" * 60, "ü".encode() * 20 + b"x", b"thehathat" * 3]
    data, offsets = np.frombuffer(b" ".join(words), np.uint8), np.array([0, len(b" ".join(words))])
    got = language.Scorer(vocabulary, prob).rows(data, offsets)
    for lang in range(2):
        assert math.isclose(got[0, lang], sum(math.log(all_segmentations(b" " + w, named[lang])) for w in words), rel_tol=1e-9)
    starts, ends, _ = language.word_spans(data, offsets)
    lengths = np.repeat(list(vocabulary.keys), [len(k) for k in vocabulary.keys.values()])
    seen = 0
    for some, lattice, long in language.lattices(vocabulary, data, starts, ends):
        for logs in {long, True}:
            counts = lattice.expected(prob, np.ones((len(some), 2)), logs)
            assert np.allclose((counts * lengths[:, None]).sum(axis=0), sum(len(words[i]) + 1 for i in some))
        seen += len(some)
    assert seen == len(words)


def test_words_of_any_length_are_walked_whole(tmp_path):
    vocabulary, prob, named = odd_vocabulary(tmp_path)
    word = b"theand" * 20_000
    got = language.Scorer(vocabulary, prob).rows(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
    short = language.Scorer(vocabulary, prob).rows(np.frombuffer(word[:600], np.uint8), np.array([0, 600]))
    assert math.isclose(short[0, 0], math.log(all_segmentations(b" " + word[:600], named[0])) if all_segmentations(b" " + word[:600], named[0]) else short[0, 0], rel_tol=1e-9)
    assert 190 < got[0, 0] / short[0, 0] < 210


def test_query_matches_plain_version(spark):
    """The whole query on a small table: sample, learning and scores again in plain Python."""
    rng = random.Random(4)
    words = {"aa": ["the", "house", "and", "when"], "bb": ["über", "haus", "und", "wenn"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 12))), lang) for i, lang in enumerate(["aa", "bb"] * 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language(docs)
    pieces = {bytes(raw): model.pieces.first[n] + i for n, table in model.pieces.raw.items() for i, raw in enumerate(table.tolist())}
    prob = {p: [1e-3, 1e-3] for p in pieces}
    for _ in range(language.ROUNDS):
        counts = {p: [language.FLOOR] * 2 for p in pieces}
        for _, text, lang in rows:
            k = ["aa", "bb"].index(lang)
            for word in text.split():
                word = b" " + word.encode()
                ahead, back = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
                arcs = [(a, b, word[a:b]) for a in range(len(word)) for b in range(a + 1, len(word) + 1) if word[a:b] in pieces]
                for a, b, p in sorted(arcs, key=lambda arc: arc[1]):
                    ahead[b] += ahead[a] * prob[p][k]
                for a, b, p in sorted(arcs, key=lambda arc: -arc[0]):
                    back[a] += back[b] * prob[p][k]
                for a, b, p in arcs:
                    counts[p][k] += ahead[a] * prob[p][k] * back[b] / ahead[-1]
        sums = [sum(c[k] for c in counts.values()) for k in range(2)]
        prob = {p: [c[0] / sums[0], c[1] / sums[1]] for p, c in counts.items()}
    assert model.langs == ["aa", "bb"]
    for p, i in pieces.items():
        assert np.allclose(model.prob[i], prob[p], rtol=1e-4)
    for r in language.identify_languages(docs, model).collect():
        logs = [sum(math.log(all_segmentations(b" " + w.encode(), {p: c[k] for p, c in prob.items()})) for w in r.text.split()) for k in range(2)]
        best = logs.index(max(logs))
        assert r.language.lang == model.langs[best]
        assert math.isclose(r.language.score, 1 / sum(math.exp(x - max(logs)) for x in logs), rel_tol=1e-4)


def test_sample_is_bounded_and_ties_go_to_the_first_language(spark):
    rows = [(i, "the same words", "bb" if i % 2 else "aa") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = language.chosen_rows(docs, key="doc_id", text="text", lang="lang", per_lang=10)
    assert {(r["lang"], r["count"]) for r in chosen.groupBy("lang").count().collect()} == {("aa", 10), ("bb", 10)}
    model = language.fit_language(docs)
    assert {tuple(r.language) for r in language.identify_languages(docs, model).collect()} == {("aa", 0.5)}


def test_identifies_and_handles_odd_rows(spark):
    rng = random.Random(1)
    words = {"aa": ["the", "house", "and", "when"], "bb": ["über", "haus", "und", "wenn"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "123 !?", "bb"), (1003, "x" * 300_000, None), (None, "und das haus", "bb"), (1, rows[1][1], "bb")]
    docs = spark.createDataFrame([(*r, "s") for r in rows + odd], "doc_id long, text string, lang string, score string")
    model = language.fit_language(docs.filter("doc_id < 60"))
    got = language.identify_languages(docs, model).collect()
    assert len(got) == len(rows + odd)
    for r in got:
        if r.doc_id in (1000, 1001, 1002):
            assert tuple(r.language) == ("und", 0.0)
        elif r.lang:
            assert r.language.lang == r.lang and 0.5 < r.language.score <= 1
    nothing = language.fit_language(docs.limit(0))
    assert {r.language.lang for r in language.identify_languages(docs, nothing).collect()} == {"und"}
    assert language.identify_languages(docs.limit(0), model).count() == 0

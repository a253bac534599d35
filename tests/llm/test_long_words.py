"""Long and awkward texts: words that a sum of powers modulo 2**64 cannot tell apart, and whole stages
against plain versions."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import byte_repeats, decontaminate, language, near_dup, scoring, secrets, word_repeats
from pagemill.llm.common import word_hash


def thue_morse(n, first="a", second="b"):
    word = first
    while len(word) < n:
        word += "".join(second if c == first else first for c in word)
    return word


def test_hash_of_words_at_limb_borders():
    words = [b"x" * n for n in range(1, 20)] + [b"x" * n + b"y" for n in range(0, 20)] + [b"ab" * 200, b"ba" * 200, thue_morse(4096).encode(), thue_morse(4096, "b", "a").encode()]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = word_hash(data, ends - [len(w) for w in words], ends, 7)
    assert len(set(got.tolist())) == len(set(words))
    again = word_hash(np.frombuffer(b"--" + words[5] + b"--", np.uint8), np.array([2]), np.array([2 + len(words[5])]), 7)
    assert again[0] == got[5]


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_complementary_words_stay_apart(spark, n):
    one, other, tail = thue_morse(n), thue_morse(n, "b", "a"), " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"{one} {tail}")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in word_repeats.word_repeats(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
    scored = scoring.score_documents(spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string"), F.col("doc_id") == 1)
    assert {r.doc_id: (r.n_tokens, r.n_known) for r in scored.collect()} == {1: (2, 2), 2: (2, 1)}


def test_complementary_bytes_stay_apart(spark):
    rows = [(1, thue_morse(4096)), (2, thue_morse(4096, "b", "a")), (3, thue_morse(4096, "c", "d"))]
    texts = {i: t.encode() for i, t in rows}
    seen = collections.Counter(t[s : s + 200] for t in texts.values() for s in range(len(t) - 199))
    want = {}
    for i, t in texts.items():
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 199):
            if seen[t[s : s + 200]] > 1:
                gone[s : s + 200] = True
        want[i] = int(gone.sum())
    got = {r.doc_id: r.n_removed for r in byte_repeats.byte_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_very_long_texts(spark):
    long = " ".join(f"w{i * 7919 % 50021}" for i in range(200_000))
    passage = " ".join(f"w{i * 7919 % 50021}" for i in range(150_000, 150_040))
    docs = spark.createDataFrame([(1, long), (2, "short " + passage), (3, "z" * 300_000)], "doc_id long, text string")
    items = spark.createDataFrame([(9, passage)], "item_id long, text string")
    hits = {r.doc_id: (r.n_hit, r.contaminated) for r in decontaminate.contamination(docs, items).collect()}
    assert hits[2] == (40, True) and hits[1][0] >= 40 and not hits[1][1] and hits[3] == (0, False)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3}
    removed = {r.doc_id: r.n_removed for r in word_repeats.word_repeats(docs).collect()}
    assert removed[2] == 40 and removed[3] == 0
    assert all(math.isfinite(r.score) and r.score < 0 for r in scoring.score_documents(docs, F.lit(True)).collect())


def test_contaminated_rows_are_judged_by_themselves(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    rows = [(None, passage, 1), (7, passage, 2), (7, "clean other", 3), (None, "clean", 4), (8, None, 5), (7, passage, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc int")
    kept = decontaminate.remove_contaminated(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r._doc for r in kept.collect()) == [3, 4, 5]


def test_language_ties_and_odd_ids_are_not_held_out(spark, tmp_path):
    from pagemill.llm import contract

    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("the house", "en"), ("das haus", "de")] * 10)] + [(None, "the house", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (contract.op4_quality, contract.op8_scoring, contract.op10_language):
        assert [r.held_out for r in query(spark, str(tmp_path)).filter("doc_id is null").collect()] == [False]


def test_pipeline_stages_match_plain_versions(spark, tmp_path):
    import corpus_pipeline

    passage = " ".join(f"item{i}" for i in range(20))
    words = ["house", "garden", "river", "stone", "light", "paper", "winter", "table"]
    rows = []
    for i in range(40):
        text = " ".join(words[(i * 7 + j * (i % 5 + 1)) % 8] + str((i * j) % 11) for j in range(60))
        rows.append((i, text, "en" if i % 2 else "de", "s", len(text)))
    rows[3] = (3, rows[2][1], "en", "s", 1)  # an exact copy
    rows[5] = (5, passage + " and more", "en", "s", 1)
    rows[6] = (6, rows[6][1] + " password = hunter2hunter2", "en", "s", 1)
    rows += [(None, "ein haus ohne nummer", "de", "s", 1), (40, None, "en", "s", 0), (41, "1234 5678", "en", "s", 9), (42, "", "de", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumn("_found", F.lit(1)).withColumn("_place", F.lit(2)).withColumn("_DOC", F.lit(3))
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def run(name, docs):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        return corpus_pipeline.stored(out, name)

    known = run("language", docs)
    model = language.fit_language(docs.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False))))
    told = {r.doc_id for r in language.identify_languages(docs, model, out="told").collect() if r.told.lang != "und" and r.told.score >= corpus_pipeline.CERTAIN}
    assert {r.doc_id for r in known.collect()} == told and not told & {40, 41, 42}

    single = run("near_duplicates", known)
    prints = {}
    for r in known.collect():
        prints.setdefault(r.doc_id, near_dup.simhash((r.text or "").encode()) % 2**64)
    parent = {i: i for i in prints if i is not None}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in parent:
        for b in parent:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= near_dup.RADIUS:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in single.collect()) == sorted([(False, i) for i in parent if find(i) == i] + [(True, 0)] * (None in prints))

    clean = run("decontamination", single)
    grams = {tuple(passage.split()[s : s + 13]) for s in range(8)}

    def contaminated(text):
        w, hit = (text or "").lower().split(), set()
        for s in range(len(w) - 12):
            if tuple(w[s : s + 13]) in grams:
                hit.update(range(s, s + 13))
        return bool(hit) and 20 * len(hit) >= len(w)

    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not contaminated(r.text)} and 5 not in {r.doc_id for r in clean.collect()}

    masked = run("secrets", clean)
    before = {r.doc_id: r.text for r in clean.collect()}
    assert all(r.text == secrets.masked_text(before[r.doc_id], "[secret]") and r.n_chars == len(r.text) for r in masked.collect())

    packed = stages["packing"](spark, masked, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in packed) == sorted((r.doc_id is None, r.doc_id or 0) for r in masked.collect())
    room = collections.Counter()
    for r in packed:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 2048

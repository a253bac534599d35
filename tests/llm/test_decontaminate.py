import random
import re

from pagemill.llm import decontaminate


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(docs, items):
    grams = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 12) if w else 0):
            grams.setdefault(tuple(w[s : s + 13]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, held = words(text), set(), set()
        for gram, names in grams.items():
            for s in range(len(w) - len(gram) + 1):
                if tuple(w[s : s + len(gram)]) == gram:
                    hit.update(range(s, s + len(gram)))
                    held |= names
        out.append((doc, len(w), len(hit), len(held), sorted(held), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(map(repr, out))


def test_matches_brute_force(spark):
    rng = random.Random(7)
    vocabulary = ["the", "The", "of", "é", "É", "x1", "ΑΣ", "ας", "İi"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 12, 13, 14, 25]))) for i in range(14)] + [(50, None), (51, "..."), (3, "the of the"), (52, "THE of")]
    docs = [(i, text(rng.randint(0, 40)) + " " + rng.choice(items[:14])[1] + " " + text(rng.randint(0, 200))) for i in range(40)]
    docs += [(100, None), (101, ""), (5, docs[5][1]), (5, "other words"), (None, docs[6][1]), (102, "the " * 3000)]
    frame = spark.createDataFrame([(*d, 1, "h") for d in docs], "doc_id long, text string, row int, hit string")
    bench = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, words int")
    got = decontaminate.contamination(frame, bench).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated)) for r in got) == brute(docs, items)


def test_join_without_broadcast_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SMALL_ROWS", 0)
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "a " + passage + " b"), (2, "clean words"), (None, "more")], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    assert {(r.doc_id, r.n_hit) for r in decontaminate.contamination(docs, items).collect()} == {(1, 20), (2, 0), (None, 0)}
    assert {r.doc_id for r in decontaminate.remove_contaminated(docs, items).collect()} == {2, None}
    assert decontaminate.contamination(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), items).count() == 0

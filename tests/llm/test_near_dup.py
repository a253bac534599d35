import random

import numpy as np
import xxhash

from pagemill.llm import near_dup
from pagemill.llm.components import components


def plain_simhash(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union_find(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_fingerprint_matches_definition():
    rng = random.Random(0)
    for n in [0, 1, 2, 3, 4, 5, 6, 30, 300]:
        text = rng.choice([" ", "\t"]).join(rng.choice(["Ab", "é", "İx", "the", "the"]) for _ in range(n))
        assert near_dup.simhash(text.encode()) & (2**64 - 1) == plain_simhash(text)


def clustered(rng, n):
    codes = set()
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(0, 10)):
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            codes.add(x)
    return sorted(codes)


def test_bk_search_finds_every_neighbour():
    codes = np.array(clustered(random.Random(2), 60), np.uint64)
    every, shard = np.ones(len(codes), bool), np.zeros(len(codes), np.int64)
    forest = near_dup.bk_forest(codes, every, shard)
    found = {(int(a), int(b)) for x, y in near_dup.bk_search(codes, forest, np.arange(len(codes)), shard, 4) for a, b in zip(x, y, strict=True)}
    assert found == {(i, j) for i in range(len(codes)) for j in range(len(codes)) if i != j and int(codes[i] ^ codes[j]).bit_count() <= 4}


def test_links_have_all_components_whatever_the_chunk(spark):
    codes = clustered(random.Random(3), 80)
    ids = list(range(50, 50 + len(codes)))
    random.Random(5).shuffle(ids)
    links = [(ids[i], ids[j]) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 4]
    want = union_find(ids, links)
    nodes = spark.createDataFrame([(c - 2**64 if c >= 2**63 else c, i) for c, i in zip(codes, ids, strict=True)], "code long, id long")
    for chunk in (4096, 4):
        got = {r.node: r.component for r in components(near_dup.links_within(nodes, chunk=chunk)).collect()}
        assert {i: got.get(i, i) for i in ids} == want


def test_components_of_chain_hub_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w200 ", "zz ")
    rows = [(5, base, 1), (3, base, 2), (3, base, 2), (9, near, 3), (11, None, 4), (12, "  ", 5), (20, "alone here", 6), (None, base, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, code int")
    got = {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect()}
    close = (plain_simhash(base) ^ plain_simhash(near)).bit_count() <= 4
    assert got == {(5, 3), (3, 3), (9, 3 if close else 9), (11, 11), (12, 11), (20, 20), (None, 3)}
    kept = near_dup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted([0, 3, 11, 20] + ([] if close else [9]))
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pagemill.llm import packing


def best_fit(lengths, capacity):
    """Sequences of plain best-fit decreasing, by scanning all open ones."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for trial in range(300):
        capacity = rng.choice([10, 30, 100])
        lengths = [rng.randint(1, capacity if trial % 3 else max(1, capacity // 5)) for _ in range(rng.randint(0, 120))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        filled = {}
        for length, first, after, each, sequence, place in packing.best_fit_plan(histogram, capacity):
            for k in range(after - first):
                filled.setdefault(sequence + k // each, []).append((place + k % each * length, length))
        for parts in filled.values():
            at = 0
            for place, length in sorted(parts):
                assert place == at
                at += length
            assert at <= capacity
        assert sorted(n for parts in filled.values() for _, n in parts) == sorted(lengths)
        assert len(filled) == best_fit(lengths, capacity)


def test_cut():
    assert packing.cut(1) == [(0, 1)]
    assert packing.cut(2048) == [(0, 2048)]
    assert packing.cut(2049) == [(0, 1), (1, 2048)]
    assert packing.cut(4096) == [(0, 2048), (2048, 2048)]


def test_pieces_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["the ", "Ünï ", "12", "\n\n", "  ", "don't", "<|endoftext|>", "漢字 "]) for _ in range(rng.randint(0, 3000)))) for i in range(12)]
    rows += [(100, None), (101, ""), (3, rows[3][1]), (3, rows[3][1]), (None, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, piece int")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs).collect()
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for place, n in sorted(parts):
            assert place == at
            at += n
        assert at <= 2048
    assert len(sequences) == best_fit([w[3] for w in want], 2048)
    assert packing.pack(docs.limit(0)).count() == 0

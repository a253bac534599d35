"""Which shards a query of the exact search is dealt to."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import search


def clustered(n, dim=8, centres=16):
    rng = np.random.default_rng(4)
    middle = 3 * rng.normal(size=(centres, dim))
    return (middle[np.arange(n) % centres] + 0.1 * rng.normal(size=(n, dim))).astype(np.float32)


def plain(points, every, k=5):
    v = np.floor(256 * points.astype(np.float64)).astype(np.int64)
    out = []
    for q in range(0, len(v), every):
        scored = sorted((-int(v[q] @ v[j]), j) for j in range(len(v)) if j != q)[:k]
        out += [(q, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("most", [4096, 2])
def test_regions_and_their_parts_give_what_all_pairs_give(spark, monkeypatch, most):
    monkeypatch.setattr(search, "REGIONS", most)
    points = clustered(600)
    points[100:160] = points[7]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    got = search.top_inner_products(df, F.col("vec_id") % 9 == 0, shard=40, block=11)
    assert sorted(map(tuple, got.collect())) == plain(points, 9)


def test_queries_reach_few_regions_of_clustered_vectors():
    v = np.floor(256 * clustered(4000).astype(np.float64))
    regions = search.Regions(v, 6)
    at = regions.of(v)
    regions.low, regions.high = (np.array([pick(v[at == r], axis=0) if (at == r).any() else np.full(8, sign * np.inf) for r in range(64)]) for pick, sign in ((np.min, 1), (np.max, -1)))
    queries = v[::50]
    scores = np.sort(queries @ v.T, axis=1)
    row, region = regions.reached(queries, scores[:, -6])
    assert len(row) < len(queries) * 64 / 5
    best = np.argsort(-(queries @ v.T), axis=1)[:, :5]
    reached = set(zip(row.tolist(), region.tolist(), strict=True))
    assert all((q, int(at[j])) in reached for q in range(len(queries)) for j in best[q])


def test_vectors_of_several_dimensions_and_large_ones(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(60)] + [(100 + i, [1e6 * (i % 3), 2.0, -1e6]) for i in range(40)] + [(300, [1.0])]
    got = search.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, shard=8, block=5).collect()
    known = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = []
    for q in (i for i in known if i % 10 == 0):
        scored = sorted((-sum(a * b for a, b in zip(known[q], w, strict=True)), j) for j, w in known.items() if j != q and len(w) == len(known[q]))[:5]
        want += [(q, r, j, -s) for r, (s, j) in enumerate(scored, 1) if abs(s) < 2**63]
    assert sorted(map(tuple, got)) == sorted(want)

"""Operators on embeddings against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeforge.llm import additive, embedding_dedup
from shapeforge.llm.common import connected_components


def vectors(spark, x, more=()):
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)] + list(more)
    # columns whose names the operators might use themselves
    clash = [F.lit(None).cast("long").alias(c) for c in ("v", "code", "rep", "score", "x", "n", "tile")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", *clash)


ODD = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [1.0, None] + [0.0] * 14, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [float("inf")] + [1.0] * 15, 1), (9005, [], 1), (None, [1.0] * 16, 1)]


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 10, 16))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(scale=0.12, size=(n, 16))
    x[n // 2 : n // 2 + 20] = x[0]
    return x.astype(np.float32)


def test_search_recall_and_scores(spark):
    x = clustered(1500)
    got = additive.search(vectors(spark, x, ODD), F.col("vec_id") % 50 == 0, k=10, shard=500).collect()
    d = x.astype(np.float64)
    hits = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 1500, 50))
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 11))
        far = np.sqrt(((d - d[q]) ** 2).sum(1))
        assert all(abs(far[r.vec_id] - r.score) < 1e-12 for r in rows)
        assert [(r.score, r.vec_id) for r in rows] == sorted((r.score, r.vec_id) for r in rows)
        best = [i for i in np.lexsort((np.arange(len(d)), far)) if i != q][:10]
        hits += len(set(best) & {r.vec_id for r in rows})
        total += 10
    assert hits / total >= 0.9
    # equal distances go to smaller ids: the copies of vector 0
    assert [r.vec_id for r in by[0]][:10] == list(range(750, 760))


def test_search_where_the_shortlist_is_a_small_share(spark):
    """12,000 vectors, 400 of which are reranked for a query: 3 %, whatever the tiles."""
    x = np.random.default_rng(3).normal(size=(12_000, 24)).astype(np.float32)
    assert additive.shortlist_size(len(x), 10) == 400
    got = additive.search(vectors(spark, x), F.col("vec_id") % 400 == 0, k=10).collect()
    d, hits = x.astype(np.float64), 0
    for q in range(0, 12_000, 400):
        far = ((d - d[q]) ** 2).sum(1)
        far[q] = np.inf
        hits += len(set(np.argsort(far)[:10].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits / 300 >= 0.9


def test_shortlists_do_not_grow_with_the_shards(spark):
    """Twenty shards' worth of codes give a query no more than SHARDS shortlists, which hold the nearest of all by estimate."""
    x = clustered(2000, seed=4)
    rows = additive.usable_vectors(vectors(spark, x), "vec_id", "embedding")
    books = additive.sample_fit(rows, 500)
    index, asked = additive.encode(rows, books).cache(), rows.where("vec_id % 100 = 0").select("vec_id", "v")
    near = additive.shortlists(index, asked, books, 30, 2000, 20, shard=100).collect()
    assert len(near) == 20 * 30 * additive.SHARDS
    codes = {r.vec_id: (np.frombuffer(r.code, np.uint8), r.norm) for r in index.collect()}
    for q in (0, 700):
        estimate = {i: n - 2 * float(books.words[np.arange(len(c)), c].sum(0) @ books.scaled(x[q])) for i, (c, n) in codes.items() if i != q}
        best = sorted(estimate.values())[:30]
        mine = sorted(r.estimate for r in near if r.query_id == q)[:30]
        assert np.allclose(best, mine, atol=1e-3) and all(abs(estimate[r.vec_id] - r.estimate) < 1e-3 for r in near if r.query_id == q)


def test_search_repeated_ids_and_large_numbers(spark):
    more = [(1, [9.0] * 16, 1), (1, [9.0] * 16, 1), (2, [1e30] * 16, 1)]
    got = additive.search(vectors(spark, clustered(60), more), F.col("vec_id") == 1, k=70).collect()
    assert len({r.vec_id for r in got}) == len(got) == 59 and [r for r in got if r.vec_id == 2][0].score < 100


def test_search_small_and_empty(spark):
    few = vectors(spark, clustered(30)[:4], ODD)
    got = additive.search(few, F.col("vec_id") == 0, k=10).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3]
    assert additive.search(few.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("block, cell", [(1024, 4096), (16, 64)])
def test_near_duplicates(spark, monkeypatch, block, cell):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    x = clustered(1200, 2)
    scaled = [(5000, [float(3 * c) for c in x[7]], 1)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors(spark, x, ODD + scaled)).collect()}
    d = np.concatenate((x, 3 * x[7:8])).astype(np.float64)
    ids = [*range(len(x)), 5000]
    u = d / np.linalg.norm(d, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in ids)
    assert found >= 0.95 * near.sum() and all(got[i].n_links <= n for i, n in zip(ids, near.sum(1)))
    comp = np.arange(len(ids))
    while True:
        new = np.minimum(comp, np.where(near, comp[None, :], len(ids)).min(1))
        if (new == comp).all():
            break
        comp = new
    assert np.mean([got[i].component_id == ids[comp[k]] for k, i in enumerate(ids)]) >= 0.98
    assert all(got[i].n_links >= 19 for i in range(600, 620))
    assert got[5000].component_id == got[7].component_id
    for i in (9000, 9001, 9002, 9003, 9004, 9005):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embedding_dedup.near_duplicates(vectors(spark, x, ODD).limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 120), (110, 120), (7, 7), (100, 120)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 110: 100, 120: 100}

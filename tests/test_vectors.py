"""Approximate vector search against the exact one."""

import os

import numpy as np
import pytest

from lectern.operators import retrieval, vectors


def table(spark, x, extra=()):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)] + list(extra), "vec_id long, embedding array<float>").repartition(3)


def pairs(df):
    return {(r.query_id, r.vec_id): r.similarity for r in df.collect()}


def test_codes_come_close_to_the_vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 7))  # an odd number of dimensions: the last group is padded
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = vectors._means(x, 8, 10, rng, unit=True)
    rest = np.zeros((900, 8))
    rest[:, :7] = x - c[np.argmax(x @ c.T, 1)]
    codes = vectors.VectorCodes(c, np.stack([vectors._means(rest.reshape(900, 4, 2)[:, g], 64, 10, rng) for g in range(4)]))
    near = codes.decode(*codes.encode(x))
    assert near.shape == x.shape and np.sqrt(((near - x) ** 2).sum(1)).mean() < 0.15


def test_few_lists_of_clusters_find_the_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    x = centres[rng.integers(0, 20, 1_200)] + 0.3 * rng.normal(size=(1_200, 24))
    e = table(spark, x, [(5_000, None), (5_001, [0.0] * 24)])
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    codes = vectors.fit_codes(e, lists=20)
    index = vectors.build_index(e, codes)
    assert index.count() == 1_200
    met = vectors.candidates(q, index, codes, 30, probes=2)
    assert met.count() <= 60 * 30
    exact, near = pairs(retrieval.vector_search(q, e, 5)), pairs(vectors.rerank(met, q, e, 5))
    assert len(exact.keys() & near.keys()) >= 0.97 * len(exact) and all(abs(near[k] - exact[k]) < 1e-8 for k in exact.keys() & near.keys())
    blocks = vectors.candidates(q, index, codes, 30, probes=2, most_values=500)  # several blocks of queries
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, met.collect()))


def test_small_tables(spark):
    e = table(spark, [[1.0, 0.0], [0.6, 0.8]])
    q = e.withColumnRenamed("vec_id", "query_id")
    assert pairs(vectors.approximate_vector_search(q, e, 2)) == pairs(retrieval.vector_search(q, e, 2))
    assert vectors.approximate_vector_search(q, e.limit(0)).count() == 0
    assert vectors.approximate_vector_search(q.limit(0), e).count() == 0


def test_recall_and_share_of_pairs_as_registered(spark):
    from lectern.plans import carriers
    from lectern.plans.registry import QUERIES

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    exact, near = (pairs(QUERIES[name](spark, sf)) for name in ("vector_search", "vector_search_approx"))
    assert len(exact.keys() & near.keys()) >= 0.95 * len(exact) and len(near) == len(exact)
    assert all(abs(near[k] - exact[k]) < 1e-8 for k in exact.keys() & near.keys())
    e = carriers.table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    codes = vectors.fit_codes(e)
    compared = vectors.candidates(q, vectors.build_index(e, codes), codes, 60).count()
    assert compared <= 0.15 * q.count() * e.count()

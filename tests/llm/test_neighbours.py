"""Nearest vectors against all pairs, bounds of the int8 tiles, copies and blocks."""

import numpy as np
import pyarrow as pa
import pytest

from snapweave.llm import neighbours as N


def brute(vectors, k, every):
    """Per asking row the k best (cosine, id) of all other rows."""
    x = [(i, np.array(v, np.float64)) for i, v in vectors]
    out = []
    for at, (i, v) in enumerate(x):
        if i is None or i % every:
            continue
        pairs = []
        for other, (j, w) in enumerate(x):
            if other != at and len(v) == len(w):
                dot, a, b = (float(np.cumsum(p)[-1]) for p in (v * w, v * v, w * w))
                pairs.append((-np.clip(dot / (np.sqrt(a) * np.sqrt(b)), -1, 1), j is None, j))
        pairs.sort(key=lambda p: (p[0], p[1], p[2] or 0))
        out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(pairs[:k])]
    return sorted(out, key=repr)


def got(spark, vectors, k=5, every=50, block=N.BLOCK):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = N.neighbours(df, k=k, every=every, block=block)
    return sorted(((r.query_id, r.rank, r.id, r.score) for r in found.collect()), key=repr)


def sample(n, dim, seed):
    rng = np.random.default_rng(seed)
    return [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, dim)))]


@pytest.mark.parametrize("block", [N.BLOCK, 37])
def test_all_pairs(spark, block):
    vectors = sample(700, 24, 1)
    assert got(spark, vectors, every=10, block=block) == brute(vectors, 5, 10)


def test_copies_ties_and_a_dense_cluster(spark):
    base = sample(60, 8, 2)
    rng = np.random.default_rng(3)
    near = [(i, (np.array(base[0][1]) + rng.normal(scale=1e-9, size=8)).tolist()) for i in range(100, 400)]
    copies = [(i, base[1][1]) for i in range(1000, 1300)] + [(50, base[1][1]), (50, base[1][1]), (None, base[1][1])]
    vectors = base + near + copies
    assert got(spark, vectors, every=25) == brute(vectors, 5, 25)


def test_fewer_candidates_than_asked_for(spark):
    vectors = sample(4, 5, 4) + [(50, [1.0, 2.0])]
    assert got(spark, vectors, every=2) == brute(vectors, 5, 2)


def test_bounds_hold_for_any_length_and_scale():
    rng = np.random.default_rng(5)
    for dim in (1, 3, 64, 1500):
        v = rng.normal(size=(200, dim)) * 10.0 ** rng.integers(-200, 200, size=(200, 1))
        b = N.Block(pa.chunked_array([pa.array(v.tolist(), pa.list_(pa.float64()))]))
        near = N.int8_products(b.int8, b.int8) * b.scale[:, None] * b.scale
        wide = b.rest[:, None] * (b.size + b.rest) + b.size[:, None] * b.rest + N.SLACK
        i, j = np.indices(near.shape)
        exact = N.cosines(b, b, i.ravel(), j.ravel()).reshape(near.shape)
        assert (np.abs(exact - near) <= wide).all()
        assert (N.int8_products(b.int8, b.int8) == b.int8.astype(np.int64) @ b.int8.astype(np.int64).T).all()


def test_tiles_leave_few_pairs_to_compute(monkeypatch):
    vectors = sample(5000, 64, 6)
    block = N.Block(pa.chunked_array([pa.array([v for _, v in vectors], pa.list_(pa.float64()))]))
    computed = []
    plain = N.cosines
    monkeypatch.setattr(N, "cosines", lambda a, b, i, j: computed.append(len(i)) or plain(a, b, i, j))
    heaps = N.nearest(block, block, 6)
    assert all(len(h) == 6 for h in heaps)
    assert sum(computed) < 0.02 * 5000 ** 2

"""Fingerprints by definition; links and components against all pairs."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from snapweave.llm import simhash as S
from snapweave.session import cut_lineage


def brute_fingerprint(text, shingle=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(points, max_bits=3):
    forest = S.Forest(len(points))
    for i in range(len(points)):
        near = np.flatnonzero(np.bitwise_count(points[i] ^ points) <= max_bits)
        forest.link(np.full(len(near), i), near)
    return np.array([forest.root(i) for i in range(len(points))])


def some_points(n, seed=1):
    """Random points, chains of near ones, and a dense ball."""
    rng = np.random.default_rng(seed)
    parts = [rng.integers(0, 2**63, n, dtype=np.uint64) * 2 + 1]
    chain = rng.integers(0, 2**63, n // 20, dtype=np.uint64)
    for _ in range(6):
        for _ in range(2):
            chain = chain ^ (np.uint64(1) << rng.integers(0, 64, len(chain)).astype(np.uint64))
        parts.append(chain)
    ball = np.repeat(rng.integers(0, 2**63, 1, dtype=np.uint64), n // 10)
    for _ in range(3):
        ball = ball ^ (np.uint64(1) << rng.integers(0, 64, len(ball)).astype(np.uint64))
    return np.unique(np.concatenate([*parts, ball]))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a b", "a b c", "A B  c\nd", "é È e", "x " * 9000, " nbsp x y z"])
def test_fingerprint(text):
    assert S.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_links_of_a_shard(monkeypatch):
    monkeypatch.setattr(S, "LEAF", 64)
    points = some_points(3000)
    forest = S.link_all(points, 3)
    assert ([forest.root(i) for i in range(len(points))] == brute_roots(points)).all()


def test_every_near_pair_meets_in_a_shard():
    points = some_points(3000, 2)
    tree = S.Tree(points[::5], 40, 3)
    assert tree.shards > 20
    homes = [set() for _ in points]
    for s, at in tree.deal(points):
        for i in at:
            homes[i].add(s)
    assert all(homes)
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i] ^ points) <= 3):
            assert homes[i] & homes[j]


def test_components(spark):
    points = some_points(4000, 3)
    table = cut_lineage(spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint"))
    roots = {r.node: r.root for r in S.components(S.links(table, 3, shard=400)).collect()}
    groups = {}
    for p, w in zip(points.view(np.int64).tolist(), brute_roots(points).tolist()):
        groups.setdefault(w, set()).add(roots.get(p, p))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


def test_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a bigint, b bigint")
    roots = {r.node: r.root for r in S.components(edges).collect()}
    assert roots == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = S.query(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in rows} == set(texts)
    points = np.unique(np.array([int(r.fingerprint, 16) for r in rows], np.uint64))
    roots = dict(zip(points.tolist(), brute_roots(points).tolist()))
    least = {}
    for r in rows:
        assert r.fingerprint == f"{brute_fingerprint(texts[r.doc_id]):016x}"
        root = roots[int(r.fingerprint, 16)]
        least[root] = min(least.get(root, r.doc_id), r.doc_id)
    assert all(r.component_id == least[roots[int(r.fingerprint, 16)]] for r in rows)


def test_keep_one_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d", 1), (1, "x y z w v", 2), (1, "A b c d", 3), (2, "a b c d", 4), (None, "a b c d", 5),
                                  (3, "something else entirely", 6)], "doc_id long, text string, fp int")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text.lower() for r in kept.collect()) == ["a b c d", "something else entirely", "x y z w v"]


def skewed_points(n, seed=4):
    """A third of the distinct fingerprints in one ball, four flipped bits from its centre on average."""
    rng = np.random.default_rng(seed)
    ball = np.repeat(rng.integers(0, 2**63, 1, dtype=np.uint64), n)
    flips = rng.poisson(4, n)
    for i in range(flips.max()):
        more = flips > i
        ball[more] ^= np.uint64(1) << rng.integers(0, 64, more.sum()).astype(np.uint64)
    ball = rng.permutation(np.unique(ball))[:n // 3]
    return np.unique(np.concatenate([rng.integers(0, 2**63, 2 * len(ball), dtype=np.uint64) * 2, ball]))


def test_tree_of_a_dense_ball_is_small():
    points = skewed_points(6000)
    tree = S.Tree(points[::2], 30, 3)
    uniform = S.Tree(np.sort(np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64) * 2), 30, 3)
    assert 20 < len(tree.vantage) < 2 * len(uniform.vantage)
    assert sum(tree.weights) < 2 * sum(uniform.weights)
    tree.size_parts(len(points), 300)
    assert tree.parts.max() > 2
    homes = [set() for _ in points]
    for s, at in tree.deal(points):
        assert len(at) < 900
        for i in at:
            homes[i].add(s)
    assert all(homes)
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i] ^ points) <= 3):
            assert homes[i] & homes[j]


def test_bounds_of_the_tree(monkeypatch):
    points = skewed_points(6000)
    monkeypatch.setattr(S, "MAX_NODES", 10)
    tree = S.Tree(points, 60, 3)
    assert len(tree.vantage) == 10 and tree.shards == 11


def test_links_of_a_dense_ball(spark, monkeypatch):
    points = skewed_points(6000)
    monkeypatch.setattr(S, "LEAF", 256)
    forest = S.link_all(points, 3)
    want = brute_roots(points)
    assert ([forest.root(i) for i in range(len(points))] == want).all()
    table = cut_lineage(spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint"))
    roots = {r.node: r.root for r in S.components(S.links(table, 3, shard=600)).collect()}
    groups = {}
    for p, w in zip(points.view(np.int64).tolist(), want.tolist()):
        groups.setdefault(w, set()).add(roots.get(p, p))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


def test_hot_centres_are_split(spark, monkeypatch):
    """A third of all points in one component: every join that meets its centre splits it."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.files.maxPartitionBytes": "32KB", "spark.sql.files.openCostInBytes": "1KB"}
    old = {k: spark.conf.get(k, None) for k in conf}
    plans = []
    plain = S.cut_lineage

    def noted(df):
        out = plain(df)
        plans.append(df)
        return out

    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        star = spark.range(1, 60_001).select(F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id") - F.col("id") % 7).alias("a"),
                                             F.col("id").alias("b")).filter("a <> b").repartition(8)
        both = plain(star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = plain(both.groupBy("a").agg(F.min("b").alias("m")))
        joined = both.join(least, "a")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(S, "cut_lineage", noted)
        roots = {r.node: r.root for r in S.components(star).collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert all(roots[i] == 0 for i in range(1, 60_001) if i % 3)
    # The side with a row a node reaches its join through a scan, not an aggregate that is partitioned already.
    for df in plans:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not ("Join" in plan and "Aggregate" in plan.split("Join", 1)[1]), plan

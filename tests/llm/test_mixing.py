"""Schedules of skewed sources against the DuckDB twin; entropy, epochs, budget and blocks."""

import math
from collections import defaultdict

import duckdb
import pytest
from helpers import same_rows
from pyspark.sql import functions as F

from snapweave.llm import mixing as M


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('mix')}/documents.parquet"
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 50 == 1, F.lit(None))
                    .otherwise(F.col("source"))).write.parquet(path)
    return path


def test_twin_on_skewed_sources(spark, skewed):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{skewed}/*.parquet')")
    same_rows(M.schedule(spark.read.parquet(skewed)).withColumnRenamed("id", "doc_id"), con, M.sql())


def test_small_blocks_give_the_same_places(spark, skewed, monkeypatch):
    docs = spark.read.parquet(skewed)
    want = sorted(map(tuple, M.schedule(docs).collect()))
    monkeypatch.setattr(M, "BLOCK", 4)
    assert sorted(map(tuple, M.schedule(docs).collect())) == want


def test_weights(spark, skewed):
    docs = spark.read.parquet(skewed)
    rows = M.schedule(docs, target_entropy=0.97, max_epochs=100.0, block_tokens=20_000).collect()
    tokens, shown, blocks = defaultdict(int), defaultdict(set), defaultdict(lambda: defaultdict(int))
    for r in rows:
        tokens[r["source"]] += r["n_tokens"]
        shown[r["id"]].add(r["epoch"])
        blocks[r["mix_block"]][r["source"]] += r["n_tokens"]
    total = sum(tokens.values())
    h = -sum(t / total * math.log(t / total) for t in tokens.values())
    assert h >= 0.96 * math.log(len(tokens))
    assert len(shown) == docs.count()  # every document at least once
    assert all(e == set(range(len(e))) for e in shown.values())
    sizes = [sum(b.values()) for b in blocks.values()]
    assert max(sizes) < 2.5 * 20_000 and len(blocks) == -(-sum({r["source"]: r["quota"] for r in rows}.values()) // 20_000)


def test_repetition_limit(spark, skewed):
    rows = M.schedule(spark.read.parquet(skewed), target_entropy=1.0, max_epochs=1.5).collect()
    assert max(r["epoch"] for r in rows) == 1


def test_budget(spark, skewed):
    docs = spark.read.parquet(skewed)
    rows = M.schedule(docs, budget=30_000, max_epochs=1.0).collect()
    total = sum(r["n_tokens"] for r in rows)
    most = max(r["n_tokens"] for r in rows)
    assert 30_000 - 25 <= total <= 30_000 + 25 * most


def test_mixed_follows_the_schedule(spark, skewed):
    docs = spark.read.parquet(skewed)
    for options in ({}, {"budget": 30_000}, {"target_entropy": 0.99, "max_epochs": 3.0}):
        want = defaultdict(int)
        for r in M.schedule(docs, **options).collect():
            want[r["id"]] += 1
        got = M.mixed(docs, **options)
        assert got.columns == docs.columns
        assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == want


def test_bisection():
    for target in (0, 1, 31, 32, 33, 1000, 5000):
        assert M.bisected(0, 5000, lambda t: {x for x in t if x <= target}, largest=True) == target
        assert M.bisected(0, 5000, lambda t: {x for x in t if x >= target}, largest=False) == target
    assert M.bisected(0, 5000, lambda t: set(), largest=True) == 0
    assert M.bisected(0, 5000, lambda t: set(), largest=False) == 5000

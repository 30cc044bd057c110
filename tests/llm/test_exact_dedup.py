"""Collisions of a weak digest, heavy groups, and the rows that stay."""

from collections import defaultdict

from pyspark.sql import functions as F

from snapweave.llm import exact_dedup as E


def groups(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r["keep_id"]].add(r["id"])
    return dict(out)


def test_equal_digests_do_not_merge_different_texts(spark):
    docs = spark.createDataFrame([(i, f"text {i % 10}") for i in range(60)], "doc_id long, text string")
    weak = E.exact_groups(docs, digest=lambda t: F.unhex(F.lit("00")))
    assert groups(weak) == {i: set(range(i, 60, 10)) for i in range(10)}
    assert weak.agg(F.sum(F.col("kept").cast("int"))).first()[0] == 10


def test_heavy_groups_are_salted_and_combined(spark, monkeypatch):
    monkeypatch.setattr(E, "HEAVY_ROWS", 50)
    text = F.when(F.col("id") % 6 == 0, "hot \t text").when(F.col("id") % 3 == 0, "hot text").otherwise(F.col("id").cast("string"))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), text.alias("text")).repartition(16)
    rows = {r["id"]: r for r in E.exact_groups(docs, salts=4).collect()}
    assert len(rows) == 2000
    hot = range(0, 2000, 3)
    assert all(rows[i]["keep_id"] == 0 and rows[i]["group_size"] == len(hot) for i in hot)
    assert sum(r["kept"] for r in rows.values()) == 2000 - len(hot) + 1


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "a", 4), (3, "c", 5), (3, "c", 5)],
                                 "doc_id long, text string, id int")
    kept = E.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a"), (1, "b"), (3, "c")]

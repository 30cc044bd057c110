"""The pipeline against a plain version of its stages, without the library's operators."""

import hashlib
import re
from collections import defaultdict

import numpy as np
from test_packing import check_places, library_ids
from test_simhash import brute_fingerprint, brute_roots

import corpus_pipeline
from snapweave.llm import mixing, packing, quality_rules

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    verdict = {r.doc_id: r.kept for r in quality_rules.query(spark, SF).collect()}  # has a twin of its own
    left = [i for i in sorted(docs) if verdict[i]]
    first = {}
    for i in left:
        first.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i].text).encode()).digest(), i)
    left = sorted(first.values())
    prints = {i: brute_fingerprint(docs[i].text) for i in left}
    points = np.unique(np.array(list(prints.values()), np.uint64))
    roots = dict(zip(points.tolist(), brute_roots(points).tolist()))
    least = {}
    for i in left:
        least.setdefault(roots[prints[i]], i)
    left = sorted(least.values())
    mixed = mixing.mixed(spark.createDataFrame([docs[i] for i in left], spark.read.parquet(f"{SF}/documents.parquet").schema))
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}  # has a twin of its own
    assert sorted(times) == left
    want = defaultdict(int)
    for i in left:
        n = len(library_ids(docs[i].text)) // 4
        for k in range(0, n, packing.CAPACITY):
            want[i, k // packing.CAPACITY, min(packing.CAPACITY, n - k)] += times[i]
    rows = corpus_pipeline.run(spark, SF).collect()
    got = defaultdict(int)
    for r in rows:
        got[r["doc_id"], r["piece"], r["length"]] += 1
    assert got == want
    used = check_places(rows, packing.CAPACITY)
    assert used <= -(-sum(r["length"] for r in rows) // packing.CAPACITY) * 1.02 + 1

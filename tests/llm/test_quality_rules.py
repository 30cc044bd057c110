"""The exact bound, the choice of cutoffs, and the guarantee on texts that were not labelled."""

import math
import random

from pyspark.sql import functions as F

from snapweave.llm import quality_rules as Q


def exact(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail(spark):
    cases = [(0, 100), (1, 500), (4, 900), (9, 1000), (10, 1000), (3, 4000), (0, 0), (30, 5000)]
    df = spark.createDataFrame(cases, "k long, n long")
    got = df.select("k", "n", Q.too_few(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in got:
        want = 1.0 if r.n == 0 or r.k >= r.n * 0.01 else exact(r.k, r.n, 0.01)
        assert math.isclose(r.p, want, rel_tol=1e-9), r


def test_binomial_tail_at_any_size(spark):
    cases = [(10_001, 1_100_000), (10_900, 1_100_000), (99_000, 10_000_000), (999_000, 100_000_000), (1, 100_000_000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", Q.too_few(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        logs = [math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01)
                + (r.n - i) * math.log1p(-0.01) for i in range(r.k, max(-1, r.k - 60_000), -1)]
        want = math.exp(logs[0]) * math.fsum(math.exp(x - logs[0]) for x in logs)
        assert math.isclose(r.p, want, rel_tol=1e-5, abs_tol=1e-300), (r, want)


def texts(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(60)]
        bad = i % 10 == 0
        if bad:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w), "en" if i % 4 else "fr", int(not bad)))
    return rows


def test_cutoffs_hold_on_other_texts(spark):
    rows = texts(4000, 1)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 2], "doc_id long, quality int")
    marked = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 2 == 0], "doc_id long, quality int")
    # Odd ids hold no bad texts; without bad ones no cutoff gains anything.
    assert Q.apply_rules(docs, labels).filter("NOT kept").count() == 0
    # Even ids: the better represented language gets its cutoff, the other has too few labels.
    kept = {r.doc_id: r.kept for r in Q.apply_rules(docs, marked).collect()}
    bad = [r for r in rows if not r[3]]
    assert all(not kept[r[0]] for r in bad if r[2] == "en")
    good = [r for r in rows if r[3]]
    assert sum(not kept[r[0]] for r in good) <= Q.MAX_FALSE * len(good)


def test_few_labels_certify_nothing(spark):
    rows = texts(200, 2)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    assert Q.apply_rules(docs, labels).filter("NOT kept").count() == 0


def test_pipeline_stage_keeps_what_the_query_keeps(spark):
    rows = texts(4000, 1)
    docs = spark.createDataFrame([r[:3] for r in rows] + [(None, "x " * 60, "en"), (4, None, None)],
                                 "doc_id long, text string, lang string").withColumn("label_bucket", F.lit(1))
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 2 == 0] + [(None, 1), (10**6, 1), (4, None)],
                                   "doc_id int, quality int")
    want = sorted(r.doc_id or -1 for r in Q.apply_rules(docs, labels).filter("kept").collect())
    got = Q.keep_good(docs, labels)
    assert got.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in got.collect()) == want and len(want) < len(rows)


def test_labels_move_no_text(spark):
    docs = spark.createDataFrame([(i, "a b c", "en") for i in range(50)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 50, 5)], "doc_id int, quality int")
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        some = Q.maybe_labelled(docs, labels)
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan, plan
        assert {r.doc_id for r in some.collect()} == set(range(0, 50, 5))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

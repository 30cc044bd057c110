"""Scores against a plain model, packed arrays, and held-out likelihood."""

import math
import zlib
from collections import Counter

import numpy as np

from snapweave.llm import lm_score as L

SF = "/root/testdata/sf0.01"


def octave(c):
    return min(int(math.log2(c)) + 1, L.BUCKETS - 1) if c else 0


def plain(texts):
    """Base and model scores by dictionaries."""
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in texts.items()}
    rest = {i: zlib.crc32(str(i).encode()) % 5 for i in tokens}

    def counts(ok):
        u, b = Counter(), Counter()
        for i, w in tokens.items():
            if ok(rest[i]):
                u.update(w)
                b.update(zip([None] + w, w))
        return u, b

    core, core2 = counts(lambda r: r not in (0, 1))
    u, b = counts(lambda r: r != 1)
    types, n = len(core), sum(core.values())
    events = {}
    for i, w in tokens.items():
        if rest[i] == 0:
            for v, x in zip([None] + w, w):
                events.setdefault(octave(core[v]), []).append(
                    (core2[v, x] / max(core[v], 1) * (types + 1), core[x] / n * (types + 1)))
    weights = {k: L.em(np.ones(len(e)), *np.array(e).T) for k, e in events.items()}
    everything = np.array([x for e in events.values() for x in e])
    shared = L.em(np.ones(len(everything)), *everything.T)
    v1, total = len(u) + 1, sum(u.values())
    out = {}
    for i, w in tokens.items():
        base = sum(math.log10((u[x] + 0.5) / (total + 0.5 * v1)) for x in w)
        score = 0.0
        for v, x in zip([None] + w, w):
            l2, l1, l0 = weights.get(octave(u[v]), shared)
            if not u[v]:
                l2 = 0.0
            l2, l1, l0 = np.maximum([l2, l1, l0], [0, L.LEAST_WEIGHT, L.LEAST_WEIGHT]) / sum((l2, l1, l0))
            score += math.log10(l2 * b[v, x] / max(u[v], 1) + l1 * u[x] / total + l0 / v1)
        out[i] = (rest[i] == 1, len(w), sum(u[x] > 0 for x in w), total, base, score)
    return out


def test_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain({r.doc_id: r.text for r in docs.collect()})
    gain = [0.0, 0.0]
    for r in L.scores(docs, split_chars=300_000).collect():
        held, n, known, total, base, score = want[r["id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        # The weights come from events on a grid, the plain ones from each event.
        assert math.isclose(r["score"], score, rel_tol=1e-3)
        if held:
            gain[0] += base
            gain[1] += r["score"]
    assert gain[1] > 0.9 * gain[0]  # log10 probabilities: the model is likelier on held-out texts


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a c", "b a", "c", "a a", "b b", "c c a"] * 3)],
                                 "doc_id long, text string")
    probes = ["a", "b", "c", "unseen"]
    both = docs.unionByName(spark.createDataFrame([(10**6 + k, p) for k, p in enumerate(probes)], "doc_id long, text string"))
    held = [k for k in range(10**6, 10**6 + 400) if zlib.crc32(str(k).encode()) % 5 == 1][:4]
    both = docs.unionByName(spark.createDataFrame([(k, p) for k, p in zip(held, probes)], "doc_id long, text string"))
    scores = {r["id"]: r["score"] for r in L.scores(both).collect()}
    empty = docs.unionByName(spark.createDataFrame([(held[0], "")], "doc_id long, text string"))
    first_end = {r["id"]: r["score"] for r in L.scores(empty).collect()}[held[0]]
    ends = {p: [r for r in L.scores(docs.unionByName(spark.createDataFrame([(held[0], f"{p} {p}")], "doc_id long, text string")))
                .collect() if r["id"] == held[0]][0]["score"] for p in ["a"]}
    # P(first word) is the score of "w" without that of the end after w; all first words and the end sum to 1.
    assert 0 < 10 ** first_end < 1 and all(0 < 10 ** scores[k] < 1 for k in held) and ends["a"] < scores[held[0]]
    assert 10 ** first_end + sum(10 ** scores[k] for k in held) <= 1 + 1e-9


def test_packed_arrays():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64) * 2 + rng.integers(0, 2, 5000, dtype=np.uint64))
    assert (L.unpack_keys(L.pack_keys(keys)) == keys).all()
    counts = rng.integers(0, 2**40, 5000)
    assert (L.unpack_counts(L.pack_counts(counts)) == counts).all()
    ends = L.bucket_bounds(keys, 7)
    assert ends[-1] == len(keys) and (np.diff(ends) >= 0).all()
    assert all((int(keys[e - 1]) * 7) >> 64 < i + 1 for i, e in enumerate(ends) if e)


def test_em_prefers_the_better_estimate():
    w = L.em(np.ones(100), np.full(100, 50.0), np.full(100, 2.0))
    assert w[0] > 0.95 and math.isclose(w.sum(), 1)

"""Phrases against plain counting, chunks and slices, exact scores, containment and ties."""

import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import CLASH
from pyspark.sql import functions as F

from snapweave.llm import collocations as C


def plain(docs, least, longest, top):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            sizes[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in counts.items():
        c = {p: f for p, f in c.items() if f >= least}
        rows = []
        for p, a in c.items():
            if len(p) < 2 or any(len(q) > len(p) and 100 * f >= 100 * a and
                                 any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f in c.items()):
                continue
            score, k = min((1000 * a * sizes[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -s))
    return sorted(out)


def got(spark, docs, **kw):
    df = spark.createDataFrame([(t, lang) for lang, t in docs], "text string, lang string").repartition(3)
    df = df.select("*", *[F.lit("x").alias(c) for c in (*CLASH, "chunk", "stream", "local", "first", "last", "f", "phrase")])
    return sorted(tuple(r) for r in C.collocations(df, **kw).collect())


def sample(n, seed):
    rng = random.Random(seed)
    vocabulary = ["Ab", "c", "dé", "\x1cx", "e-f", "ß", "zz", "q\xa0r", "\U0001f600"]
    marks = [" ", " ", " ", " \t ", "  ", ". ", ",", "\n", "!"]
    return [(rng.choice(["en", "de", None, "und"]),
             "".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randint(0, 60)))) for _ in range(n)] \
        + [("en", None), ("fr", ""), (None, None), ("fr", " . , ! ")]


@pytest.mark.parametrize("chunk, size", [(C.CHUNK, C.SLICE), (40, 16), (1, 3)])
def test_plain_counting(spark, monkeypatch, chunk, size):
    monkeypatch.setattr(C, "SLICE", size)
    docs = sample(120, 7)
    assert got(spark, docs, least=4, longest=5, top=40, chunk=chunk) == plain(docs, 4, 5, 40)


def test_contained_phrases_go_and_others_stay(spark):
    docs = [("en", "a b c d. " * 5 + "b c. " + "x y. " * 3)]
    rows = got(spark, docs, least=3, longest=5, top=10)
    assert [r[2] for r in sorted(rows, key=lambda r: r[1])] == [r[2] for r in sorted(plain(docs, 3, 5, 10), key=lambda r: r[1])]
    assert {r[2] for r in rows} == {"a b c d", "b c", "x y"}


def test_a_language_with_most_rows_is_cut_to_the_top(spark):
    docs = [("en", " ".join(f"w{i} w{i + 1};" for _ in range(3))) for i in range(200)] + [("de", "p q. " * 3)]
    assert got(spark, docs, least=3, top=50) == plain(docs, 3, 5, 50)


def test_slices_give_the_words_of_the_whole():
    rng = random.Random(1)
    text = "".join(rng.choice("ab \t.\né") for _ in range(4000)).encode()
    whole = [w for w in re.sub(rb"[.,;:!?\n\x0b\x0c\r]", b" \xff ", text).split()] + [C.BREAK]
    before = C.SLICE
    try:
        for C.SLICE in (1, 2, 7, 100):
            assert [w for some in C.tokens(text) for w in some] == whole
    finally:
        C.SLICE = before


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**13, 10**14, 10**13, 10**13 + 1), (3, 7, 2, 5), (100, 10**15, 101, 103), (10**14 + 7, 10**15 + 3, 10**14 + 9, 10**14 + 11)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    scores = [r[0] for r in df.select(C.score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()]
    assert scores == [1000 * a * n // (left * right) for a, n, left, right in rows]


def test_streams_are_merged_in_order(spark):
    docs = spark.createDataFrame([("a b c. " * 5, "en")], "text string, lang string")
    _, orders = C.phrase_counts(docs, least=2)
    plan = C.cuts(orders)._jdf.queryExecution().toString()
    assert plan.count("SortMergeJoin") >= 2 and "BroadcastHashJoin" not in plan and "ShuffledHashJoin" not in plan

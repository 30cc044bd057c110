"""Near words against all pairs, the chain of forms, and the cut letters."""

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from snapweave.llm import spelling as S


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) >= len(b)):] == b[p + (len(b) >= len(a)):]


def word_table(spark, counts):
    return S.cut_lineage(spark.createDataFrame(sorted(counts.items()), "word string, n long"))


def test_near_pairs_are_all_pairs_of_one_edit(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("abé", k=rng.randint(7, 9))) for _ in range(600)}
    words |= {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ÿaaaaaaa", "aaaaaaaÀ"}
    got = sorted(tuple(sorted((r.a, r.b))) for r in S.near_pairs(word_table(spark, dict.fromkeys(words, 2))).collect())
    ranked = sorted(words)
    want = [(a, b) for i, a in enumerate(ranked) for b in ranked[i + 1:] if one_edit(a, b)]
    assert got == want and len(want) > 300


def test_signatures_of_a_dense_family(spark):
    # All words differ in one letter from the middle one: a star that nothing may lose.
    middle = "abcdefghijklm"
    star = {middle[:i] + x + middle[i + 1:] for i in range(len(middle)) for x in "xyz"} | {middle}
    star |= {middle[:i] + middle[i + 1:] for i in range(len(middle))} | {middle[:i] + "x" + middle[i:] for i in range(14)}
    found = S.near_pairs(word_table(spark, dict.fromkeys(star, 2)))
    assert found.filter((F.col("a") == middle) | (F.col("b") == middle)).count() == len(star) - 1


def test_forms_ties_and_roots(spark):
    counts = {"abcdefgh": 3, "abcdefgi": 30, "abcdefgj": 30, "abcdefij": 299, "abcdeeij": 300, "abcddeij": 3000,
              "zzzzzzzz": 5, "abcccdeij": 30000}
    found = {r.word: r for r in S.forms(word_table(spark, counts)).collect()}
    assert found["abcdefgh"].form == "abcdefgi" and found["abcdefgh"].n_near == 2  # a tie: the first in order
    assert found["abcdefgj"].form is None  # 299 are less than ten times 30
    assert found["abcdeeij"].form == "abcddeij" and found["abcddeij"].form is None
    assert (found["zzzzzzzz"].n_near, found["zzzzzzzz"].form, found["zzzzzzzz"].form_n) == (0, None, None)


def test_roots_follow_long_chains(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(19)] + [("v", "w18"), ("w19", None)],
                                  "word string, form string")
    assert {r.word: r.root for r in S.roots(S.cut_lineage(links)).collect()} == {f"w{i}": "w19" for i in range(19)} | {"v": "w19"}


def test_counts_by_hand(spark):
    texts = [(1, "Überfluss überfluss, naïvely Naïvely ABCDEFG abcdefg short"), (2, "abcdefg×÷ abcdefg×÷ x"), (3, None),
             (None, "abcdefg nullnull nullnull"), (3, "repeated repeated"), (3, "repeated")] \
        + [(i, "wordword") for i in range(100, 400)]
    want = Counter()
    for i, text in texts:
        for run in plain_runs(text or ""):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.word: r.n for r in S.word_counts(docs).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2 and len(w) >= 7}
    assert 280 <= got["wordword"] < 300


def plain_runs(text):
    import re
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall("[A-Za-zÀ-ÿ]+", low)


def test_the_join_keeps_a_plan_that_splits_hot_keys(spark):
    pairs = S.near_pairs(word_table(spark, {"abcdefgh": 2, "abcdefgi": 2}))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" in plan and "Cartesian" not in plan and "cross" not in plan.lower()

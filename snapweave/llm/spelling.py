"""Spelling variants grouped with PartEnum signatures.

Words are counted over all texts; two words are near if they differ by exactly one inserted, deleted
or replaced code point. A word's form is its most frequent near word, if that is at least ``RATIO``
times as frequent; following forms leads to the word's root.

Search. A word is the binary vector of its letter multiset: element ``(letter, i)`` is set for the
``i``-th occurrence of a letter. One edit changes at most two elements: an insertion or deletion exactly
one, a replacement exactly two. The elements are partitioned, and signatures are enumerated that leave
parts out: two vectors that differ in ``k`` elements agree on some choice of ``parts - k`` parts.

* Replacements (equal length, ``k`` = 2): all choices of two of ``SAME_PARTS`` parts to leave out.
* Insertions and deletions (lengths one apart, ``k`` = 1): one of ``STEP_PARTS`` parts left out, once
  as the longer and once as the shorter word.

The lengths are part of the signature. So is half of the word: one edit leaves the letters before it or
those after it in place, so the words share their first or their last half; words of the same
letters in another order would otherwise fill one signature (on 370,000 words the largest group falls
from 10,000 words to 700). A signature is the 64-bit hash of all this; an equi-join on it gives the candidate
pairs, and the join's own condition verifies each by edit distance, so only near pairs leave the join,
and a false agreement of hashes costs a comparison, never a result. The join is a plain shuffle join
without a hint, whose hot keys Spark splits at run time.

Growth: signatures are 24 rows a distinct word; nothing is broadcast by this module and nothing goes to
the driver but row counts. Roots are found by pointer doubling: a form is at least ``RATIO`` times as
frequent as its word, so chains are at most 19 long and five rounds suffice.

Defined cases: null and empty texts have no words; a null id counts as the empty text in the checksum;
rows that repeat an id are rows of their own, all counted; of near words with equal counts the first in
code-point order is the form; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_table
from .common import map_batches, mixed, table, text_or_empty

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many occurrences has a letter deleted.
EVERY = 31
RUN = r"[A-Za-zÀ-ÿ]{%d,}"
SAME_PARTS, STEP_PARTS = 4, 3
#: Roles of a signature row: of words of equal length, of the longer and of the shorter word.
SAME, LONGER, SHORTER = 0, 1, 2
#: Words of a task that enumerates signatures.
WORDS = 200_000


# --- words -------------------------------------------------------------------------------------

def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """``(word, n)`` of the words with at least ``least_length`` letters and ``least_count`` occurrences."""
    text = ascii_lower(text_or_empty(text_col))
    # A deletion makes words shorter, so shorter runs cannot give a word.
    runs = F.regexp_extract_all(text, F.lit(RUN % least_length), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat_ws(":", "d", "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.pmod(h, F.lit(every)) == 0, cut).otherwise(F.col("run"))
    counted = each.select(word.alias("word")).filter(F.length("word") >= least_length)
    return counted.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


# --- signatures --------------------------------------------------------------------------------

class Letters:
    """The letters of a batch of words as flat arrays: code point, number of the word, place in it."""

    def __init__(self, words: list[str]):
        self.n = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(self.n)
        self.starts = self.ends - self.n
        self.code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.word = np.repeat(np.arange(len(words)), self.n)
        self.place = np.arange(len(self.code)) - np.repeat(self.starts, self.n)

    def elements(self) -> np.ndarray:
        """The hash of element (letter, which occurrence) for each letter."""
        order = np.lexsort((self.code, self.word))
        code, word = self.code[order], self.word[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (word[1:] != word[:-1])
        first = np.flatnonzero(new)
        nth = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
        out = np.empty(len(code), np.uint64)
        out[order] = mixed(code << np.uint64(32) | nth.astype(np.uint64))
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)

    def parts(self, parts: int) -> np.ndarray:
        """For each word and part the sum of its elements in that part: equal for equal multisets."""
        e = self.elements()
        part = (e >> np.uint64(17)) % np.uint64(parts)
        return np.stack([self.sums(np.where(part == p, mixed(e + np.uint64(1)), np.uint64(0))) for p in range(parts)])

    def first(self, letters: np.ndarray) -> np.ndarray:
        """The hash of each word's first so many letters."""
        h = mixed(self.code << np.uint64(32) | self.place.astype(np.uint64))
        return self.sums(np.where(self.place < np.repeat(letters, self.n), h, np.uint64(0)))

    def last(self, letters: np.ndarray) -> np.ndarray:
        back = np.repeat(self.n, self.n) - 1 - self.place
        h = mixed(self.code << np.uint64(32) | back.astype(np.uint64) | np.uint64(1 << 31))
        return self.sums(np.where(back < np.repeat(letters, self.n), h, np.uint64(0)))


def signatures(words: list[str]):
    """``(role, array of a signature for each word)`` of every role and choice of parts."""
    letters = Letters(words)
    n = letters.n

    def sign(left: np.ndarray, half: np.ndarray, longer: np.ndarray, tag: int) -> np.ndarray:
        return mixed(mixed(left + np.uint64(tag)) ^ mixed(half + longer.astype(np.uint64)))

    parts = letters.parts(SAME_PARTS)
    total = parts.sum(axis=0)
    halves = letters.first(n // 2), letters.last(n - n // 2)
    for i in range(SAME_PARTS):
        for j in range(i):
            for half in halves:
                yield SAME, sign(total - parts[i] - parts[j], half, n, i * SAME_PARTS + j)
    parts = letters.parts(STEP_PARTS)
    total = parts.sum(axis=0)
    # Half of the shorter word: its first letters, or the last ones of either word.
    for role, shorter in ((LONGER, n - 1), (SHORTER, n)):
        halves = letters.first(shorter // 2), letters.last(shorter - shorter // 2)
        for i in range(STEP_PARTS):
            for half in halves:
                yield role, sign(total - parts[i], half, shorter, -1 - i & 0xFFFF)


def signature_batch(batch) -> dict:
    words = batch.column("word").to_pylist()
    signed = list(signatures(words)) if words else []
    at = np.tile(np.arange(len(words)), len(signed))
    roles = np.repeat(np.array([r for r, _ in signed], np.int8), len(words))
    keys = np.concatenate([k for _, k in signed]) if signed else np.empty(0, np.uint64)
    return {"signature": keys.view(np.int64), "role": roles, "word": batch.column("word").take(pa.array(at)),
            "n": batch.column("n").take(pa.array(at))}


def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, a_n, b, b_n)``, each pair of near words once. ``words``: a written table ``(word, n)`` of
    distinct words."""
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, words.count() // WORDS)
    rows = map_batches(words.select("word", "n").repartition(tasks), signature_batch,
                       "signature bigint, role byte, word string, n bigint")
    a, b = rows.alias("a"), rows.alias("b")
    roles = ((F.col("a.role") == SAME) & (F.col("b.role") == SAME) & (F.col("a.word") < F.col("b.word"))) \
        | ((F.col("a.role") == LONGER) & (F.col("b.role") == SHORTER))
    near = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    found = a.join(b, (F.col("a.signature") == F.col("b.signature")) & roles & near)
    # A pair may agree on several signatures.
    return found.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"),
                        F.col("b.n").alias("b_n")).distinct()


# --- forms and roots ---------------------------------------------------------------------------

def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` with ``n_near``, ``form`` and ``form_n``."""
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), (-F.col("b_n")).alias("m"), F.col("b").alias("near")),
        F.struct(F.col("b").alias("word"), (-F.col("a_n")).alias("m"), F.col("a").alias("near")))).alias("p"))
    best = both.groupBy("p.word").agg(F.count(F.lit(1)).alias("n_near"),
                                      F.min(F.struct("p.m", "p.near")).alias("best"))
    joined = words.select("word", "n").join(best, "word", "left")
    is_form = -F.col("best.m") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                         F.when(is_form, F.col("best.near")).alias("form"),
                         F.when(is_form, -F.col("best.m")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """``(word, root)`` of the words that have a form, by pointer doubling. ``found``: a written table."""
    links = cut_lineage(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(ahead, "root", "left_semi").isEmpty():
            return links
        before, links = links, cut_lineage(links.join(ahead, "root", "left")
                                           .select("word", F.coalesce("next", "root").alias("root")))
        drop_table(before)


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """One row per word: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``."""
    words = cut_lineage(word_counts(docs, id_col, text_col, least_length, least_count))
    found = cut_lineage(forms(words, ratio))
    drop_table(words)
    return found.join(roots(found), "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark, sf_dir):
    return variant_groups(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


#: Near words by deleting each letter: a replacement leaves the same rest at the same place, an insertion
#: or deletion makes the rest of one word the other. The checksum is computed byte by byte; the letters
#: that occur take one or two bytes each.
SQL = r"""
WITH RECURSIVE steps AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
        lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
per_doc AS (SELECT d, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
coded AS (
    SELECT run, n, flatten(list_transform(string_split(d || ':' || run, ''), lambda c:
        CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c) - 64::BIGINT] END)) AS bytes
    FROM per_doc),
summed AS (
    SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes),
        lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1])))::BIGINT AS h FROM coded, steps),
words AS (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
           sum(n)::BIGINT AS n FROM summed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
rests AS (
    SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS (
    SELECT a.word, b.word AS near, b.n FROM rests a JOIN rests b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
    UNION SELECT r.word, w.word, w.n FROM rests r JOIN words w ON r.rest = w.word
    UNION SELECT w.word, r.word, r.n FROM rests r JOIN words w ON r.rest = w.word),
best AS (
    SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS top, max(n) AS top_n FROM near GROUP BY word),
found AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * w.n THEN top END AS form,
           CASE WHEN top_n >= 10 * w.n THEN top_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (
    SELECT word, word AS root, form AS next FROM found
    UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN found f ON c.next = f.word)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM found f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""

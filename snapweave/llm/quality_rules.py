"""Quality rules with risk-controlled thresholds (native).

Each rule compares one measure of a text with a cutoff; a text above it is rejected. Cutoffs are
not guessed: labelled documents are the holdout. For every stratum (language) and rule the fixed
candidate cutoffs are tested from the most lenient to the strictest. The hypothesis "this cutoff
rejects more than ``max_false / number of rules`` of the good texts" is given up when the exact
binomial probability of as few rejected good texts as were seen is at most
``delta / (strata * rules)`` (Bonferroni over strata and rules); the sequence stops at the first
cutoff that fails (fixed-sequence testing, which needs no correction within the sequence). All
certified cutoffs hold at once with probability ``1 - delta``, so any choice among them keeps the
guarantee that at most ``max_false`` of a stratum's good texts are rejected; the choice is the one
with the largest ``bad rejected - 10 * good rejected``, the more lenient of equals, and none if
that is not positive. A stratum with too few labels to certify anything keeps all it has.

Three-word windows are compared by 64-bit hashes within one text.

Defined cases: null text has no words and fails the base rule; null strata count as ''; labels
without an id or a quality are ignored, of several labels of one id the best counts; an empty table
gives no rows; repeated rows are judged one by one; other columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACE, SPACES, rows_of, table, text_or_empty, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_FALSE, DELTA, COST = 0.05, 0.05, 10
#: Hash buckets of labelled ids that are sent to every executor: the bound of that broadcast, whatever the tables' size.
LABEL_BUCKETS = 1 << 18
#: Rule -> measure over the counted columns, candidate cutoffs from lenient to strict.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [4, 3, 2, 1.5, 1, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1,
                                        0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "long_words": ("word_chars / greatest(n_words, 1)", [30, 25, 20, 18, 16, 14, 12, 11, 10, 9, 8.5, 8, 7.5, 7, 6.5, 6]),
    "short_words": ("-(word_chars / greatest(n_words, 1))", [-0.5, -1, -1.5, -2, -2.5, -3, -3.25, -3.5, -3.75, -4]),
}


def counted(text: Column) -> dict[str, Column]:
    """The counts of a text as columns; ``w`` is an array column of its words."""
    w = F.col("w")
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(F.translate(x, SPACES, " " * 6)) != "")
    return {
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
        "lines": lines,
        "repeated": repeated(w),
    }


def repeated(w: Column) -> Column:
    """Words of ``w`` that lie in a three-word window found twice or more. Windows are sorted as
    ``(hash, place)``; equal neighbours give the places of all repeated windows; each covers up
    to the next place, three words at most. No pass is longer than n log n."""
    n = F.size(w)

    def after(k: int) -> Column:
        return F.slice(w, k + 1, F.greatest(n, F.lit(1)))

    pairs = F.zip_with(w, after(1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hashes = F.zip_with(pairs, after(2), lambda x, c: F.xxhash64(x["a"], x["b"], c))
    keyed = F.sort_array(F.transform(F.slice(hashes, 1, F.greatest(n - 2, F.lit(0))),
                                     lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(n >= 4, keyed)


def covered(keyed: Column) -> Column:
    """The number of words that repeated windows cover, from the sorted ``(hash, place)``."""
    after = F.slice(keyed, 2, F.greatest(F.size(keyed), F.lit(1)))
    pairs = F.zip_with(keyed, after, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))


def cover_size(places: Column) -> Column:
    after = F.slice(places, 2, F.greatest(F.size(places), F.lit(1)))
    spans = F.zip_with(places, after, lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.coalesce(F.aggregate(spans, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("bigint")


def features(docs: DataFrame, text_col: str = "text", keep: list[Column] = ()) -> DataFrame:
    """The counts of each text, the base verdict, and the columns of ``keep``."""
    kept = [f"_{i}" for i in range(len(keep))]
    d = docs.select(*[c.alias(n) for c, n in zip(keep, kept)], text_or_empty(text_col).alias("t"))
    d = d.withColumn("w", words(F.col("t")))
    d = d.select(*kept, *[c.alias(n) for n, c in counted(F.col("t")).items()])
    d = d.withColumn("places", covered(F.col("repeated")))
    d = d.select(*kept, "n_words", "word_chars", "n_symbols", F.size("lines").cast("bigint").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
                 cover_size(F.col("places")).alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def measure(rule: str) -> Column:
    return F.expr(RULES[rule][0]).cast("double")


def log_factorial(n: Column) -> Column:
    """``ln(n!)`` by Stirling's series at ``n + 9``, less the factors in between."""
    z = n.cast("double") + 9.0
    series = 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - 1 / (1680 * z ** 7)
    between = F.lit(0.0)
    for i in range(1, 9):
        between = between + F.log(n + F.lit(float(i)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - between


def too_few(k: Column, n: Column, limit: float) -> Column:
    """P(X <= k) of a binomial with ``n`` trials of chance ``limit``, 1 where k reaches its mean. Summed
    downwards from ``k`` in log space; terms 12 standard deviations below the largest no longer matter."""
    odds, miss = math.log(limit / (1 - limit)), math.log1p(-limit)
    largest = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.lit(odds) + n * F.lit(miss)
    terms = F.least(k, F.ceil(12 * F.sqrt(n * F.lit(limit))) + 64)
    total = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), terms),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda s, i: F.struct((s["term"] * ((k - i) / (n - k + i + 1)) * F.lit(math.exp(-odds))).alias("term"),
                              (s["total"] + s["term"]).alias("total")))["total"]
    return F.when((n == 0) | (k >= n * limit), F.lit(1.0)).otherwise(F.exp(largest) * total)


def cutoffs(labelled: DataFrame, max_false: float = MAX_FALSE, delta: float = DELTA) -> DataFrame:
    """``(stratum, rule, cutoff)`` chosen from ``labelled``: the counts of each labelled text that
    passed the base rule, its stratum and its quality (1 good, 0 bad)."""
    limit = max_false / len(RULES)
    over = [F.struct(F.lit(r).alias("rule"), F.array(*[
        F.struct(F.lit(float(c)).alias("cutoff"),
                 F.count(F.when((F.col("quality") == 1) & (measure(r) > c), 1)).alias("k"),
                 F.count(F.when((F.col("quality") == 0) & (measure(r) > c), 1)).alias("bad"))
        for c in grid]).alias("tests")) for r, (_, grid) in RULES.items()]
    seen = cut_lineage(labelled.groupBy("stratum").agg(
        F.count(F.when(F.col("quality") == 1, 1)).alias("n"), F.array(*over).alias("rules")))
    level = delta / max(1, seen.count() * len(RULES))
    each = seen.select("stratum", "n", F.explode("rules").alias("r")) \
        .select("stratum", "n", "r.rule", F.posexplode("r.tests").alias("at", "t")) \
        .select("stratum", "rule", "at", "t.cutoff", "t.k", "t.bad",
                (too_few(F.col("t.k"), F.col("n"), limit) <= level).alias("certified"))
    best = each.groupBy("stratum", "rule").agg(
        F.min(F.when(~F.col("certified"), F.col("at"))).alias("stop"),
        F.collect_list(F.struct("at", "cutoff", (F.col("bad") - COST * F.col("k")).alias("gain"))).alias("tests"))
    usable = F.filter("tests", lambda t: (t["gain"] > 0) & (t["at"] < F.coalesce(F.col("stop"), F.lit(1 << 30))))
    top = F.array_max(F.transform(usable, lambda t: F.struct(t["gain"], (-t["at"]).alias("lenient"), t["cutoff"])))
    return best.select("stratum", "rule", top["cutoff"].alias("cutoff")).filter("cutoff IS NOT NULL")


def labels_of(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.max("quality").alias("quality"))


def fitted(docs: DataFrame, labels: DataFrame, counted_docs: DataFrame | None = None) -> DataFrame:
    """One row per stratum with its cutoffs as the map ``cut``, written to the shared folder."""
    if counted_docs is None:
        # Written first: a filter by counts would move below them and compute them once per mention.
        counted_docs = cut_lineage(features(docs, keep=[F.col("doc_id"), text_or_empty("lang")]))
    lab = counted_docs.filter("NOT base_failed").join(
        labels_of(labels).withColumnRenamed("doc_id", "_0"), "_0").withColumnRenamed("_1", "stratum")
    return cut_lineage(cutoffs(lab).groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut")))


def verdict() -> Column:
    """False if the base rule or any rule with a cutoff rejects the row (counts beside ``cut``). One
    condition over both sides of the join with the cutoffs: a filter by it stays above that join, so
    that the counts, which it names often, are not computed again for each mention."""
    hit = F.lit(False)
    for r in RULES:
        hit = hit | F.coalesce(measure(r) > F.col("cut")[r], F.lit(False))
    return F.when(F.col("base_failed"), F.lit(False)).otherwise(~hit)


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, ``base_failed`` and ``kept``."""
    f = cut_lineage(features(docs, keep=[F.col("doc_id"), text_or_empty("lang")]))
    cut = fitted(docs, labels, f)
    return f.join(cut, f["_1"] == cut["stratum"], "left").withColumn("kept", verdict()) \
        .withColumnRenamed("_0", "doc_id").drop("_1", "stratum", "cut")


def maybe_labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id shares one of ``LABEL_BUCKETS`` hash buckets with a labelled id: all labelled
    rows, and others that :func:`fitted` drops again by its exact join. The buckets, at most ``LABEL_BUCKETS``
    rows, are broadcast, so no text is moved however many labels there are."""
    def bucket(doc_id):
        return F.pmod(F.xxhash64(doc_id.cast("bigint")), F.lit(LABEL_BUCKETS)).cast("int")

    seen = cut_lineage(labels_of(labels).select(bucket(F.col("doc_id")).alias("label_bucket")).distinct())
    return docs.join(F.broadcast(seen), bucket(docs["doc_id"]) == seen["label_bucket"], "left_semi")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns. The fit counts the documents that may be labelled
    and joins their counts, not their texts, with the labels; the verdicts count every document once, where
    it is read."""
    cut = fitted(maybe_labelled(docs, labels), labels)
    rows = rows_of(docs, text=F.col("text"), lang=text_or_empty("lang"))
    f = features(rows, keep=[F.col("row"), F.col("lang")])
    return f.join(cut, f["_1"] == cut["stratum"], "left").filter(verdict()).select("_0.*")


def query(spark, sf_dir):
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql() -> str:
    grid = ", ".join(f"('{r}', {i}, ({c})::DOUBLE)" for r, (_, g) in RULES.items() for i, c in enumerate(g))
    value = " ".join(f"WHEN '{r}' THEN ({RULES[r][0]})::DOUBLE" for r in RULES)
    limit = MAX_FALSE / len(RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t
           FROM documents),
l AS (SELECT *, list_filter(string_split_regex(t, '{SPACE}+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM l)),
hot AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM hot, (VALUES (0), (1), (2)) v(o) GROUP BY rid),
f AS (SELECT l.rid, doc_id, stratum, len(w)::BIGINT AS n_words,
             length(regexp_replace(t, '{SPACE}+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM l LEFT JOIN rep ON l.rid = rep.rid),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f),
grid(rule, pos, cutoff) AS (VALUES {grid}),
m AS (SELECT b.*, rule, CASE rule {value} END AS v FROM b, (SELECT DISTINCT rule FROM grid) r),
lab AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
seen AS (SELECT stratum, m.rule, pos, cutoff, count(*) FILTER (quality = 1) AS n,
                count(*) FILTER (quality = 1 AND v > cutoff) AS k,
                count(*) FILTER (quality = 0 AND v > cutoff) AS bad
         FROM m JOIN lab USING (doc_id) JOIN grid ON grid.rule = m.rule WHERE NOT base_failed GROUP BY ALL),
tail AS (SELECT stratum, rule, pos, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
                + i * ln({limit}) + (n - i) * ln(1 - {limit}))) AS p
         FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM seen WHERE n > 0 AND k < n * {limit}) GROUP BY ALL),
cert AS (SELECT seen.*, coalesce(p, 1) <= {DELTA} / ({len(RULES)} * (SELECT count(DISTINCT stratum) FROM seen)) AS ok
         FROM seen LEFT JOIN tail USING (stratum, rule, pos)),
run AS (SELECT *, min(CASE WHEN NOT ok THEN pos END) OVER (PARTITION BY stratum, rule) AS stop FROM cert),
cut AS (SELECT stratum, rule, arg_max(cutoff, (bad - {COST} * k) * 1000 - pos) AS cutoff FROM run
        WHERE pos < coalesce(stop, 1000000) AND bad > {COST} * k GROUP BY ALL),
bad AS (SELECT DISTINCT rid FROM m JOIN cut ON m.stratum = cut.stratum AND m.rule = cut.rule WHERE v > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept
FROM b
"""

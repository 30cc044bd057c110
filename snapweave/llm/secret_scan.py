"""Secret scan (native): named patterns, and sliding-window entropy of candidate strings.

Base kinds: ``assign`` (a credential name, ``:`` or ``=``, a value of 12 characters or more),
``access`` (``AKIA`` keys of 18 or more) and ``hex`` (runs of 16 or more). Matches are leftmost and
non-overlapping per kind; one that fails its length test is dropped and not retried.

The method adds ``entropy`` spans. A candidate is a maximal run of one character class (see
``CLASSES``) that is long enough and not on the allow list. A window slides over it; the count of
each character in the window is kept up to date by one addition and one subtraction per step, and
with it the sum of ``c * log2 c``, from which the window's Shannon entropy is
``log2(width) - sum / width``. The span runs from the first window at or above the class's
threshold to the end of the last one. It is left out when a base span or a span of an earlier class
holds it.

Defined cases: null text counts as empty (no spans, digest of the empty string); repeated rows are
scanned one by one; null ids pass through; an empty table gives no rows; other columns do not
matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .spans import SPAN, joined, matches

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ["assign", "access", "hex", "entropy"]


@dataclass(frozen=True)
class CharClass:
    """Candidates are maximal runs of ``chars``; a window of ``width`` must reach ``bits``."""

    name: str
    chars: str
    alphabet: str
    width: int
    bits: float


#: Base-16 digits of either case, and the base-64 alphabets. A random window of 16 base-16 digits
#: has about 3.2 bits, one of 20 base-64 characters about 4.1; prose of that length about 3.3.
CLASSES = (
    CharClass("hex", "0-9A-Fa-f", "0123456789abcdefABCDEF", 16, 3.0),
    CharClass("base64", "A-Za-z0-9+/_=-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.9),
)
#: Candidates of these shapes are no secrets: words and their compounds, numbers and dates, rulers,
#: constants in capitals, and UUIDs.
ALLOW = (
    r"^[A-Z]?[a-z]+([-_/=+]+[A-Z]?[a-z]+)*[-_/=+]*$",
    r"^[0-9]+([-_/+=][0-9]+)*$",
    r"^[-_/=+]+$",
    r"^[A-Z]+([-_/=+]+[A-Z]+)*$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)
#: Spans that name themselves as samples are none either. Tested is the longest piece between ``/`` and ``=`` of
#: the span, as its candidate may be a path with ``examples/`` in it.
SAMPLE = r"(?i)(example|sample|placeholder|changeme|xxxx)"


def allowed(candidate: Column) -> Column:
    hit = F.lit(False)
    for p in ALLOW:
        hit = hit | candidate.rlike(p)
    return hit


def hot_windows(candidate: Column, c: CharClass) -> Column:
    """``(first, last)``: the ends of the first and the last window of ``candidate`` that reaches
    the class's threshold, null if none does."""
    share = F.array(*[F.lit(0.0)] + [F.lit(i * math.log2(i)) for i in range(1, c.width + 1)])
    place = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(c.alphabet), ch))
    leaving = F.concat(F.array_repeat(F.lit(0), c.width), place)
    steps = F.zip_with(place, F.slice(leaving, 1, F.size(place)),
                       lambda i, o: F.struct(i.alias("into"), o.alias("out")))
    start = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0), len(c.alphabet)).alias("counts"),
                     F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"),
                     F.lit(None).cast("int").alias("last"))

    def at(counts: Column, i: Column) -> Column:
        return F.when(i > 0, F.element_at(counts, i)).otherwise(F.lit(0))

    def weight(n: Column) -> Column:
        return F.element_at(share, n + 1)

    def step(s: Column, x: Column) -> Column:
        gone = at(s["counts"], x["out"])
        came = at(s["counts"], x["into"]) - F.when(x["into"] == x["out"], 1).otherwise(0)
        total = s["sum"] + F.when(x["out"] > 0, weight(gone - 1) - weight(gone)).otherwise(0.0) \
            + weight(came + 1) - weight(came)
        counts = F.transform(s["counts"], lambda n, k: n + F.when(k + 1 == x["into"], 1).otherwise(0)
                             - F.when(k + 1 == x["out"], 1).otherwise(0))
        i = s["i"] + 1
        hot = (i >= c.width) & (F.lit(math.log2(c.width)) - total / c.width >= c.bits - 1e-9)
        return F.struct(i.alias("i"), counts.alias("counts"), total.alias("sum"),
                        F.when(hot & s["first"].isNull(), i).otherwise(s["first"]).alias("first"),
                        F.when(hot, i).otherwise(s["last"]).alias("last"))

    return F.aggregate(steps, start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def entropy_spans(text: Column, c: CharClass, kind: int) -> Column:
    pattern = f"[{c.chars}]{{{c.width},}}"
    found = matches(text, pattern, kind, pattern, lambda m: ~allowed(m))
    hot = F.transform(found, lambda s: F.struct(
        s.alias("s"), hot_windows(F.substring(text, s["start"] + 1, s["end"] - s["start"]), c).alias("hot")))
    spans = F.transform(F.filter(hot, lambda h: h["hot"]["first"].isNotNull()), lambda h: F.struct(
        (h["s"]["start"] + h["hot"]["first"] - c.width).alias("start"), h["s"]["kind"].alias("kind"),
        (h["s"]["start"] + h["hot"]["last"]).alias("end")))
    return F.filter(spans, lambda s: ~longest_piece(F.substring(text, s["start"] + 1, s["end"] - s["start"])).rlike(SAMPLE))


def longest_piece(span: Column) -> Column:
    return F.array_max(F.transform(F.split(span, "[/=]"), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]


def outside(spans: Column, others: Column) -> Column:
    """The spans that none of ``others`` holds."""
    return F.filter(spans, lambda a: ~F.exists(others, lambda b: (b["start"] <= a["start"]) & (b["end"] >= a["end"])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``base`` and ``added`` span arrays ``(start, kind, end)`` ordered by start and
    kind (an index into ``KINDS``)."""
    d = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    t = F.col("t")
    d = d.select(
        "id", "t",
        matches(t, ASSIGN, 0, ASSIGN[:-2] + "{12,})", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12).alias("assign"),
        matches(t, "AKIA[A-Z0-9]+", 1, "AKIA[A-Z0-9]{14,}", lambda m: F.length(m) >= 18).alias("access"),
        matches(t, "[0-9a-f]{16,}", 2, "[0-9a-f]{16,}", lambda m: F.lit(True)).alias("hex"),
        *[entropy_spans(t, c, 3).alias(f"e{i}") for i, c in enumerate(CLASSES)])
    d = d.select("id", F.sort_array(F.concat("assign", "access", "hex")).alias("base"), "assign", "access", "hex",
                 *[f"e{i}" for i in range(len(CLASSES))])
    added = F.array().cast(SPAN)
    for i in range(len(CLASSES)):
        d = d.withColumn(f"a{i}", outside(F.col(f"e{i}"), F.concat(F.col("base"), *[F.col(f"a{k}") for k in range(i)])))
    added = F.sort_array(F.concat(*[F.col(f"a{i}") for i in range(len(CLASSES))]))
    return d.select("id", "assign", "access", "hex", "base", added.alias("added"))


def query(spark, sf_dir):
    d = scan(table(spark, sf_dir, "documents"))
    return d.select(
        F.col("id").alias("doc_id"), *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.size("added").cast("bigint").alias("n_entropy"),
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat("base", "added")), KINDS).alias("spans"))


def sql() -> str:
    assign = ASSIGN.removeprefix("(?i)").replace("'", "''")
    allow = " OR ".join(f"regexp_matches(m, '{p}')" for p in ALLOW)

    def found(name, pattern, kind, keep, flags=""):
        split = f"string_split_regex(t, '{flags}{pattern}')"
        return f"""{name} AS (
  SELECT rid, {kind} AS kind, m, sum(len(g) + len(m)) OVER w - len(m) AS s, sum(len(g) + len(m)) OVER w AS e
  FROM (SELECT rid, unnest(regexp_extract_all(t, '{flags}{pattern}')) AS m,
               unnest(list_slice({split}, 1, -2)) AS g,
               unnest(range(len({split}) - 1)) AS i FROM d)
  WINDOW w AS (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING)),
{name}_kept AS (SELECT rid, kind, s, e, m FROM {name} WHERE {keep})"""

    parts = [found("assign", assign, 0, f"len(regexp_extract(m, '(?i){assign}', 2)) >= 12", "(?i)"),
             found("access", "AKIA[A-Z0-9]+", 1, "len(m) >= 18"),
             found("hex", "[0-9a-f]+", 2, "len(m) >= 16")]
    parts.append("base AS (SELECT rid, kind, s, e FROM assign_kept UNION ALL SELECT rid, kind, s, e FROM access_kept "
                 "UNION ALL SELECT rid, kind, s, e FROM hex_kept)")
    held = "base"
    for c in CLASSES:
        n = f"c_{c.name}"
        parts.append(found(n, f"[{c.chars}]{{{c.width},}}", 3, f"NOT ({allow})"))
        parts.append(f"""{n}_win AS (
  SELECT rid, s, m, i, list_aggregate(string_split(substr(m, i, {c.width}), ''), 'entropy') AS h
  FROM (SELECT *, unnest(range(1, len(m) - {c.width} + 2)) AS i FROM {n}_kept)),
{n}_hot AS (SELECT rid, 3 AS kind, s + min(i) - 1 AS s, s + max(i) - 1 + {c.width} AS e
            FROM {n}_win WHERE h >= {c.bits} - 1e-9 GROUP BY rid, {n}_win.s, m
            HAVING NOT regexp_matches(list_max(list_transform(string_split_regex(
                substr(m, min(i), max(i) - min(i) + {c.width}), '[/=]'), lambda p: {{'n': len(p), 'p': p}})).p, '{SAMPLE}')),
{n}_new AS (SELECT * FROM {n}_hot h WHERE NOT EXISTS (
              SELECT 1 FROM {held} b WHERE b.rid = h.rid AND b.s <= h.s AND b.e >= h.e)),
{n}_all AS (SELECT rid, kind, s, e FROM {held} UNION ALL SELECT rid, kind, s, e FROM {n}_new)""")
        held = f"{n}_all"
    text = "string_agg(['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{', '.join(parts)},
b AS (SELECT rid, {text} AS x FROM base GROUP BY rid),
a AS (SELECT rid, {text} AS x, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
             count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_entropy FROM {held} GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_entropy, 0) AS n_entropy, sha256(coalesce(b.x, '')) AS base_sha256, coalesce(a.x, '') AS spans
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)
"""

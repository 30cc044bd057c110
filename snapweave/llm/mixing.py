"""Mixing sources to target weights by temperature (native).

Weights. A source's weight is its token share raised to an exponent between 0 (all sources alike) and
1 (as they come), normalised. The exponent is bisected on a grid of ``1 / GRID``: the largest one
whose weights reach ``target_entropy`` (a share of the entropy of equal weights), raised to the
smallest one that repeats no source more than ``max_epochs`` times where that is larger. One round
evaluates a whole grid of candidates by one aggregate over the per-source table, so a round stands for
five halvings and only that many rows reach the driver, however many sources there are.

Budget. Each source gets a quota of tokens: its weight of ``budget`` (at most ``max_epochs`` times
what it has), or, with no budget, of the smallest budget that shows every document at least once.

Realisation. A source is read in epochs; each epoch is a permutation of its documents by a hash of
seed, epoch and id, and the last one ends when the quota is used up. A document's place in its
epoch is a sum over those before it, in three levels (documents of a block of about ``BLOCK``,
blocks of a group, groups), so no task ever holds a source. ``mix_block`` deals every source's
schedule evenly over mixing blocks of ``block_tokens`` tokens in all, so that each block holds the
sources by their weights; ordered by ``(mix_block, mix_key)`` the rows are the mixed sequence.

Tokens are white-space separated words and one end per document.

Defined cases: null and empty texts have the one end token; null sources count as ''; rows that
repeat an id stay together in the permutation; null ids come first among equal hashes; an empty table
gives no rows; other columns are ignored by :func:`schedule` and kept by :func:`mixed`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, drop_table
from .common import rows_of, table, text_or_empty, words

TARGET_ENTROPY, MAX_EPOCHS, SEED = 0.95, 2.0, 17
BLOCK, BLOCK_TOKENS = 1024, 1 << 20
GRID, FAN = 1 << 20, 32


def key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """A 60-bit hash of seed, epoch and id."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def counted(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return cut_lineage(docs.select(F.col(id_col).alias("id"), text_or_empty(source_col).alias("source"),
                                   (F.size(words(text_or_empty(text_col))) + 1).cast("bigint").alias("n_tokens")))


def bisected(low: int, high: int, holds, largest: bool) -> int:
    """The largest (or smallest) grid number in ``low..high`` that holds, where those that hold are
    the lower (or upper) ones; ``holds`` maps a list of candidates to the set that does. The end
    that should hold is taken if none does."""
    while high > low:
        step = max(1, -(-(high - low) // FAN))
        tries = sorted({*range(low, high, step), high})
        good = holds(tries)
        if largest:
            at = max((x for x in tries if x in good), default=None)
            if at is None or at == high:
                return low if at is None else high
            low, high = at, min(x for x in tries if x > at)
            if high - low == 1:
                return low
        else:
            at = min((x for x in tries if x in good), default=None)
            if at is None or at == low:
                return high if at is None else low
            low, high = max(x for x in tries if x < at), at
            if high - low == 1:
                return high
    return low


def exponent(sources: DataFrame, target_entropy: float, max_epochs: float, budget: int | None) -> int:
    """The exponent in units of ``1 / GRID``. ``sources``: source, tokens, rows."""
    total = sources.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not total["n"]:
        return GRID
    log_share = F.log(F.col("tokens") / F.lit(float(total["t"])))

    def figures(tries: list[int]) -> list:
        tried = sources.select(log_share.alias("l"), F.explode(F.array(*[F.lit(x) for x in tries])).alias("x"))
        a = F.col("x") / GRID
        return tried.groupBy("x").agg(
            F.sum(F.exp(a * F.col("l"))).alias("z"), F.sum(F.exp(a * F.col("l")) * a * F.col("l")).alias("s"),
            F.min("l").alias("least"), F.max("l").alias("most")).collect()

    def mixed_enough(tries: list[int]) -> set[int]:
        wanted = target_entropy * math.log(total["n"])
        return {r["x"] for r in figures(tries) if math.log(r["z"]) - r["s"] / r["z"] >= wanted - 1e-12}

    def few_epochs(tries: list[int]) -> set[int]:
        good = set()
        for r in figures(tries):
            rest = 1 - r["x"] / GRID
            most = rest * (r["most"] - r["least"]) if budget is None else \
                math.log(budget / total["t"]) - math.log(r["z"]) - rest * r["least"]
            if most <= math.log(max_epochs) + 1e-12:
                good.add(r["x"])
        return good

    return max(bisected(0, GRID, mixed_enough, largest=True), bisected(0, GRID, few_epochs, largest=False))


def quotas(tokens: DataFrame, target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS,
           budget: int | None = None) -> DataFrame:
    """Per source: ``tokens``, ``quota``, ``epochs``, ``last`` (tokens wanted of the last epoch) and
    ``blocks``; a written table."""
    sources = cut_lineage(tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    alpha = exponent(sources, target_entropy, max_epochs, budget) / GRID
    if budget is None:
        most = sources.agg(F.max("tokens")).first()[0]
        quota = F.col("tokens") * F.exp(F.lit(1 - alpha) * F.log(F.lit(float(most or 1)) / F.col("tokens")))
    else:
        z = sources.agg(F.sum(F.exp(F.lit(alpha) * F.log("tokens")))).first()[0]
        quota = F.least(F.lit(float(budget)) * F.exp(F.lit(alpha) * F.log("tokens")) / F.lit(z),
                        F.col("tokens") * F.lit(float(max_epochs)))
    out = sources.withColumn("quota", F.floor(quota + 0.5).cast("bigint")).filter("quota > 0") \
        .withColumn("epochs", F.ceil(F.col("quota") / F.col("tokens")).cast("int"))
    written = cut_lineage(out.select(
        "source", "tokens", "quota", "epochs", (F.col("quota") - (F.col("epochs") - 1) * F.col("tokens")).alias("last"),
        F.ceil(F.col("rows") / F.lit(BLOCK)).cast("bigint").alias("blocks")))
    drop_table(sources)
    return written


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (source, epoch, blocks, k, id, n_tokens) with ``start``: the tokens of its epoch's
    documents before it."""
    b = F.shiftright(F.shiftright("k", 30) * F.col("blocks"), 30)
    rows = rows.withColumn("block", b).withColumn("group", F.floor(b / BLOCK))
    part = ["source", "epoch"]

    def before(by: list[str], order: str, value: str) -> Column:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(w), F.lit(0))

    blocks = cut_lineage(rows.groupBy(*part, "group", "block").agg(F.sum("n_tokens").alias("t")))
    groups = blocks.groupBy(*part, "group").agg(F.sum("t").alias("t")).withColumn("g", before(part, "group", "t"))
    blocks = blocks.withColumn("b", before([*part, "group"], "block", "t")).drop("t") \
        .join(groups.drop("t"), [*part, "group"])
    blocks = blocks.select(*part, "block", (F.col("g") + F.col("b")).alias("base"))
    here = Window.partitionBy(*part, "block").orderBy("k", "id").rangeBetween(Window.unboundedPreceding, 0)
    peers = Window.partitionBy(*part, "block", "k", "id")
    inner = rows.withColumn("peers", F.sum("n_tokens").over(peers)) \
        .withColumn("inner", F.sum("n_tokens").over(here) - F.col("peers"))
    return inner.join(blocks, [*part, "block"]).withColumn("start", F.col("base") + F.col("inner")) \
        .drop("peers", "inner", "base", "block", "group", "blocks")


def schedule(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS,
             budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, id_col: str = "doc_id",
             source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per showing of a document: id, source, n_tokens, quota, epoch, ``start`` (tokens of its
    source shown before), ``mix_block`` and ``mix_key``."""
    tokens = counted(docs, id_col, source_col, text_col)
    q = quotas(tokens, target_entropy, max_epochs, budget)
    mix_blocks = max(1, -(-(q.agg(F.sum("quota")).first()[0] or 0) // block_tokens))
    shown = tokens.join(q, "source").select("*", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"))
    p = placed(shown.withColumn("k", key(F.col("id"), F.col("epoch"), seed)))
    p = p.filter((F.col("epoch") < F.col("epochs") - 1) | (F.col("start") < F.col("last")))
    start = F.col("epoch") * F.col("tokens") + F.col("start")
    return p.select("id", "source", "n_tokens", "quota", "epoch", start.alias("start"),
                    F.floor(start.cast("double") / F.col("quota") * F.lit(mix_blocks)).cast("bigint").alias("mix_block"),
                    F.col("k").alias("mix_key"))


def mixed(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS,
          budget: int | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source",
          text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the schedule shows it, all columns. Only each source's
    last key is looked up per row; texts are not shuffled."""
    tokens = counted(docs, id_col, source_col, text_col)
    q = quotas(tokens, target_entropy, max_epochs, budget)
    last = tokens.join(q, "source").withColumn("epoch", F.col("epochs") - 1)
    p = placed(last.withColumn("k", key(F.col("id"), F.col("epoch"), seed))).filter("start < last")
    ends = cut_lineage(p.groupBy("source", "epochs").agg(F.max(F.struct("k", "id")).alias("end")))
    rows = rows_of(docs, id=F.col(id_col), src=text_or_empty(source_col))
    k = key(F.col("id"), F.col("epochs") - 1, seed)
    within = (k < F.col("end.k")) | ((k == F.col("end.k")) & (F.col("id").isNull() | (F.col("id") <= F.col("end.id"))))
    times = F.col("epochs") - F.when(F.coalesce(within, F.lit(False)), 0).otherwise(1)
    return rows.join(ends, rows["src"] == ends["source"]).withColumn("times", times).filter("times > 0") \
        .select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def query(spark, sf_dir):
    return schedule(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def sql(documents: str = "documents") -> str:
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) + 1 AS n_tokens
  FROM {documents}),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY 1),
l AS (SELECT ln(tokens / (SELECT sum(tokens) FROM s)::DOUBLE) AS l FROM s),
x AS (SELECT count(*) AS n, max(l) - min(l) AS spread FROM l),
ent AS (
  SELECT 0 AS lo, {GRID} + 1 AS hi
  UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT lo, hi, mid, (SELECT ln(sum(exp(mid / {GRID}::DOUBLE * l))) - sum(exp(mid / {GRID}::DOUBLE * l) * mid
          / {GRID}::DOUBLE * l) / sum(exp(mid / {GRID}::DOUBLE * l)) FROM l) >= {TARGET_ENTROPY} * ln(x.n) - 1e-12 AS ok
        FROM (SELECT lo, hi, (lo + hi) // 2 AS mid FROM ent WHERE hi - lo > 1), x)),
a AS (SELECT greatest(max(lo), (SELECT CASE WHEN spread > 0
             THEN ceil((1 - least(1, (ln({MAX_EPOCHS}) + 1e-12) / spread)) * {GRID}) ELSE 0 END FROM x)) / {GRID}::DOUBLE AS a
      FROM ent),
q AS (SELECT source, tokens, floor(tokens * exp((1 - a) * ln((SELECT max(tokens) FROM s)::DOUBLE / tokens)) + 0.5)::BIGINT AS quota
      FROM s, a),
e AS (SELECT *, ceil(quota / tokens)::INT AS epochs FROM q),
k AS (SELECT doc_id, source, n_tokens, tokens, quota, epochs, epoch,
             ('0x' || substr(md5(concat_ws(':', '{SEED}', epoch::VARCHAR, doc_id::VARCHAR)), 1, 15))::BIGINT AS mix_key
      FROM (SELECT *, unnest(range(0, epochs))::INT AS epoch FROM d JOIN e USING (source))),
p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY mix_key, doc_id NULLS FIRST)
                - sum(n_tokens) OVER (PARTITION BY source, epoch, mix_key, doc_id) AS s0 FROM k)
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, quota, epoch, (epoch * tokens + s0)::BIGINT AS start,
       floor((epoch * tokens + s0)::DOUBLE / quota * greatest(1, ceil((SELECT sum(quota) FROM q) / {BLOCK_TOKENS})))::BIGINT AS mix_block,
       mix_key
FROM p WHERE epoch < epochs - 1 OR s0 < quota - (epochs - 1) * tokens
"""

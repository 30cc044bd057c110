"""Exact de-duplication by skew-safe combining (native).

Two texts are equal when they are identical after every run of white space became one space. A
digest only decides where rows meet; at every stage rows are combined by digest *and* full
normalised text, so that a digest collision never merges different texts:

1. local: the partial aggregate by ``(digest, salt, text)`` collapses the copies that one task
   reads, before any shuffle;
2. salted merge: digests that hold more than a thousandth of all rows (so at most 1,000 of them,
   the bound of the only broadcast) are dealt by reading task over ``salts`` groups; all others
   have the one salt 0, so their class is complete after this one shuffle of text;
3. global: the salt winners of those heavy digests, and only theirs, meet again by
   ``(digest, text)``.

Memberships then go by digest over ids alone. A digest with several texts (a collision; none are
known for SHA-256, tests use a weak digest) is resolved by joining on the text as well.

Defined cases: null text counts as empty; null ids lose against any other id; rows that repeat an
id with an equal text are further copies, of which one stays; an empty table gives no rows; columns
other than the two named ones are ignored by :func:`exact_groups` and kept by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_table
from .common import SPACE, hex_of, rows_of, text_or_empty

#: A digest is heavy from this share of the rows on, so that there are at most as many heavy ones.
HEAVY = 1000
#: ... and only if it has this many rows at least.
HEAVY_ROWS = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def classes(docs: DataFrame, ids: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """``(digest, keep_id, group_size)`` of each set of equal texts with two rows or more, and the
    digests that have more than one text. ``docs``: id, digest, norm; ``ids``: the written id and
    digest."""
    n = ids.count()
    heavy = cut_lineage(ids.groupBy("digest").count()
                        .filter(F.col("count") >= max(HEAVY_ROWS, n / HEAVY)).select("digest"))
    flagged = docs.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), "digest", "left")
    salted = flagged.withColumn("salt", F.when(F.col("heavy"), F.pmod(F.spark_partition_id(), F.lit(salts)))
                                .otherwise(F.lit(0)))
    merged = salted.groupBy("digest", "salt", "heavy", "norm").agg(
        F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = cut_lineage(merged.select("digest", "heavy", "keep_id", "group_size",
                                        F.when(F.col("heavy"), F.col("norm")).alias("norm")))
    whole = winners.filter("heavy IS NULL").select("digest", "keep_id", "group_size")
    combined = winners.filter("heavy").groupBy("digest", "norm").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    found = cut_lineage(whole.unionByName(combined.drop("norm")))
    drop_table(winners)
    drop_table(heavy)
    mixed = cut_lineage(found.groupBy("digest").count().filter("count > 1").select("digest"))
    return found.filter("group_size > 1"), mixed


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32,
                 digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: id, digest, ``keep_id``, ``group_size``, ``kept`` and ``copies`` (rows
    with this id and text)."""
    base = docs.select(F.col(id_col).alias("id"), normalised(text_or_empty(text_col)).alias("norm")) \
        .withColumn("digest", digest(F.col("norm")))
    ids = cut_lineage(base.select("id", "digest"))
    found, mixed = classes(base, ids, salts)
    counted = ids.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("copies"))
    if mixed.isEmpty():
        joined = counted.join(found, "digest", "left")
    else:
        plain = counted.join(mixed, "digest", "left_anti").join(found, "digest", "left")
        odd = base.join(mixed, "digest", "left_semi")
        groups = odd.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"),
                                                   F.count(F.lit(1)).alias("group_size"))
        members = odd.groupBy("digest", "id", "norm").agg(F.count(F.lit(1)).alias("copies"))
        joined = plain.unionByName(members.join(groups, ["digest", "norm"]).select(*plain.columns))
    return joined.select(
        "id", "digest", "copies",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    ).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                salts: int = 32) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    groups = cut_lineage(exact_groups(docs, id_col, text_col, salts).filter("group_size > 1")
                         .select("id", "digest", "kept", "keep_id", "copies"))
    lost = groups.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "digest").distinct()
    again = groups.filter("kept AND copies > 1").select("id", "digest")
    rows = rows_of(docs, id=F.col(id_col), digest=sha256(normalised(text_or_empty(text_col))))

    def same(other: DataFrame) -> Column:
        return rows["id"].eqNullSafe(other["id"]) & (rows["digest"] == other["digest"])

    kept = rows.join(lost, same(lost), "left_anti")
    if not again.isEmpty():
        rows = kept
        once = rows.join(again, same(again), "left_semi").groupBy("id", "digest").agg(
            F.min_by("row", F.to_json("row")).alias("row"))
        kept = rows.join(again, same(again), "left_anti").select("row").unionByName(once.select("row"))
    return kept.select("row.*")


def query(spark, sf_dir):
    from .common import table
    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                        hex_of(F.col("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
           FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
"""

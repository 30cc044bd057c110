"""Running sums over a whole table in an order of its own, with no task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def running_before(df: DataFrame, order: list[str], weight: str, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``weight`` over all rows before each row in ``order`` (which should tell rows
    apart). Two levels: rows are range-partitioned into blocks and written; sums run within each
    block, a task each, and the sums of the blocks (one row a shuffle partition, so the one small table
    that is broadcast and the one window without a partition are bounded) say where each begins."""
    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocked = cut_lineage(df.repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id()))
    all_before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = blocked.groupBy("_block").agg(F.sum(weight).alias("_sum")).select(
        "_block", F.coalesce(F.sum("_sum").over(all_before), F.lit(0)).alias("_begin"))
    here = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(weight).over(here), F.lit(0))
    return blocked.join(F.broadcast(begins), "_block").withColumn(name, (F.col("_begin") + run).cast("bigint")) \
        .drop("_block", "_begin")


def section_offsets(sections: DataFrame) -> DataFrame:
    """``(repo, section, key, start)``: the first character of each section in its repository's document; of
    a chunked manifest also ``part``."""
    order = ["repo", "section", "key", *[c for c in ("part",) if c in sections.columns]]
    placed = cut_lineage(running_before(sections.select(*order, "n_chars"), order, "n_chars", "at"))
    first = cut_lineage(placed.groupBy("repo").agg(F.min("at").alias("first")))
    return placed.join(first, placed["repo"].eqNullSafe(first["repo"])).select(
        placed["repo"], *order[1:], (F.col("at") - F.col("first")).alias("start"))

"""Sinks (S4, S5). Both replace the repositories they are given and leave all others in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(sections: DataFrame, out_dir: str, num_partitions: int | None = None) -> None:
    """One document per repository under ``out_dir/repo=<name>/``, its part files in name
    order forming the document.

    Rows that ``assemble`` made are range-partitioned and sorted already, and are written as they
    are. Rows from anywhere else (stored and read back, filtered, repartitioned) are brought into
    that order here, as their plan shows. Every section ends with a newline and the text writer
    adds one per row, so one is taken off first; the chunks of a chunked manifest must end lines, too."""
    chunked = "part" in sections.columns
    order = ["repo", "section", "key", *["part"] * chunked]
    if not in_document_order(sections):
        n = num_partitions or int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sections = sections.repartitionByRange(n, *order).sortWithinPartitions(*order)
    value = F.expr("substr(text, 1, length(text) - 1)")
    if chunked:
        told = F.concat(F.lit("a chunk ends within a line: "), "repo", F.lit("/"), "key")
        value = F.when(F.col("text").endswith("\n"), value).otherwise(F.raise_error(told).cast("string"))
    _replacing(sections.select("repo", value.alias("value"))).text(out_dir)


def read_lines(spark: SparkSession, out_dir: str) -> DataFrame:
    """The documents of ``write_snapshot`` again, ``(repo, file, block, at, line)``: a row per line, large part files
    read in blocks by several tasks. Within a block (where in its file a task began to read) ``at`` counts
    lines up by one, from any number; file, block and ``at`` order a document's lines."""
    text = spark.read.text(out_dir, lineSep="\n")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in its task
    return text.select("repo", F.col("_metadata.file_name").alias("file"),
                       F.col("_metadata.file_block_start").alias("block"), row.alias("at"), F.col("value").alias("line"))


def in_document_order(sections: DataFrame) -> bool:
    """Does the plan end in the range partitioning and sort of ``assemble``?"""
    return getattr(sections, "_document_order", False)


def write_stats(stats: DataFrame, out_dir: str, documents_dir: str | None = None) -> None:
    """The statistics row of every repository, as Parquet under ``out_dir/repo=<name>/``; with
    ``documents_dir``, each row names its document there as ``output_file``."""
    if documents_dir is not None:
        stats = stats.withColumn("output_file", document_of(documents_dir, F.col("repo")))
    _replacing(stats).parquet(out_dir)


#: Characters that Spark writes as ``%`` and two hexadecimal digits in the names of partition folders.
ESCAPED = "%\"#'*/:=?\\\x7f{[]^" + "".join(map(chr, range(1, 32)))


def document_of(documents_dir: str, repo: Column) -> Column:
    """The folder of a repository's document under ``documents_dir``, as the sink names it."""
    name = repo
    for c in ESCAPED:
        name = F.replace(name, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.concat(F.lit(documents_dir.rstrip("/") + "/repo="), name)


def _replacing(df: DataFrame):
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo")

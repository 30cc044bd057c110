"""Snapshot job (E4): scan, then assemble every repository's document, then the sinks.

Data movement, for a manifest of ``(repo, path, content)`` at any size:

* The scan and every metadata section work on ``(repo, path)`` plus small facts; ``content`` is
  read map side once for classification and character counts.
* Every row of the document (header, tree, report, kept-file decisions) is metadata and gets its
  place from running sums of sizes over all of them in document order, in two levels
  (:func:`.prefix.running_before`): ranges of about equal bytes, as a column, with nothing gathered on the
  driver. Bodies meet their decision by an equi-join on ``(repo, path)`` (one row per file on either
  side, so no hot key; the written decisions are broadcast while they are below Spark's own threshold)
  and go to their range by ``repartitionById``: the output is in document order for the sink, and a giant
  repository spans many ordered tasks. Content is read twice in all, and moved once, or twice where
  the decisions are too many to broadcast.
* Candidate bodies are pre-filtered map side with what needs no metadata (classified binary,
  reserved folder, default rules), so most dropped files never reach the shuffle.
"""

from __future__ import annotations

import datetime as _dt
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.constants import FILE_SECTION_CLOSE, FILE_SECTION_OPEN, FILE_SECTION_TAIL
from ..operators.chunks import piece_text
from ..operators.classify import is_text, name_verdict, with_mime
from ..operators.combine import (SEC_CONTENT, content_decisions, error_section, file_section, header_rows,
                                 ignored_item_rows, report_rows, snapshot_stats, tree_rows)
from ..operators.rules import default_hit
from ..operators.scan import Scan, files_of
from ..operators.tree import tree_lines
from ..options import DEFAULT, Options
from ..session import cut_lineage
from .joins import lookup_side
from .prefix import running_before

#: Kept bytes of one partition of the document.
BODY_PARTITION_BYTES = 128 << 20

DEFAULT_TIMESTAMP = "2025-01-01 00:00:00"


def now_timestamp() -> str:
    return _dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S")


def body_candidates(manifest: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Manifest rows that may become a file section, decided map side; ``part`` is a chunk's place."""
    chunked = "start" in manifest.columns
    m = files_of(manifest).withColumn("part", F.col("start") if chunked else F.lit(0).cast("bigint"))
    m = m.select("repo", "path", "part", "content").withColumn("name", P.name(F.col("path")))
    m = with_mime(m, overrides=options.mime_overrides)
    verdict = name_verdict(F.col("name"), F.col("mime"))
    # A chunk does not tell what its file's first bytes say.
    text = verdict.isNull() | (verdict == "text") if chunked else is_text(verdict, F.col("content"), options.strict_boundary)
    return m.filter(text & ~P.is_reserved(F.col("path")) & ~default_hit(F.col("path"))).select("repo", "path", "part", "content")


def decided_parts(decisions: DataFrame, chunks: DataFrame | None) -> DataFrame:
    """The rows of section 2: ``(repo, key, path, part, n, readable, before, last)``, one a chunk; a whole
    file, or one that cannot be read, is one part."""
    whole = decisions.select("repo", "key", "path", F.lit(0).cast("bigint").alias("part"), F.col("size").alias("n"),
                             "readable", F.lit(bytearray()).alias("before"), F.lit(True).alias("last"))
    if chunks is None:
        return whole
    files = lookup_side(decisions.filter("readable").select("repo", "key", "path", "readable"))
    parts = chunks.select("repo", "path", F.col("start").alias("part"), "n", "before", "last").join(files, ["repo", "path"])
    return parts.select(*whole.columns).unionByName(whole.filter("NOT readable"))


def assemble(meta_rows: DataFrame, parts: DataFrame, manifest: DataFrame,
             num_partitions: int | None = None, options: Options = DEFAULT) -> DataFrame:
    """``(repo, section, key, text, n_chars, counted)`` in document order per partition; of a chunked
    manifest also ``part``, as a file's section then has a row for each chunk."""
    n = num_partitions or int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["repo", "section", "key", "part"]
    info = ["path", "readable", "before", "last"]
    meta = meta_rows.select("repo", "section", "key", F.lit(0).cast("bigint").alias("part"), "text", "counted",
                            *[F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in info],
                            F.length("text").cast("bigint").alias("weight"))
    dec = parts.select("repo", F.lit(SEC_CONTENT).alias("section"), "key", "part", F.lit(None).cast("string").alias("text"),
                       F.lit(True).alias("counted"), *info, (F.col("n") + 1).alias("weight"))
    placed = cut_lineage(running_before(meta.unionByName(dec), order, "weight", "before_all"))
    total = placed.agg(F.sum("weight")).first()[0] or 1
    placed = placed.withColumn("range", (F.col("before_all") * F.lit(n) / F.lit(total)).cast("int"))
    cols = [*order, "text", "counted", *info, "range"]
    bodies = body_candidates(manifest, options)
    kept = placed.filter("readable").join(bodies, ["repo", "path", "part"]).select(*cols, "content")
    rest = placed.filter("readable IS NOT TRUE").select(*cols, F.lit(None).cast("binary").alias("content"))
    u = rest.unionByName(kept).repartitionById(n, F.least("range", F.lit(n - 1))).sortWithinPartitions(*order)
    text = F.when(F.col("readable"), section_part("start" in manifest.columns)).when(
        F.col("section") == SEC_CONTENT, error_section(F.col("path"))).otherwise(F.col("text"))
    out = u.select(*order, text.alias("text"), F.length(text).cast("bigint").alias("n_chars"), "counted")
    if "start" not in manifest.columns:
        out = out.drop("part")
    out._document_order = True  # for the sink; no derived frame has it
    return out


def section_part(chunked: bool) -> Column:
    """The text of a readable row of section 2."""
    if not chunked:
        return file_section(F.col("path"), F.col("content"))
    nothing = F.lit("")
    opening = F.concat(F.lit(FILE_SECTION_OPEN), F.col("path"), F.lit(FILE_SECTION_CLOSE))
    piece = piece_text(F.col("before"), F.col("content"), F.col("last"))
    return F.concat(F.when(F.col("part") == 0, opening).otherwise(nothing), piece,
                    F.when(F.col("last"), F.lit(FILE_SECTION_TAIL)).otherwise(nothing))


class Snapshot:
    """The frames of a snapshot job, each made when first asked for; those with several readers (the
    scan's, and the metadata sections, read by statistics and the document) are tables in the
    shared folder, so asking for them starts the jobs that write them."""

    def __init__(self, manifest: DataFrame, timestamp: str = DEFAULT_TIMESTAMP, *,
                 options: Options = DEFAULT, num_partitions: int | None = None):
        self.manifest, self.timestamp = manifest, timestamp
        self.options, self.num_partitions = options, num_partitions
        self.scan = Scan(manifest, options=options, check_unique=options.require_unique_paths)

    @property
    def dispositions(self) -> DataFrame:
        return self.scan.dispositions

    @cached_property
    def tree_lines(self) -> DataFrame:
        return tree_lines(self.dispositions, max_depth=self.options.max_depth, hide_dunder=self.options.hide_dunder)

    @cached_property
    def small_rows(self) -> DataFrame:
        disp = self.dispositions
        return cut_lineage(tree_rows(self.tree_lines)
                           .unionByName(report_rows(disp, self.scan.rule_files))
                           .unionByName(ignored_item_rows(disp)))

    @cached_property
    def stats(self) -> DataFrame:
        return snapshot_stats(self.dispositions, self.small_rows, self.timestamp)

    @cached_property
    def header(self) -> DataFrame:
        return header_rows(self.dispositions, self.timestamp)

    @cached_property
    def decisions(self) -> DataFrame:
        return content_decisions(self.dispositions)

    def sections(self) -> DataFrame:
        """The document's rows; partitioned and sorted in document order."""
        return assemble(self.header.unionByName(self.small_rows), decided_parts(self.decisions, self.scan.chunks), self.manifest,
                        self.num_partitions or self.body_partitions(), self.options)

    def body_partitions(self) -> int:
        """So many that kept bytes come to about ``BODY_PARTITION_BYTES`` a partition."""
        spark = self.manifest.sparkSession
        kept = self.dispositions.filter(F.col("disposition") == "text").agg(F.sum("size")).first()[0] or 0
        return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept // BODY_PARTITION_BYTES))

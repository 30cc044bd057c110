"""Document sections (E3: X4-X8, O2-O4, U2, U3) and statistics (A1-A5).

A snapshot is one ordered text per repository. Each piece of it is a row
``(repo, section, key, text, counted)``; sorting by ``(repo, section, key)`` gives the document,
and concatenating ``text`` gives its bytes. Sections (O4):

====  =============================================  ======================================
 0    header (time, project, two counts)              key ''
 1    tree: title, lines, closing rule                keys '0', '1' + tree key, '2'
 2    one section per kept text file (O3 order)       key = content key of the path
 3    report title and rule-file pattern blocks       keys '0', '1' + set + ordinal
 4-6  ignored directories, files, binaries (O2)       heading '', item = its path
====  =============================================  ======================================

Only sections 0-1 and 3-6 are built here, from metadata. Section 2 needs the file bytes and is
attached in one pass by :mod:`..plans.snapshot`; its lengths for the statistics come from the
``text_chars`` fact measured on the manifest scan, so statistics never move content.

``counted`` is False for the three list headings: the original did not add them to its character
total (kept as is).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.constants import (ERROR_SECTION_OPEN, FILE_SECTION_CLOSE, FILE_SECTION_OPEN,
                                   FILE_SECTION_TAIL, HEADER_IGNORED, HEADER_PROJECT, HEADER_RULE,
                                   HEADER_TEXT_FILES, HEADER_TITLE, HEADING_BINARY, HEADING_DIRS,
                                   HEADING_FILES, ITEM_CLOSE, ITEM_OPEN, REPORT_TITLE, TREE_INDENT, TREE_RULE, TREE_TITLE,
                                   UNREADABLE_REASON)
from ..functions.text import read_text
from .rules import pattern_report_rows

SEC_HEADER, SEC_TREE, SEC_CONTENT, SEC_REPORT, SEC_DIRS, SEC_FILES, SEC_BINARY = range(7)
IGNORED_KINDS = ("directory", "file", "binary")
_KIND_SECTION = {"directory": SEC_DIRS, "file": SEC_FILES, "binary": SEC_BINARY}
_HEADINGS = {SEC_DIRS: HEADING_DIRS, SEC_FILES: HEADING_FILES, SEC_BINARY: HEADING_BINARY}

SECTION_COLS = ("repo", "section", "key", "text", "counted")


def _rows(df: DataFrame, section, key: Column, text: Column, counted=True) -> DataFrame:
    sec = section if isinstance(section, Column) else F.lit(section)
    cnt = counted if isinstance(counted, Column) else F.lit(counted)
    return df.select("repo", sec.cast("int").alias("section"), key.alias("key"),
                     text.alias("text"), cnt.alias("counted"))


# --- section 2 texts -----------------------------------------------------------------------------

def file_section(path: Column, content: Column) -> Column:
    """The section of one kept text file (an error section when it cannot be read)."""
    return F.when(content.isNull(), error_section(path)).otherwise(
        F.concat(F.lit(FILE_SECTION_OPEN), path, F.lit(FILE_SECTION_CLOSE), read_text(content),
                 F.lit(FILE_SECTION_TAIL)))


def error_section(path: Column) -> Column:
    return F.concat(F.lit(ERROR_SECTION_OPEN), path, F.lit(" ===== */\n/* " + UNREADABLE_REASON
                                                          + " */\n\n"))


def file_section_chars(path: Column, readable: Column, text_chars: Column) -> Column:
    """Length of :func:`file_section` from facts alone (no bytes needed)."""
    fixed = len(FILE_SECTION_OPEN) + len(FILE_SECTION_CLOSE) + len(FILE_SECTION_TAIL)
    return F.when(readable, F.length(path) + F.lit(fixed) + text_chars).otherwise(
        F.length(error_section(path))).cast("bigint")


def content_decisions(disp: DataFrame) -> DataFrame:
    """Kept text files: ``(repo, key, path, size, readable, text_chars)`` with the O3 key."""
    return disp.filter(F.col("disposition") == "text").select(
        "repo", P.content_key(F.col("path")).alias("key"), "path", "size", "readable", "text_chars")


# --- metadata sections ---------------------------------------------------------------------------

def tree_rows(lines: DataFrame) -> DataFrame:
    """The tree framed by rules, every line indented by three spaces."""
    repos = lines.filter(F.col("key") == "").select("repo")
    title = _rows(repos, SEC_TREE, F.lit("0"),
                  F.lit(TREE_TITLE + TREE_INDENT + TREE_RULE + "\n"))
    body = _rows(lines, SEC_TREE, F.concat(F.lit("1"), F.col("key")),
                 F.concat(F.lit(TREE_INDENT), F.col("line"), F.lit("\n")))
    foot = _rows(repos, SEC_TREE, F.lit("2"), F.lit(TREE_INDENT + TREE_RULE + " */\n\n"))
    return title.unionByName(body).unionByName(foot)


def ignored_item_rows(disp: DataFrame) -> DataFrame:
    """X7 + U3 + O2: the three lists of ignored items, each under its heading."""
    items = disp.filter(F.col("disposition").isin(*IGNORED_KINDS))
    sec = F.when(F.col("disposition") == "directory", F.lit(SEC_DIRS)).when(
        F.col("disposition") == "file", F.lit(SEC_FILES)).otherwise(F.lit(SEC_BINARY))
    text = F.concat(F.lit(ITEM_OPEN), F.col("path"),
                    F.when(F.col("disposition") == "directory", F.lit("/")).otherwise(F.lit("")),
                    F.lit(ITEM_CLOSE))
    lines = _rows(items, sec, F.col("path"), text)
    kinds = items.select("repo", sec.alias("section")).distinct()
    heading = F.when(F.col("section") == SEC_DIRS, F.lit(HEADING_DIRS)).when(
        F.col("section") == SEC_FILES, F.lit(HEADING_FILES)).otherwise(F.lit(HEADING_BINARY))
    heads = _rows(kinds, F.col("section"), F.lit(""), heading, counted=False)
    return lines.unionByName(heads)


def report_rows(disp: DataFrame, files: DataFrame) -> DataFrame:
    """Title and pattern blocks, for repositories with at least one ignored item."""
    repos = disp.filter(F.col("disposition").isin(*IGNORED_KINDS)).select("repo").distinct()
    title = _rows(repos, SEC_REPORT, F.lit("0"), F.lit(REPORT_TITLE))
    pats = pattern_report_rows(files).join(repos, "repo", "left_semi")
    key = F.concat(F.lit("1"), F.when(F.col("rule_set") == "gitignore", F.lit("0")).otherwise(
        F.lit("1")), F.lpad(F.col("ordinal").cast("string"), 10, "0"))
    return title.unionByName(_rows(pats, SEC_REPORT, key, F.col("text")))


def header_text(repo: Column, timestamp: str, text_files: Column, ignored: Column) -> Column:
    """X4."""
    return F.concat(
        F.lit("/* " + HEADER_RULE + "\n   " + HEADER_TITLE + timestamp + HEADER_PROJECT), repo,
        F.lit(HEADER_TEXT_FILES), text_files.cast("string"),
        F.lit(HEADER_IGNORED), ignored.cast("string"),
        F.lit("\n   " + HEADER_RULE + " */\n\n"))


# --- statistics ----------------------------------------------------------------------------------

def snapshot_stats(disp: DataFrame, small_rows: DataFrame, timestamp: str) -> DataFrame:
    """A1-A5: ``(repo, text_files, binary_files, ignored_items, total_files, total_chars,
    errors, timestamp)``. One aggregation over a union of per-entry and per-row contributions (no joins).
    The document's place is the sink's to add (:func:`..sinks.write_stats`)."""
    d = F.col("disposition")
    per_entry = disp.select(
        "repo",
        (d == "text").cast("bigint").alias("t"),
        (d == "binary").cast("bigint").alias("b"),
        d.isin(*IGNORED_KINDS).cast("bigint").alias("i"),
        ((d == "text") & ~F.col("readable")).cast("bigint").alias("e"),
        F.when(d == "text", file_section_chars(F.col("path"), F.col("readable"),
                                               F.col("text_chars"))).alias("c"))
    per_row = small_rows.filter(F.col("counted")).select(
        "repo", *[F.lit(0).cast("bigint").alias(x) for x in "tbie"],
        F.length("text").cast("bigint").alias("c"))
    agg = per_entry.unionByName(per_row).groupBy("repo").agg(
        *[F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(x) for x in "tbiec"])
    head = header_text(F.col("repo"), timestamp, F.col("t"), F.col("i"))
    return agg.select(
        "repo", F.col("t").alias("text_files"), F.col("b").alias("binary_files"),
        F.col("i").alias("ignored_items"), F.col("t").alias("total_files"),
        (F.col("c") + F.length(head)).cast("bigint").alias("total_chars"),
        F.col("e").alias("errors"), F.lit(timestamp).alias("timestamp"))


def header_rows(disp: DataFrame, timestamp: str) -> DataFrame:
    """X4 from the dispositions alone: the header shows two counts and needs neither tree nor report."""
    d = F.col("disposition")
    counts = disp.groupBy("repo").agg(F.count_if(d == "text").alias("t"),
                                      F.count_if(d.isin(*IGNORED_KINDS)).alias("i"))
    return _rows(counts, SEC_HEADER, F.lit(""), header_text(F.col("repo"), timestamp, F.col("t"), F.col("i")))

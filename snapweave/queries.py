"""Registered queries: one per operator group of the survey, each over whole shared tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column names match the
DuckDB twin of the same name in :mod:`.twins`.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths as P
from .functions.text import read_text, size_label, sniff_is_text
from .operators import combine as C
from .operators.chunks import chunked_facts, pieces, placed, summaries
from .operators.classify import file_facts
from .functions.globs import java_regex, translate
from .operators.rules import rule_files, rule_lines, rule_summary
from .operators.scan import Scan, directory_entries, entries
from .operators.tree import last_siblings, tree_entries, tree_lines
from .plans.joins import lookup_side
from .plans.prefix import running_before, section_offsets
from .plans.snapshot import DEFAULT_TIMESTAMP, Snapshot
from .session import cut_lineage, scratch_path
from .sinks import read_lines, write_snapshot, write_stats
from .sources.fixtures import messy_table, repo_manifest, site_manifest
from .sources.manifest import manifest_from_table, manifest_rejects

TS = DEFAULT_TIMESTAMP


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def docs_manifest(spark, sf_dir) -> DataFrame:
    return repo_manifest(_table(spark, sf_dir, "documents"))


def pages_manifest(spark, sf_dir) -> DataFrame:
    return site_manifest(_table(spark, sf_dir, "pages"))


# --- paths ---------------------------------------------------------------------------------------

def q_path_parts(spark, sf_dir):
    """N1-N3 on URL paths; N2 relative to the first segment, from the raw (untrimmed) path."""
    pages = _table(spark, sf_dir, "pages")
    raw = F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    m = pages.select(
        F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1).alias("repo"),
        P.norm_path(raw).alias("path"), raw.alias("url_path"))
    n = P.name(F.col("path"))
    top = F.element_at(P.parts(F.col("path")), 1)
    return m.select("repo", "path", n.alias("name"), F.lower(n).alias("lname"),
                    P.suffix(n).alias("suffix"), P.parent(F.col("path")).alias("parent"),
                    P.depth(F.col("path")).cast("int").alias("depth"),
                    P.rel_path(F.concat(F.lit("/"), F.col("url_path")), top).alias("rel_to_top"))


def q_path_ancestors(spark, sf_dir):
    return directory_entries(pages_manifest(spark, sf_dir).select("repo", "path"))


# --- rules ---------------------------------------------------------------------------------------

def q_rule_lines(spark, sf_dir):
    return rule_lines(rule_files(docs_manifest(spark, sf_dir)))


def q_rule_summary(spark, sf_dir):
    """A10: every repository's three rule sets."""
    m = docs_manifest(spark, sf_dir)
    return rule_summary(m, rule_files(m)).select("repo", "rule_set", "found",
                                                 F.array_join("patterns", "\n").alias("patterns"))


#: One pattern for each row of the grammar table in :mod:`.functions.globs`.
GRAMMAR = ("src/", "*.md", "core", "/src", "src/core", "docs/*", "src/**/*.txt", "tests/**", "**/core", "**", "f?1.py",
           "f[12]*", "f[!12]*.js", "!docs", "\\f1*")


def q_rule_match_grammar(spark, sf_dir):
    """Each pattern of the grammar on every path."""
    e = entries(file_facts(docs_manifest(spark, sf_dir), with_chars=False))
    hits = [F.col("path").rlike(java_regex(translate(p)[0])).alias(f"hit_{i:02d}") for i, p in enumerate(GRAMMAR)]
    return e.select("repo", "path", "is_dir", *hits)


def q_rule_match_default(spark, sf_dir):
    from .operators.rules import default_hit
    e = entries(file_facts(docs_manifest(spark, sf_dir), with_chars=False))
    return e.select("repo", "path", "is_dir", default_hit(F.col("path")).alias("default_hit"))


def q_rule_match_last_wins(spark, sf_dir):
    flags = Scan(docs_manifest(spark, sf_dir), with_chars=False).flags
    return flags.select("repo", "path", "is_dir", "gitignore_hit", "track_ignore_hit", "ignored")


def q_reserved_filter(spark, sf_dir):
    e = entries(file_facts(docs_manifest(spark, sf_dir), with_chars=False))
    return e.select("repo", "path", "is_dir", P.is_reserved(F.col("path")).alias("reserved"))


# --- pruning and classification ------------------------------------------------------------------

def q_ignored_directories(spark, sf_dir):
    s = Scan(docs_manifest(spark, sf_dir), with_chars=False)
    items = s.dispositions.filter(F.col("disposition") == "directory").select("repo", "path", "depth")
    files = s.facts.select("repo", P.parent(F.col("path")).alias("parent"))
    blocked = lookup_side(s.blocked.select("repo", F.col("path").alias("parent"), "outer"))
    below = files.join(blocked, ["repo", "parent"], "inner").groupBy(
        "repo", F.col("outer").alias("path")).agg(
        F.count(F.lit(1)).alias("pruned_files"))
    return items.join(below, ["repo", "path"], "left").select(
        "repo", "path", "depth", F.coalesce("pruned_files", F.lit(0)).cast("bigint").alias("pruned_files"))


def q_prune_files(spark, sf_dir):
    s = Scan(docs_manifest(spark, sf_dir), with_chars=False)
    return s.visible.select("repo", "path", "is_dir")


def q_classify_by_name(spark, sf_dir):
    f = file_facts(docs_manifest(spark, sf_dir), with_chars=False)
    return f.select("repo", "path", "mime", "by_name")


def q_classify_by_bytes(spark, sf_dir):
    m = docs_manifest(spark, sf_dir)
    return m.select("repo", "path", sniff_is_text(F.col("content")).alias("sniff_text"))


def q_disposition(spark, sf_dir):
    s = Scan(docs_manifest(spark, sf_dir), with_chars=False)
    return s.dispositions.filter(F.col("disposition").isNotNull()).select(
        "repo", "path", "is_text", "disposition")


# --- tree ----------------------------------------------------------------------------------------

def _site_visible(spark, sf_dir):
    return Scan(pages_manifest(spark, sf_dir), with_chars=False).dispositions


def q_tree_entries(spark, sf_dir):
    return tree_entries(_site_visible(spark, sf_dir))


def q_tree_last_sibling(spark, sf_dir):
    ls = last_siblings(tree_entries(_site_visible(spark, sf_dir)))
    return ls.select("repo", "parent", F.col("last.name").alias("last_name"),
                     (~F.col("last.not_dir")).alias("last_is_dir"),
                     F.col("n_children").cast("bigint").alias("n_children"))


def q_tree_lines(spark, sf_dir):
    return tree_lines(_site_visible(spark, sf_dir))


def q_tree_depth_limit(spark, sf_dir):
    """The tree cut at depth 0, 1, 2 and 3."""
    shown = _site_visible(spark, sf_dir)
    cut = [tree_lines(shown, max_depth=k).withColumn("max_depth", F.lit(k)) for k in range(4)]
    return functools.reduce(DataFrame.unionByName, cut)


def q_tree_ignored_closed(spark, sf_dir):
    return tree_lines(Scan(docs_manifest(spark, sf_dir), with_chars=False).dispositions)


# --- sources and sinks ----------------------------------------------------------------------------

def _messy(spark, sf_dir, **how):
    t = messy_table(_table(spark, sf_dir, "documents"))
    return t, manifest_from_table(t, repo="source", path="full", content="bytes", root="root", **how)


def q_manifest_table(spark, sf_dir):
    """Normalised relative paths, bytes decoded with replacement."""
    _, m = _messy(spark, sf_dir, rejects="apart")
    return m.select("repo", "path", "size", read_text(F.col("content")).alias("text"))


def cut_up(manifest: DataFrame) -> DataFrame:
    """A chunked manifest from whole files: each is cut after every so many bytes, 1 to 997 by its name,
    within characters and line ends as it happens."""
    step = F.pmod(F.xxhash64("repo", "path"), F.lit(997)) + 1
    at = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.octet_length("content") - 1, F.lit(0)).cast("bigint"), step)
    each = manifest.select("repo", "path", "size", "content", step.alias("step"), F.explode(at).alias("start"))
    part = F.substring("content", (F.col("start") + 1).cast("int"), F.col("step").cast("int"))
    return each.select("repo", "path", "start", part.alias("content"), "size")


def q_chunk_text(spark, sf_dir):
    """X1-X3 over chunks: every file cut up, decoded piece by piece, and put together again."""
    _, m = _messy(spark, sf_dir, rejects="apart")
    chunks = cut_up(m)
    found = pieces(chunks, cut_lineage(placed(cut_lineage(summaries(chunks)))))
    return found.groupBy("repo", "path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"),
        F.sum("n_chars").alias("n_chars"))


def q_chunk_facts(spark, sf_dir):
    """P11, P12 and A5 over chunks."""
    chunks = cut_up(docs_manifest(spark, sf_dir))
    return chunked_facts(cut_lineage(placed(cut_lineage(summaries(chunks))))).select(
        "repo", "path", "size", "readable", "by_name", "sniff_text", "is_text", "text_chars")


def q_manifest_rejects(spark, sf_dir):
    t, _ = _messy(spark, sf_dir, rejects="apart")
    return manifest_rejects(t, repo="source", path="full", root="root")


def q_manifest_clashes(spark, sf_dir):
    """Paths that are a file and a folder are both."""
    _, m = _messy(spark, sf_dir, rejects="apart")
    return Scan(m, with_chars=False).dispositions.select("repo", "path", "is_dir", "disposition")


def q_stats_sink(spark, sf_dir):
    """S5, written and read back."""
    out = scratch_path(spark)
    write_stats(_snapshot(spark, sf_dir).stats, out, "documents")
    return spark.read.parquet(out)


def q_snapshot_sink(spark, sf_dir):
    """S4, written and read back: lines and characters of each document, and a sum that any change of the
    lines' order would change (line numbers over all part files: places within a block of a file, and
    running sums of the blocks' lines)."""
    out = scratch_path(spark)
    write_snapshot(_snapshot(spark, sf_dir).sections(), out)
    return line_sums(read_lines(spark, out))


def line_sums(lines: DataFrame) -> DataFrame:
    """Of each document ``n_lines``, ``n_chars`` and ``order_sum``, the sum over lines of their number in the
    document times their ``look``. Lines meet only in partial sums by block."""
    look = F.length("line") + F.ascii("line") + 1
    blocks = lines.groupBy("repo", "file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("line") + 1).alias("chars"), F.min("at").alias("first"),
        F.sum(look).alias("look"), F.sum(F.col("at") * look).alias("at_look"))
    numbered = running_before(blocks, ["repo", "file", "block"], "n", "number")
    starts = numbered.groupBy("repo").agg(F.min("number").alias("start"))
    before = F.col("number") - F.col("start") - F.col("first") + 1
    return numbered.join(starts, "repo").groupBy("repo").agg(
        F.sum("n").alias("n_lines"), F.sum("chars").alias("n_chars"),
        F.sum(F.col("at_look") + before * F.col("look")).alias("order_sum"))


def q_section_offsets(spark, sf_dir):
    """Where each section starts in its document."""
    return section_offsets(_snapshot(spark, sf_dir).sections())


# --- content and document ------------------------------------------------------------------------

def q_content_text(spark, sf_dir):
    m = docs_manifest(spark, sf_dir)
    t = read_text(F.col("content"))
    return m.select("repo", "path", t.alias("text"), F.length(t).cast("bigint").alias("n_chars"))


def _snapshot(spark, sf_dir) -> Snapshot:
    return Snapshot(docs_manifest(spark, sf_dir), TS)


def q_file_sections(spark, sf_dir):
    sec = _snapshot(spark, sf_dir).sections()
    return sec.filter(F.col("section") == C.SEC_CONTENT).select("repo", "key", "text", "n_chars")


def q_ignored_report(spark, sf_dir):
    s = Scan(docs_manifest(spark, sf_dir), with_chars=False)
    return C.ignored_item_rows(s.dispositions)


def q_pattern_report(spark, sf_dir):
    s = Scan(docs_manifest(spark, sf_dir), with_chars=False)
    return C.report_rows(s.dispositions, s.rule_files).select("repo", "key", "text")


def q_header_section(spark, sf_dir):
    disp = Scan(docs_manifest(spark, sf_dir), with_chars=False).dispositions
    return C.header_rows(disp, TS).select("repo", "text")


def q_snapshot_sections(spark, sf_dir):
    return _snapshot(spark, sf_dir).sections()


def q_snapshot_stats(spark, sf_dir):
    return _snapshot(spark, sf_dir).stats


def q_file_size_label(spark, sf_dir):
    m = docs_manifest(spark, sf_dir).unionByName(pages_manifest(spark, sf_dir))
    return m.select("repo", "path", "size", size_label(F.col("size")).alias("label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "path_parts": q_path_parts,
    "path_ancestors": q_path_ancestors,
    "rule_lines": q_rule_lines,
    "rule_summary": q_rule_summary,
    "rule_match_grammar": q_rule_match_grammar,
    "manifest_table": q_manifest_table,
    "manifest_rejects": q_manifest_rejects,
    "chunk_text": q_chunk_text,
    "chunk_facts": q_chunk_facts,
    "manifest_clashes": q_manifest_clashes,
    "stats_sink": q_stats_sink,
    "snapshot_sink": q_snapshot_sink,
    "section_offsets": q_section_offsets,
    "rule_match_default": q_rule_match_default,
    "rule_match_last_wins": q_rule_match_last_wins,
    "reserved_filter": q_reserved_filter,
    "ignored_directories": q_ignored_directories,
    "prune_files": q_prune_files,
    "classify_by_name": q_classify_by_name,
    "classify_by_bytes": q_classify_by_bytes,
    "disposition": q_disposition,
    "tree_entries": q_tree_entries,
    "tree_last_sibling": q_tree_last_sibling,
    "tree_lines": q_tree_lines,
    "tree_depth_limit": q_tree_depth_limit,
    "tree_ignored_closed": q_tree_ignored_closed,
    "content_text": q_content_text,
    "file_sections": q_file_sections,
    "ignored_report": q_ignored_report,
    "pattern_report": q_pattern_report,
    "header_section": q_header_section,
    "snapshot_sections": q_snapshot_sections,
    "snapshot_stats": q_snapshot_stats,
    "file_size_label": q_file_size_label,
}

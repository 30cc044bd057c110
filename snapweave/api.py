
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import paths as P
from .operators.classify import file_facts
from .operators.rules import rule_files, rule_lines, rule_summary
from .operators.scan import Scan, blocked_dirs, visible
from .operators.tree import tree_lines
from .options import DEFAULT, Options
from .plans.snapshot import DEFAULT_TIMESTAMP, Snapshot
from .sinks import write_snapshot, write_stats
from .sources.manifest import manifest_from_table, manifest_rejects
from .sources.tree_source import manifest_from_tree

__all__ = [
    "manifest_from_table", "manifest_from_tree", "manifest_rejects", "path_parts", "ancestors", "parse_rules", "rules_found",
    "is_ignored", "prune", "is_text", "disposition", "scan", "tree", "combine", "snapshot",
    "stats", "write_snapshot", "write_stats", "Options",
]


def path_parts(df: DataFrame, col: str = "path") -> DataFrame:
    """Normalised path with name, lower name, suffix, parent and depth."""
    p = P.norm_path(F.col(col))
    n = P.name(p)
    return df.withColumn(col, p).select(
        "*", n.alias("name"), F.lower(n).alias("lname"), P.suffix(n).alias("suffix"),
        P.parent(p).alias("parent"), P.depth(p).cast("int").alias("depth"))


def ancestors(df: DataFrame, col: str = "path") -> DataFrame:
    """One row per (row, proper ancestor directory), outermost first."""
    return df.select("*", F.posexplode(P.ancestors(F.col(col))).alias("level", "ancestor"))


def parse_rules(manifest: DataFrame) -> DataFrame:
    """S3 + X12 + P2: rule lines of every repository's two rule files, with their regexes."""
    return rule_lines(rule_files(manifest))


def rules_found(manifest: DataFrame) -> DataFrame:
    """A10: the three rule sets of every repository, whether each was found, and its patterns."""
    return rule_summary(manifest, rule_files(manifest))


def is_ignored(manifest: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """P1-P5 on every entry (files and the folders they imply), before pruning."""
    return Scan(manifest, with_chars=False, options=options).flags


def prune(flagged: DataFrame) -> DataFrame:
    """P6 + J1 + J2: the entries still visible after pruning ignored folders."""
    return visible(flagged, blocked_dirs(flagged))


def is_text(manifest: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """P7-P12 per file: name verdict, MIME type, sniff and the final text/binary decision."""
    return file_facts(manifest, with_chars=False, options=options)


def scan(manifest: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Visible entries with ``disposition`` (text, binary, file, directory, NULL)."""
    return Scan(manifest, options=options).dispositions


disposition = scan


def tree(dispositions: DataFrame, max_depth: int | None = None,
         options: Options = DEFAULT) -> DataFrame:
    """``(repo, key, line)``; sort by ``(repo, key)`` to draw."""
    return tree_lines(dispositions, max_depth=max_depth, hide_dunder=options.hide_dunder)


def snapshot(manifest: DataFrame, timestamp: str = DEFAULT_TIMESTAMP,
             options: Options = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``(sections, stats)``."""
    snap = Snapshot(manifest, timestamp, options=options)
    return snap.sections(), snap.stats


def combine(manifest: DataFrame, timestamp: str = DEFAULT_TIMESTAMP,
            options: Options = DEFAULT) -> DataFrame:
    """The ordered sections of every repository's document."""
    return snapshot(manifest, timestamp, options)[0]


def stats(manifest: DataFrame, timestamp: str = DEFAULT_TIMESTAMP,
          options: Options = DEFAULT) -> DataFrame:
    """A1-A5: one statistics row per repository."""
    return Snapshot(manifest, timestamp, options=options).stats

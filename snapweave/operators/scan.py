"""Scan (E1): manifest -> entries -> rule flags -> pruning -> dispositions.

Everything here runs on metadata (``repo, path`` and a few small facts); ``content`` is read once,
map side, by :func:`..operators.classify.file_facts`.

* **Entries** (U1, A6, A7): files plus every directory their paths imply, one row per
  ``(repo, path, is_dir)``: a path that is a file and also the folder of other paths is both, and
  keeps its section as well as its place in the tree. Directories come from exploding ancestors; the partial aggregate collapses the
  many copies map side before the shuffle.
* **Pruning** (P6, J1, J2, A8): a directory is *blocked* when it or an ancestor is ignored; an entry
  is visible when its parent is not blocked. The ancestor test is an equi-join on
  ``(repo, ancestor)`` over directories only (not files), and the visibility test is one anti-join on
  ``(repo, parent)``: no prefix theta join, no nested loop.
* **Disposition** (P13): ``directory`` (an ignored directory shown as an item), ``file`` (ignored
  by a rule), ``text`` or ``binary``; NULL for a directory that is not ignored.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..options import DEFAULT, Options
from ..plans.joins import lookup_side
from ..session import cut_lineage
from .chunks import chunked_facts, placed, summaries
from .classify import file_facts
from .rules import apply_rules, rule_files

FACT_COLS = ("size", "readable", "mime", "by_name", "sniff_text", "is_text", "text_chars")


def with_path_parts(df: DataFrame) -> DataFrame:
    p = F.col("path")
    return df.select("*", P.name(p).alias("name"), P.parent(p).alias("parent"),
                     P.depth(p).cast("int").alias("depth"))


def files_of(manifest: DataFrame) -> DataFrame:
    """The manifest's files. A manifest may also list folders (``is_dir``), as a directory tree does for
    empty and linked ones."""
    return manifest.filter(~F.col("is_dir")) if "is_dir" in manifest.columns else manifest


def folders_of(manifest: DataFrame) -> DataFrame | None:
    return manifest.filter("is_dir").select("repo", "path") if "is_dir" in manifest.columns else None


def entries(facts: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """U1 + A6: ``(repo, path, is_dir, n_files, name, parent, depth, <file facts>)``. ``folders``: listed
    ones, beside those that file paths imply."""
    cols = [c for c in FACT_COLS if c in facts.columns]
    files = facts.select("repo", "path", F.lit(False).alias("is_dir"), *cols)
    implied = facts.select("repo", F.explode(P.ancestors(F.col("path"))).alias("path"))
    if folders is not None:
        implied = implied.unionByName(folders)
    dirs = implied.select(
        "repo", "path", F.lit(True).alias("is_dir"),
        *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in cols])
    agg = (files.unionByName(dirs).groupBy("repo", "path", "is_dir")
           .agg(F.count_if(~F.col("is_dir")).cast("int").alias("n_files"),
                *[F.max(c).alias(c) for c in cols]))
    return with_path_parts(agg)


def directory_entries(paths: DataFrame) -> DataFrame:
    """Distinct ``(repo, path, depth)`` of the directories implied by file paths."""
    d = paths.select("repo", F.explode(P.ancestors(F.col("path"))).alias("path")).distinct()
    return d.withColumn("depth", P.depth(F.col("path")).cast("int"))


def blocked_dirs(flagged: DataFrame) -> DataFrame:
    """J1 + A8: ``(repo, path, outer)`` for every directory that is ignored or lies below an
    ignored directory; ``outer`` is its outermost ignored ancestor-or-self."""
    ign = flagged.filter(F.col("is_dir") & F.col("ignored")).select(
        "repo", F.col("path").alias("anc"))
    dirs = flagged.filter(F.col("is_dir")).select(
        "repo", "path",
        F.explode(F.concat(P.ancestors(F.col("path")), F.array(F.col("path")))).alias("anc"))
    hits = dirs.join(ign, ["repo", "anc"], "inner")
    return hits.groupBy("repo", "path").agg(
        F.min_by("anc", F.size(F.split(F.col("anc"), "/"))).alias("outer"))


def visible(flagged: DataFrame, blocked: DataFrame) -> DataFrame:
    """J2 + P6: entries whose parent folder is not blocked (the root is never blocked)."""
    b = lookup_side(blocked.select("repo", F.col("path").alias("parent")))
    return flagged.join(b, ["repo", "parent"], "left_anti")


def disposition_col() -> F.Column:
    return (F.when(F.col("is_dir"), F.when(F.col("ignored"), F.lit("directory")))
            .when(F.col("ignored"), F.lit("file"))
            .when(F.col("is_text"), F.lit("text"))
            .otherwise(F.lit("binary")))


def check_unique_paths(df: DataFrame) -> None:
    """T-14: raise when a repository lists the same file path twice (``n_files`` from
    :func:`entries`)."""
    dup = df.filter(F.col("n_files") > 1).select("repo", "path").take(1)
    if dup:
        raise ValueError(f"path listed twice in repository {dup[0]['repo']!r}: {dup[0]['path']!r}")


class Scan:
    """The frames of one scan, each made when first asked for.

    Frames with several readers are tables in the shared folder, written once: the facts (entries,
    rule files), the parsed rule files (plans, pattern report), the rule flags (blocked directories,
    visibility) and the dispositions (tree, report, decisions, statistics). So the rule UDF and the
    shuffles before it run once, the plans of the readers stay small, and a lost executor costs a
    re-read rather than a recomputation."""

    def __init__(self, manifest: DataFrame, *, with_chars: bool = True, options: Options = DEFAULT,
                 check_unique: bool = False):
        self.manifest, self.with_chars = manifest, with_chars
        self.options, self.check_unique = options, check_unique

    @cached_property
    def chunks(self) -> DataFrame | None:
        """Of a chunked manifest the summary of each chunk with its place, written; see :mod:`.chunks`."""
        if "start" not in self.manifest.columns:
            return None
        return cut_lineage(placed(cut_lineage(summaries(files_of(self.manifest), self.options))))

    @cached_property
    def facts(self) -> DataFrame:
        if self.chunks is not None:
            return cut_lineage(chunked_facts(self.chunks, self.options))
        return cut_lineage(file_facts(files_of(self.manifest), with_chars=self.with_chars, options=self.options))

    @cached_property
    def rule_files(self) -> DataFrame:
        return cut_lineage(rule_files(self.facts, content="rule_bytes"))

    @cached_property
    def entries(self) -> DataFrame:
        return entries(self.facts, folders_of(self.manifest))

    @cached_property
    def flagged(self) -> DataFrame:
        return cut_lineage(self.flags)

    @cached_property
    def flags(self) -> DataFrame:
        """The rule flags of every entry, not written: for a single reader."""
        return apply_rules(self.entries, self.rule_files, prune_folders=self.options.prune_folders,
                           broadcast_bytes=self.options.broadcast_bytes)

    @cached_property
    def blocked(self) -> DataFrame:
        return blocked_dirs(self.flagged)

    @cached_property
    def visible(self) -> DataFrame:
        return visible(self.flagged, self.blocked)

    @cached_property
    def dispositions(self) -> DataFrame:
        disp = cut_lineage(self.visible.withColumn("disposition", disposition_col()))
        if self.check_unique:
            check_unique_paths(disp)
        return disp


def scan(manifest: DataFrame) -> DataFrame:
    """Visible entries with their disposition."""
    return Scan(manifest).dispositions

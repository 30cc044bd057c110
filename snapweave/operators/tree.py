"""Directory tree (E2: P14, P15, A9, J5, O1, X9-X11).

The recursive renderer of the original becomes flat set operations; no recursion, no window:

1. ``tree_entries``: visible entries minus hidden ones (a path starting with ``.codebase``, or with
   any segment starting with ``__``, and everything below such a segment).
2. ``last_siblings`` (A9): per folder, ``max(struct(not_dir, lower(name), name))`` is the child drawn
   with the closing symbol. A partial aggregate, so a giant folder never lands on one task whole.
3. ``child_prefixes`` (J5, X9): per directory, the prefix its children's lines start with: one
   4-character piece per ancestor-or-self, blank when that ancestor is a last sibling. Built on
   directories only, in as many joins as the logarithm of the greatest depth; a round's rows are as many
   as the directories, however deep they are, and the side with one row a directory is a written table.
4. ``tree_lines``: one equi-join of entries with their folder's ``(last child, child prefix)``;
   the line order is the string key of :func:`..functions.paths.tree_key` (O1).
Ignored directories have no children left after pruning, so they show without expansion (X11).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.constants import (RESERVED_DIR, TREE_BRANCH, TREE_LAST, TREE_ROOT, TREE_SPACE,
                                   TREE_TEE)
from ..plans.joins import lookup_side
from ..session import cut_lineage, drop_table


def tree_entries(visible: DataFrame, hide_dunder: bool = True) -> DataFrame:
    """``(repo, path, name, parent, depth, is_dir)`` shown in the tree."""
    keep = ~F.col("path").startswith(RESERVED_DIR)
    if hide_dunder:
        keep = keep & ~F.exists(P.parts(F.col("path")), lambda s: s.startswith("__"))
    return visible.filter(keep).select("repo", "path", "name", "parent", "depth", "is_dir")


def _order_struct():
    return F.struct((~F.col("is_dir")).alias("not_dir"), F.lower(F.col("name")).alias("lname"),
                    F.col("name").alias("name"))


def last_siblings(te: DataFrame) -> DataFrame:
    """``(repo, parent, last, n_children)`` per folder ('' is the root)."""
    return te.groupBy("repo", "parent").agg(F.max(_order_struct()).alias("last"),
                                            F.count(F.lit(1)).alias("n_children"))


def child_prefixes(te: DataFrame, last: DataFrame) -> DataFrame:
    """J5 + X9: ``(repo, path, child_prefix)`` for every directory of the tree, by pointer doubling: each
    directory holds the pieces from below some ancestor (at first its parent) down to itself; a round puts
    before them what that ancestor holds. ``last``: the written result of :func:`last_siblings`."""
    piece = F.when(_order_struct() == F.col("last"), F.lit(TREE_SPACE)).otherwise(F.lit(TREE_BRANCH))
    held = cut_lineage(te.filter(F.col("is_dir")).join(last.select("repo", "parent", "last"), ["repo", "parent"]).select(
        "repo", "path", F.col("parent").alias("up"), piece.alias("child_prefix")))
    while not held.filter("up <> ''").isEmpty():
        above = held.select("repo", F.col("path").alias("up"), F.col("up").alias("next"), F.col("child_prefix").alias("front"))
        before, held = held, cut_lineage(held.join(above, ["repo", "up"], "left").select(
            "repo", "path", F.coalesce("next", F.lit("")).alias("up"),
            F.concat(F.coalesce("front", F.lit("")), F.col("child_prefix")).alias("child_prefix")))
        drop_table(before)
    return held.select("repo", "path", "child_prefix")


def tree_lines(visible: DataFrame, max_depth: int | None = None, hide_dunder: bool = True) -> DataFrame:
    """``(repo, key, line)``, one row per line including the root line ``.`` (key '').
    Sorting by ``(repo, key)`` gives the drawing order. ``max_depth=k`` keeps depths 0..k (P15).
    The per-folder side of the join with entries is a table, so AQE can split a hot folder."""
    te = tree_entries(visible, hide_dunder)
    last = lookup_side(last_siblings(te))
    prefixes = child_prefixes(te, last)
    folders = lookup_side(last.join(prefixes.withColumnRenamed("path", "parent"), ["repo", "parent"], "left"))
    shown = te if max_depth is None else te.filter(F.col("depth") <= max_depth)
    j = shown.join(folders, ["repo", "parent"], "inner")
    symbol = F.when(_order_struct() == F.col("last"), F.lit(TREE_LAST)).otherwise(F.lit(TREE_TEE))
    line = F.concat(F.coalesce(F.col("child_prefix"), F.lit("")), symbol, F.col("name"),
                    F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit("")))
    body = j.select("repo", P.tree_key(F.col("path"), F.col("is_dir")).alias("key"),
                    line.alias("line"))
    roots = visible.select("repo").distinct().select(
        "repo", F.lit("").alias("key"), F.lit(TREE_ROOT).alias("line"))
    return roots.unionByName(body)

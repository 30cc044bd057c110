"""Manifest sources (S1, S3): the table of files every operator reads.

``manifest(repo STRING, path STRING, content BINARY, size BIGINT)``: one row per file; ``path`` is
relative to the repository root, ``/``-separated, without leading or trailing slash; ``content``
NULL means the file could not be read. An optional ``is_dir BOOLEAN`` marks rows that are folders. At scale a corpus already sits in Parquet and
:func:`manifest_from_table` only renames and normalises columns: projections and filters on
``repo``/``path`` still reach the scan, and ``content`` is read only by the steps that need it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import norm_path, rel_path

MANIFEST_COLUMNS = ("repo", "path", "content", "size")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _named(df: DataFrame, repo, path, content, size, root) -> DataFrame:
    p = norm_path(_col(path)) if root is None else rel_path(_col(path), _col(root))
    c = _col(content).cast("binary")
    sz = F.octet_length(c) if size is None else _col(size)
    return df.select(_col(repo).cast("string").alias("repo"), p.alias("path"), c.alias("content"),
                     F.coalesce(sz.cast("bigint"), F.lit(0).cast("bigint")).alias("size"),
                     _col(path).cast("string").alias("given"))


def _reason() -> Column:
    """Why a row names no file; NULL for a usable row."""
    return (F.when(F.col("repo").isNull(), F.lit("no repository"))
            .when(F.col("given").isNull(), F.lit("no path"))
            .when(F.col("path").isNull(), F.lit("path outside its root"))
            .when(F.col("path") == "", F.lit("empty path")))


def manifest_from_table(df: DataFrame, repo="repo", path="path", content="content",
                        size=None, root=None, rejects: str = "fail") -> DataFrame:
    """S1 (+ N1, N2): a manifest from any table with a repository, a path and the bytes.

    ``root``: when paths are absolute, the column (or literal) of each repository's root; the
    path is then made relative to it. A row without a usable path (NULL, empty, outside its root)
    fails the job that reads it; with ``rejects="apart"`` such rows are left out here and are the
    rows of :func:`manifest_rejects`."""
    if rejects not in ("fail", "apart"):
        raise ValueError("rejects must be 'fail' or 'apart'")
    out = _named(df, repo, path, content, size, root)
    if rejects == "apart":
        return out.filter(_reason().isNull()).select(*MANIFEST_COLUMNS)
    told = F.concat(F.lit("manifest row rejected: "), _reason(), F.lit(": "), F.coalesce("given", F.lit("NULL")))
    # In the path itself, so that no reader can skip the check.
    checked = F.when(_reason().isNull(), F.col("path")).otherwise(F.raise_error(told).cast("string"))
    return out.select("repo", checked.alias("path"), "content", "size")


def manifest_rejects(df: DataFrame, repo="repo", path="path", root=None) -> DataFrame:
    """``(repo, path, reason)`` of the rows that ``manifest_from_table(rejects="apart")`` leaves out,
    ``path`` as given."""
    out = _named(df, repo, path, F.lit(None), F.lit(0), root)
    return out.select("repo", F.col("given").alias("path"), _reason().alias("reason")).filter("reason IS NOT NULL")


def read_manifest(spark, path: str) -> DataFrame:
    """A manifest stored as Parquet (e.g. written by an earlier job)."""
    df = spark.read.parquet(path)
    return df.select(*MANIFEST_COLUMNS, *[c for c in ("is_dir",) if c in df.columns])

"""MIME type by file name (P10).

The lookup table is pinned in :mod:`.constants`, so neither the host's MIME files nor the Python
version change a result. It has a fixed size, so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import (BINARY_MIME_PREFIXES, MIME_ALIASES, MIME_ENCODINGS, MIME_TYPES,
                        READABLE_MIME_PREFIXES)

# ``os.path.splitext`` on a base name: leading dots are not an extension.
_SPLITEXT = r"(?s)^\.*[^.].*(\.[^.]*)$"


def mime_rows() -> list[tuple[str, str]]:
    """``(extension with dot, lower case; MIME type)``."""
    return list(MIME_TYPES)


def encodings() -> list[str]:
    return list(MIME_ENCODINGS)


def suffix_aliases() -> dict[str, str]:
    return dict(MIME_ALIASES)


def splitext_ext(c: Column) -> Column:
    return F.regexp_extract(c, _SPLITEXT, 1)


def type_extension(name: Column) -> Column:
    """The extension used for the type lookup: aliases resolved, one compression ending
    skipped, lower-cased."""
    e1 = splitext_ext(name)
    base = name.substr(F.lit(1), F.length(name) - F.length(e1))
    aliases = suffix_aliases()
    alias_map = F.create_map(*[x for kv in aliases.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.lower(
        F.when(F.lower(e1).isin(list(aliases)), F.element_at(alias_map, F.lower(e1)))
        .when(e1.isin(encodings()), splitext_ext(base))
        .otherwise(e1))


def mime_dim(spark: SparkSession, overrides=()) -> DataFrame:
    """J4's dimension: one row per known extension (about 150 rows, fixed; ``overrides`` add or
    replace entries). Built once per session and override set."""
    key = tuple(sorted((e.lower(), m) for e, m in overrides))
    cache = getattr(spark, "_snapweave_mime_dims", None)
    if cache is None:
        cache = spark._snapweave_mime_dims = {}
    if key not in cache:
        rows = dict(mime_rows())
        rows.update(dict(key))
        cache[key] = spark.createDataFrame(sorted(rows.items()), "mime_ext string, mime string")
    return cache[key]


def readable_mime(m: Column) -> Column:
    cond = F.lit(False)
    for p in READABLE_MIME_PREFIXES:
        cond = cond | m.startswith(p)
    return cond


def binary_mime(m: Column) -> Column:
    cond = F.lit(False)
    for p in BINARY_MIME_PREFIXES:
        cond = cond | m.startswith(p)
    return cond

"""Text or binary (P7-P12), decided per file on the manifest scan itself (map side, no shuffle).

Order of tests, first answer wins: known text name (lower-cased) -> ``.env``/``.lock`` ending
(case-sensitive) -> denied extension -> MIME type by name -> byte sniff. Only rows left undecided by
the name look at ``content`` (``CASE`` evaluates lazily), and then only at its first 4096 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.constants import (DENIED_EXTENSIONS, GITIGNORE_PATH, KNOWN_TEXT_NAMES,
                                   TEXT_NAME_ENDINGS, TRACK_IGNORE_PATH)
from ..functions.mime import binary_mime, mime_dim, readable_mime, type_extension
from ..functions.text import sniff_is_text, text_length
from ..options import DEFAULT, Options
from .rules import default_hit


def with_mime(df: DataFrame, name_col: str = "name", overrides=()) -> DataFrame:
    """Left join to the built-in MIME table (fixed size, so broadcast is safe)."""
    dim = F.broadcast(mime_dim(df.sparkSession, overrides))
    x = df.withColumn("_type_ext", type_extension(F.col(name_col)))
    return x.join(dim, x["_type_ext"] == dim["mime_ext"], "left").drop("_type_ext", "mime_ext")


def name_verdict(name: Column, mime: Column) -> Column:
    """``'text'``, ``'binary'`` or NULL (undecided: needs the bytes)."""
    ends = F.lit(False)
    for e in TEXT_NAME_ENDINGS:
        ends = ends | name.endswith(e)
    ext = F.lower(F.substr(P.suffix(name), F.lit(2)))
    return (F.when(F.lower(name).isin(list(KNOWN_TEXT_NAMES)), F.lit("text"))
            .when(ends, F.lit("text"))
            .when(ext.isin(list(DENIED_EXTENSIONS)), F.lit("binary"))
            .when(readable_mime(mime), F.lit("text"))
            .when(binary_mime(mime), F.lit("binary")))


def is_text(by_name: Column, content: Column, strict_boundary: bool = True) -> Column:
    """The name's verdict, else the byte sniff."""
    return F.when(by_name.isNotNull(), by_name == "text").otherwise(
        sniff_is_text(content, strict_boundary))


def file_facts(manifest: DataFrame, with_chars: bool = True, options: Options = DEFAULT
               ) -> DataFrame:
    """Per file: ``repo, path, size, readable, mime, by_name, sniff_text, is_text``, the bytes of the
    two rule files as ``rule_bytes`` (NULL for all others) and, for text files that neither the
    reserved folder nor a default rule drops, ``text_chars`` (code points after decoding and newline
    translation). The one pass over ``content`` besides the bodies themselves."""
    m = manifest.select("repo", "path", "size", "content").withColumn("name", P.name(F.col("path")))
    m = with_mime(m, overrides=options.mime_overrides)
    by_name = name_verdict(F.col("name"), F.col("mime"))
    strict = options.strict_boundary
    m = m.select("repo", "path", "size", F.col("content").isNotNull().alias("readable"), "mime",
                 by_name.alias("by_name"),
                 F.when(by_name.isNull(), sniff_is_text(F.col("content"), strict)).alias("sniff_text"),
                 is_text(by_name, F.col("content"), strict).alias("is_text"),
                 F.when(F.col("path").isin(GITIGNORE_PATH, TRACK_IGNORE_PATH), F.col("content")).alias("rule_bytes"),
                 "content")
    if with_chars:
        counts = F.col("is_text") & F.col("readable") & ~P.is_reserved(F.col("path")) & ~default_hit(F.col("path"))
        m = m.withColumn("text_chars", F.when(counts, text_length(F.col("content"))))
    return m.drop("content")

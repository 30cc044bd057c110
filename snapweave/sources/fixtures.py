"""Adapter views that turn the shared test tables into file manifests.

``repo_manifest(documents)``: one file per document, spread over folders and extensions chosen
from ``doc_id`` so that every rule and classification branch is exercised, plus per-repository
rule files. ``site_manifest(pages)``: one file per web page, repository = host, path = URL path.
The DuckDB twins (``snapweave.twins``) derive the same rows with the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import GITIGNORE_PATH, TRACK_IGNORE_PATH
from ..functions.paths import norm_path

# Fixed values of the fixture (FIXTURES.md section 2 and 3).
FOLDERS = ("", "src", "src/core", "docs/{lang}", "node_modules/pkg", "build", "tests/__data__")
EXTENSIONS = (".py", ".js", ".md", ".txt", ".png", ".log", "", ".json", ".lock", ".zip", ".zzz")
GITIGNORE_TEXT = "# sample rules\n*.txt\n\n!docs/**/*.txt\n   docs/de\n"
TRACK_IGNORE_TEXT = "# custom rules\n\n/build\n  tests/*  \n"
GITIGNORE_REPOS = (0, 9)     # src0 .. src9
TRACK_IGNORE_REPOS = (5, 14)  # src5 .. src14


def _folder(doc_id, lang):
    m = F.pmod(doc_id, F.lit(7))
    expr = F.when(m == 0, F.lit(""))
    for i, f in enumerate(FOLDERS[1:], start=1):
        val = F.concat(F.lit("docs/"), lang) if "{lang}" in f else F.lit(f)
        expr = expr.when(m == i, F.concat(val, F.lit("/")))
    return expr


def _name(doc_id):
    m = F.pmod(doc_id, F.lit(11))
    ext = F.when(m == 0, F.lit(EXTENSIONS[0]))
    for i, e in enumerate(EXTENSIONS[1:], start=1):
        ext = ext.when(m == i, F.lit(e))
    sid = doc_id.cast("string")
    return (F.when(F.pmod(doc_id, F.lit(13)) == 0, F.concat(F.lit("m"), sid, F.lit("/Makefile")))
            .otherwise(F.concat(F.lit("f"), sid, ext)))


def repo_files(documents: DataFrame) -> DataFrame:
    """``(repo, path, content, size)``, one row per document."""
    d = F.col("doc_id")
    text = F.when(F.pmod(d, F.lit(23)) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
                  ).otherwise(F.col("text"))
    body = F.when(F.pmod(d, F.lit(19)) == 0,
                  F.concat(F.lit(bytearray(b"\x00")), F.encode(text, "UTF-8"))
                  ).otherwise(F.encode(text, "UTF-8"))
    return documents.select(
        F.col("source").alias("repo"),
        F.concat(_folder(d, F.col("lang")), _name(d)).alias("path"),
        F.when(F.pmod(d, F.lit(17)) == 0, F.lit(None).cast("binary")).otherwise(body).alias("content"),
        F.octet_length(body).cast("bigint").alias("size"),
    )


def _repo_number(repo):
    return F.regexp_extract(repo, r"^src([0-9]+)$", 1).try_cast("int")


def rule_file_rows(documents: DataFrame) -> DataFrame:
    """The rule files of each repository named in ``documents``. The ``.gitignore`` of each differs:
    its last line names files by the repository's own number."""
    n = _repo_number(F.col("repo"))
    own = F.concat(F.lit(GITIGNORE_TEXT), F.lit("f"), n.cast("string"), F.lit("?*.py\n"))
    files = F.array(
        F.when(n.between(*GITIGNORE_REPOS), F.struct(
            F.lit(GITIGNORE_PATH).alias("path"), own.alias("text"))),
        F.when(n.between(*TRACK_IGNORE_REPOS), F.struct(
            F.lit(TRACK_IGNORE_PATH).alias("path"), F.lit(TRACK_IGNORE_TEXT).alias("text"))))
    repos = documents.select(F.col("source").alias("repo")).distinct()
    rows = repos.select("repo", F.explode(F.filter(files, lambda x: x.isNotNull())).alias("f"))
    content = F.encode(F.col("f.text"), "UTF-8")
    return rows.select("repo", F.col("f.path").alias("path"), content.alias("content"),
                       F.octet_length(content).cast("bigint").alias("size"))


def repo_manifest(documents: DataFrame) -> DataFrame:
    """Documents as files, plus the rule files: the full input of a snapshot job."""
    return repo_files(documents).unionByName(rule_file_rows(documents))


def site_manifest(pages: DataFrame) -> DataFrame:
    """Pages as files: repo = host, path = URL path without query or fragment, trimmed."""
    url = F.col("url")
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    content = F.encode(F.col("html"), "UTF-8")
    return pages.select(host.alias("repo"), norm_path(raw).alias("path"), content.alias("content"),
                        F.octet_length(content).cast("bigint").alias("size"))


def messy_table(documents: DataFrame) -> DataFrame:
    """A table that is no clean manifest: ``(source, full, root, bytes)`` with absolute paths that hold
    backslashes, doubled slashes and ``.`` segments, files that are also folders of other files, and
    rows without a usable path. Bytes hold sequences that are no UTF-8."""
    d = F.col("doc_id")
    sid = d.cast("string")
    full = (F.when(F.pmod(d, F.lit(6)) == 0, F.concat(F.lit("/data/"), F.col("source"), F.lit("//x/a"), sid))
            .when(F.pmod(d, F.lit(6)) == 1, F.concat(F.lit("/data/"), F.col("source"), F.lit("/./x/a"),
                                                     (d - 1).cast("string"), F.lit("/b.py")))
            .when(F.pmod(d, F.lit(6)) == 2, F.concat(F.lit("\\data\\"), F.col("source"), F.lit("\\y\\.\\c"), sid, F.lit(".md/")))
            .when(F.pmod(d, F.lit(6)) == 3, F.concat(F.lit("/data/"), F.col("source"), F.lit("/")))
            .when(F.pmod(d, F.lit(6)) == 4, F.concat(F.lit("/other/"), sid)))
    head, tail = F.substring("text", 1, 40), F.substr(F.col("text"), F.lit(41))
    bad = F.when(F.pmod(d, F.lit(2)) == 0, F.lit(bytearray(b"\xff"))).otherwise(F.lit(bytearray(b"\xe2\x82")))
    return documents.select(
        "source", full.alias("full"), F.concat(F.lit("/data/"), F.col("source")).alias("root"),
        F.concat(F.encode(head, "UTF-8"), bad, F.encode(tail, "UTF-8")).alias("bytes"))

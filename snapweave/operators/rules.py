"""Ignore rules.

Three rule sets decide whether a path is ignored; the sets combine with OR, and within a set the
*last* matching pattern wins, so ``!p`` re-includes only within its own set:

* ``gitignore``: the repository's root ``.gitignore`` (nested ones are not read);
* ``track_ignore``: ``.codebase/track_ignore.txt``;
* ``default``: the fixed patterns of :mod:`..functions.constants`, for every repository.

The reserved ``.codebase`` folder is ignored before any rule.

Plan shape. Rule files are a tiny table next to the manifest. Each file is parsed once, by a
vectorised Python helper (rule lines -> compiled, valid regexes; a line that does not compile costs
its own file and nothing else). Per repository the rules become a *plan*: an array of
``(rule_set, include, regex)`` in which consecutive rules of the same polarity are one alternation,
so a path needs one regex test per block rather than per rule. Plans of up to
``Options.broadcast_bytes`` of text in all, measured, are sent to the executors once and rows carry
only their repository; beyond that, rows meet their plan through a shuffle join that AQE can
split when one repository is hot. A pandas UDF evaluates plans with compiled patterns cached per
executor. The default set has no join at all: it is one literal regex, compiled once by ``rlike``.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions.constants import (DEFAULT_IGNORE_PATTERNS, GITIGNORE_PATH, REPORT_GITIGNORE,
                                   REPORT_TRACK, RULE_SETS, TRACK_IGNORE_PATH)
from ..functions.globs import PatternError, default_rules_regex, is_rule_line, java_regex, translate
from ..plans.joins import lookup_side
from ..session import ship_package

DEFAULT_REGEX = default_rules_regex(DEFAULT_IGNORE_PATTERNS)

BLOCK_TYPE = T.StructType([
    T.StructField("rule_set", T.StringType()),
    T.StructField("include", T.BooleanType()),
    T.StructField("regex", T.StringType()),
])

RULE_FILE_TYPE = T.StructType([
    T.StructField("found", T.BooleanType()),
    T.StructField("plan", T.ArrayType(BLOCK_TYPE)),
    T.StructField("lines", T.ArrayType(T.StructType([
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("include", T.BooleanType()),
        T.StructField("regex", T.StringType()),
    ]))),
])

VERDICT_TYPE = T.StructType([T.StructField("gitignore", T.BooleanType()),
                             T.StructField("track_ignore", T.BooleanType())])


def _read_lines(rule_set: str, content) -> list[str] | None:
    """Lines of a rule file as the original read them; None when the file cannot be read."""
    if content is None:
        return None
    try:
        text = bytes(content).decode("utf-8")
    except UnicodeDecodeError:
        return None
    text = text.replace("\r\n", "\n").replace("\r", "\n")  # text-mode read
    if rule_set == "gitignore":
        return [ln for ln in text.splitlines() if is_rule_line(ln)]  # shown raw
    stripped = (ln.strip() for ln in text.split("\n"))
    return [ln for ln in stripped if ln and not ln.startswith("#")]


def _set_plan(rule_set: str, rules: list[dict]) -> list[dict] | None:
    """The blocks of a rule file: runs of rules of one polarity, each as one alternation."""
    usable = [r for r in rules if r["regex"] is not None]
    blocks = [{"rule_set": rule_set, "include": include,
               "regex": "|".join(f"(?:{r['regex']})" for r in run)}
              for include, run in itertools.groupby(usable, key=lambda r: r["include"])]
    return blocks or None


def parse_rule_file(rule_set: str, content) -> dict:
    lines = _read_lines(rule_set, content)
    if lines is None:
        return {"found": False, "plan": None, "lines": []}
    rules = []
    try:
        for k, ln in enumerate(lines, start=1):
            rx, inc = translate(ln)
            rules.append({"ordinal": k, "pattern": ln, "include": inc, "regex": rx})
    except PatternError:
        # one bad line and the whole file is dropped, with no report block
        return {"found": False, "plan": None, "lines": []}
    return {"found": True, "plan": _set_plan(rule_set, rules), "lines": rules}


@F.pandas_udf(RULE_FILE_TYPE)
def _parse_files(rule_set: pd.Series, content: pd.Series) -> pd.DataFrame:
    rows = [parse_rule_file(s, c) for s, c in zip(rule_set, content)]
    return pd.DataFrame({"found": [r["found"] for r in rows], "plan": [r["plan"] for r in rows],
                         "lines": [r["lines"] for r in rows]})


def rule_set_of(path: Column) -> Column:
    return (F.when(path == GITIGNORE_PATH, F.lit("gitignore"))
            .when(path == TRACK_IGNORE_PATH, F.lit("track_ignore")))


def rule_files(manifest: DataFrame, content: str = "content") -> DataFrame:
    """S3 + X12: ``(repo, rule_set, found, plan, lines)``, one row per rule file present.
    ``content`` names the column with the bytes (the facts carry those of rule files alone)."""
    ship_package(manifest.sparkSession)
    f = manifest.filter(F.col("path").isin(GITIGNORE_PATH, TRACK_IGNORE_PATH))
    f = f.select("repo", rule_set_of(F.col("path")).alias("rule_set"), F.col(content).alias("content"))
    p = _parse_files(F.col("rule_set"), F.col("content"))
    return f.select("repo", "rule_set", p.alias("p")).select(
        "repo", "rule_set", "p.found", "p.plan", "p.lines")


def rule_lines(files: DataFrame) -> DataFrame:
    """``(repo, rule_set, ordinal, pattern, include, regex)``; patterns as shown in the
    report (``.gitignore`` lines raw, custom lines stripped). Unusable files have no lines."""
    return (files.select("repo", "rule_set", F.explode("lines").alias("r"))
            .select("repo", "rule_set", "r.ordinal", "r.pattern", "r.include", "r.regex"))


def repo_plans(files: DataFrame) -> DataFrame:
    """``(repo, plan)``: the blocks of a repository's usable rule sets (at most two) as JSON."""
    return (files.filter(F.col("plan").isNotNull()).groupBy("repo")
            .agg(F.to_json(F.flatten(F.array_sort(F.collect_list("plan")))).alias("plan")))


@functools.lru_cache(maxsize=4096)
def compile_plan(plan: str) -> list[tuple[str, list[tuple[bool, re.Pattern]]]]:
    """Per rule set its blocks, last one first: the last match wins."""
    blocks = json.loads(plan)
    return [(name, [(b["include"], re.compile(b["regex"])) for b in run][::-1])
            for name, run in itertools.groupby(blocks, key=lambda b: b["rule_set"])]


def verdict(blocks: list[tuple[bool, re.Pattern]], path: str) -> bool:
    return next((include for include, regex in blocks if regex.match(path)), False)


def _eval_plans(plans=None):
    """UDF ``(path, key)`` to the verdict of each custom set, NULL where the repository has no usable
    rule in it. ``key`` is the repository, looked up in the broadcast ``plans``, or, without
    them, the plan itself."""
    def run(path: pd.Series, key: pd.Series) -> pd.DataFrame:
        res = {n: np.full(len(path), None, dtype=object) for n in VERDICT_TYPE.names}
        for k, rows in path.groupby(key):
            plan = k if plans is None else plans.value.get(k)
            for name, blocks in compile_plan(plan) if plan else ():
                res[name][rows.index] = [verdict(blocks, p) for p in rows]
        return pd.DataFrame(res)

    return F.pandas_udf(run, VERDICT_TYPE)


def default_hit(path: Column) -> Column:
    """P5: one literal regex (compiled once per task by ``rlike``)."""
    return path.rlike(java_regex(DEFAULT_REGEX))


def apply_rules(entries: DataFrame, files: DataFrame, *, broadcast_bytes: int = 8 << 20,
                prune_folders: bool = False) -> DataFrame:
    """P1-P4 + J3: adds ``reserved, gitignore_hit, track_ignore_hit, default_hit, ignored``.

    ``*_hit`` of a custom set is NULL when the repository has no usable rule in it.
    ``files``: the parsed rule files, written. ``prune_folders``: see :class:`..options.Options`."""
    spark = entries.sparkSession
    ship_package(spark)
    plans = repo_plans(files)
    size = plans.agg(F.sum(F.octet_length("plan") + F.octet_length("repo"))).first()[0] or 0
    if size <= broadcast_bytes:
        sent = spark.sparkContext.broadcast({r["repo"]: r["plan"] for r in plans.collect()})
        e, evaluate, key = entries, _eval_plans(sent), F.col("repo")
    else:
        e, evaluate, key = entries.join(lookup_side(plans), "repo", "left"), _eval_plans(), F.col("plan")
    # the path the patterns see; with prune_folders a folder is tested as "path/", as git does
    probe = (F.when(F.col("is_dir"), F.concat(F.col("path"), F.lit("/"))).otherwise(F.col("path"))
             if prune_folders else F.col("path"))
    e = e.withColumn("_probe", probe)
    e = e.withColumn("_v", evaluate(F.col("_probe"), key))
    out = e.select(
        *[c for c in entries.columns],
        P.is_reserved(F.col("path")).alias("reserved"),
        F.col("_v.gitignore").alias("gitignore_hit"),
        F.col("_v.track_ignore").alias("track_ignore_hit"),
        default_hit(F.col("_probe")).alias("default_hit"),
    )
    return out.withColumn("ignored", F.col("reserved") | F.col("default_hit")
                          | F.coalesce(F.col("gitignore_hit"), F.lit(False))
                          | F.coalesce(F.col("track_ignore_hit"), F.lit(False)))


def rule_summary(repos: DataFrame, files: DataFrame) -> DataFrame:
    """``(repo, rule_set, found, patterns)`` for every repository of ``repos`` and each of the three
    rule sets: the default set is always found, a file set when its file could be read; patterns in
    file order. An unusable or absent file has none."""
    sets = F.explode(F.array(*[F.lit(s) for s in RULE_SETS])).alias("rule_set")
    every = repos.select("repo").distinct().select("repo", sets)
    read = files.filter("found").select("repo", "rule_set", F.transform("lines", lambda x: x["pattern"]).alias("p"))
    default = F.array(*[F.lit(p) for p in DEFAULT_IGNORE_PATTERNS])
    is_default = F.col("rule_set") == "default"
    return every.join(read, ["repo", "rule_set"], "left").select(
        "repo", "rule_set", (is_default | F.col("p").isNotNull()).alias("found"),
        F.when(is_default, default).otherwise(F.coalesce("p", F.array().cast("array<string>"))).alias("patterns"))


def pattern_report_rows(files: DataFrame) -> DataFrame:
    """X8 + A10: ``(repo, key, text)`` rows of the report header block, per repository with rule
    files: the ``.gitignore`` block whenever the file was read (even without patterns), the custom
    block only when it has patterns. Keys order the rows inside the block."""
    lines = rule_lines(files)
    shown = files.filter(F.col("found") & ((F.col("rule_set") == "gitignore")
                                           | (F.size("lines") > 0)))
    title = F.when(F.col("rule_set") == "gitignore", F.lit(REPORT_GITIGNORE)).otherwise(
        F.lit(REPORT_TRACK))
    heads = shown.select("repo", "rule_set", F.lit(0).alias("ordinal"), title.alias("text"))
    tails = shown.select("repo", "rule_set", F.lit(1 << 30).alias("ordinal"), F.lit("\n").alias("text"))
    body = lines.join(shown.select("repo", "rule_set"), ["repo", "rule_set"], "left_semi").select(
        "repo", "rule_set", "ordinal", F.concat(F.lit("/* "), F.col("pattern"), F.lit(" */\n")).alias("text"))
    return heads.unionByName(body).unionByName(tails)

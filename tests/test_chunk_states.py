"""Chunks tell others only what these need, and default rules walk a path once."""

import random
import re

from pyspark.sql import functions as F

from snapweave.functions.constants import DEFAULT_IGNORE_PATTERNS
from snapweave.functions.globs import default_rules_regex, java_regex, translate
from snapweave.operators import chunks as C
from snapweave.session import cut_lineage

SCHEMA = "repo string, path string, start long, content binary, size long"


def _chunks(spark, files):
    rows = []
    for path, parts in files.items():
        at, size = 0, sum(map(len, parts))
        for p in parts:
            rows.append(("r", path, at, bytearray(p), size))
            at += len(p)
    return spark.createDataFrame(rows, SCHEMA)


def test_long_chunks_send_one_row(spark):
    """Of a file in chunks of five bytes nothing goes further than to the next chunk, but what is open."""
    plain = [b"abcd\n"] * 400
    summary = cut_lineage(C.summaries(_chunks(spark, {"a.txt": plain, "b.txt": [b"ab\xe2\x82", b"\xac", b"cdef"]})))
    long, parts = C.states(summary)
    assert long.filter("path = 'a.txt'").count() == 399 and parts.filter("path = 'a.txt'").count() == 0
    before = {(r.path, r.start): bytes(r.before) for r in C.placed(summary).collect()}
    assert before[("a.txt", 5)] == b"cd\n" and before[("b.txt", 4)] == b"b\xe2\x82" and before[("b.txt", 5)] == b"\xe2\x82\xac"
    lists = [p for p in C.placed(summary)._jdf.queryExecution().optimizedPlan().toString().split("Aggregate") if "collect_list" in p]
    assert len(lists) == 1  # only of what goes further


def test_before_is_the_last_bytes(spark):
    rng = random.Random(5)
    files = {}
    for i in range(60):
        data = b"".join(rng.choice([b"a", b"\r", b"\n", b"\xc3\xa9", b"\xe2\x82\xac", b"\xf0\x9f\x98\x80", b"\xf0", b"\0"]) for _ in range(40))
        parts, at = [], 0
        while at < len(data):
            n = rng.randint(1, rng.choice([1, 2, 3, 5, 30]))
            parts.append(data[at:at + n])
            at += n
        files[f"{i}.txt"] = parts
    for r in C.placed(cut_lineage(C.summaries(_chunks(spark, files)))).collect():
        whole, before = b"".join(files[r.path])[:r.start], bytes(r.before)
        # What is left out is no part of an open sequence, and the byte before is always known.
        assert whole.endswith(before) and before[-1:] == whole[-1:], (r.path, r.start)
        text = whole.decode("utf-8", "ignore").encode()
        open_ = len(re.search(rb"(?:[\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]?|[\xf0-\xf4][\x80-\xbf]{0,2})?$", whole)[0]) if len(text) < len(whole) else 0
        assert len(before) >= open_, (r.path, r.start)


def test_default_rules_share_their_start(spark):
    old = "^(?:" + "|".join(translate(p)[0][1:-1] for p in DEFAULT_IGNORE_PATTERNS) + ")$"
    new = default_rules_regex(DEFAULT_IGNORE_PATTERNS)
    assert new.count("(?:.+/)?") == 1 < old.count("(?:.+/)?")
    rng = random.Random(6)
    steps = ["a", "build", "xbuild", "b.log", ".log", "log", "x.log.y", "tmp", ".git", "c.DS_Store", "d\n.tmp", "e\r", "", "node_modules", "f.lockb", "\u2028.bak"]
    paths = sorted({"/".join(rng.choice(steps) for _ in range(rng.randint(1, 4))) for _ in range(3000)})
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = df.select(F.col("path").rlike(java_regex(old)).alias("a"), F.col("path").rlike(java_regex(new)).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and 0 < sum(r.a for r in got) < len(got)

"""Properties of the whole pipeline, the sink round trip and plan checks."""

import glob
import os
import re
import tempfile

from pyspark.sql import functions as F

from manifests import make_manifest
from snapweave.plans.snapshot import Snapshot
from snapweave.queries import QUERIES, docs_manifest
from snapweave.sinks import write_snapshot

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_accounting(spark):
    """Every manifest path is either visible (kept or an ignored item) or below an item."""
    snap = Snapshot(docs_manifest(spark, SF))
    disp = snap.dispositions
    files = snap.scan.facts.select("repo", "path")
    vis_files = disp.filter(~F.col("is_dir")).select("repo", "path")
    items = disp.filter(F.col("disposition") == "directory").select("repo", F.col("path").alias("d"))
    below = files.join(items, (files.repo == items.repo) & files.path.startswith(F.concat(items.d, F.lit("/"))),
                       "left_semi")
    assert vis_files.count() + below.count() == files.count()
    # nothing visible lies below an ignored directory item
    vis = disp.select("repo", "path")
    assert vis.join(items, (vis.repo == items.repo) & vis.path.startswith(F.concat(items.d, F.lit("/"))),
                    "left_semi").count() == 0


def test_stats_match_sections(spark):
    snap = Snapshot(docs_manifest(spark, SF))
    sec = snap.sections()
    counted = sec.filter("counted").groupBy("repo").agg(F.sum("n_chars").alias("c"))
    joined = snap.stats.join(counted, "repo")
    assert joined.filter(F.col("total_chars") != F.col("c")).count() == 0
    assert joined.count() == snap.stats.count()


def test_partitioning_does_not_change_result(spark):
    m = docs_manifest(spark, SF)
    a = Snapshot(m).sections().select("repo", "section", "key", "text")
    b = Snapshot(m.repartition(7, "path")).sections().select("repo", "section", "key", "text")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_sink_round_trip(spark):
    m = make_manifest(spark, [("a.py", b"print(1)\n"), ("src/b.md", b"# t"), ("x.png", b"\x89P"),
                              ("r2", "z.txt", b"zz"), ("r2", "node_modules/pkg/i.js", b"1")])
    snap = Snapshot(m)
    sec = snap.sections()
    expected = {}
    for r in sec.orderBy("repo", "section", "key").collect():
        expected[r["repo"]] = expected.get(r["repo"], "") + r["text"]
    out = tempfile.mkdtemp(prefix="snapweave-sink-")
    write_snapshot(sec, out)
    for repo, doc in expected.items():
        parts = sorted(glob.glob(os.path.join(out, f"repo={repo}", "part-*")))
        got = "".join(open(p, encoding="utf-8").read() for p in parts)
        assert got == doc
    assert "CODEBASE SNAPSHOT" in expected["r"] and "/* ===== a.py ===== */" in expected["r"]


def test_sink_orders_sections_from_anywhere(spark):
    snap = Snapshot(docs_manifest(spark, SF))
    sec = snap.sections()
    straight, stored = tempfile.mkdtemp(prefix="snapweave-sink-"), tempfile.mkdtemp(prefix="snapweave-sink-")
    write_snapshot(sec, straight)
    sec.repartition(5, "text").write.parquet(f"{stored}/rows")
    write_snapshot(spark.read.parquet(f"{stored}/rows"), f"{stored}/out")

    def documents(out):
        return {d: "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{out}/{d}/part-*")))
                for d in os.listdir(out) if d.startswith("repo=")}

    assert documents(straight) == documents(f"{stored}/out")


def test_stats_sink_keeps_other_repositories(spark):
    from snapweave.sinks import write_stats
    out = tempfile.mkdtemp(prefix="snapweave-sink-")
    for repo in ("a", "b"):
        write_stats(Snapshot(make_manifest(spark, [(repo, "x.py", b"1")])).stats, f"{out}/stats")
    assert sorted(r["repo"] for r in spark.read.parquet(f"{out}/stats").collect()) == ["a", "b"]


def test_no_plan_has_a_nested_loop_or_cartesian(spark, monkeypatch):
    """Every frame that is written on the way, as it ran, and the final one."""
    from snapweave import session
    seen = []
    real = session.cut_lineage

    def watched(df):
        out = real(df)
        seen.append(_plan(df))
        return out

    import snapweave.operators.scan as scan
    import snapweave.plans.joins as joins
    import snapweave.plans.snapshot as snapshot
    for module in (scan, joins, snapshot):
        monkeypatch.setattr(module, "cut_lineage", watched)
    for name in ("prune_files", "ignored_directories", "tree_lines", "snapshot_sections"):
        df = QUERIES[name](spark, SF)
        df.collect()
        seen.append(_plan(df))
    assert len(seen) > 15
    for plan in seen:
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, plan


def test_frames_are_made_when_asked_for(spark, monkeypatch):
    import snapweave.operators.scan as scan
    import snapweave.plans.snapshot as snapshot
    from snapweave.operators.scan import Scan
    snap = Snapshot(docs_manifest(spark, SF))
    assert not {"facts", "flagged", "dispositions"} & set(vars(snap.scan))
    s = Scan(docs_manifest(spark, SF), with_chars=False)
    s.visible
    assert "dispositions" not in vars(s)
    monkeypatch.setattr(snapshot, "tree_lines", None)
    assert QUERIES["header_section"](spark, SF).count() > 0  # no tree is built
    assert scan.Scan is Scan


def test_bodies_are_read_and_shuffled_once(spark):
    """Bodies meet their decisions without a join: one exchange, one scan with ``text``, no sampling."""
    sec = Snapshot(docs_manifest(spark, SF)).sections()
    sec.collect()
    plan = _plan(sec)
    final = plan[:plan.index("== Initial Plan ==")]
    assert "shufflepartitionidpassthrough" in final and "rangepartitioning" not in final
    assert "SortMergeJoin" not in final and "ShuffledHashJoin" not in final
    assert len(re.findall(r"FileScan parquet \[[^\]]*text#[^\]]*\][^\n]*documents", final)) == 1


def test_running_sums_over_blocks(spark):
    from snapweave.plans.prefix import running_before
    rows = [(None if i % 7 == 0 else "ab"[i % 2], i % 5, f"k{i * 37 % 2000:05d}", i * 13 % 50) for i in range(2000)] + [("b", 9, "", 10**12)]
    df = spark.createDataFrame(rows, "repo string, section int, key string, weight long").repartition(5)
    got = {(r.repo, r.section, r.key): r.before for r in running_before(df, ["repo", "section", "key"], "weight").collect()}
    total = 0
    for repo, section, key, weight in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        assert got[(repo, section, key)] == total
        total += weight
    assert running_before(df.limit(0), ["repo"], "weight").count() == 0


def test_ranges_follow_the_weights(spark):
    rows = [("a", f"f{i:04d}.txt", b"x" * 1000) for i in range(300)] + [("b", "big.txt", b"y\n" * 200_000)] + [("c", "z.txt", b"z")]
    sec = Snapshot(make_manifest(spark, rows), num_partitions=6).sections()
    from pyspark.sql import functions as F
    parts = sec.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("n_chars").alias("n"), F.min("repo").alias("lo"),
                                                              F.max("repo").alias("hi")).orderBy("p").collect()
    assert len(parts) >= 3 and all(a.hi <= b.lo for a, b in zip(parts, parts[1:]))
    assert max(r.n for r in parts) <= 400_000 + 150_000


def test_offsets_are_places_in_the_document(spark):
    from snapweave.plans.prefix import section_offsets
    sec = Snapshot(docs_manifest(spark, SF)).sections()
    starts = {(r.repo, r.section, r.key): r.start for r in section_offsets(sec).collect()}
    documents, n = {}, 0
    for r in sorted(sec.collect(), key=lambda r: (r.repo, r.section, r.key)):
        assert starts[(r.repo, r.section, r.key)] == len(documents.setdefault(r.repo, ""))
        documents[r.repo] += r.text
        n += 1
    assert n == len(starts)


def test_statistics_name_the_document(spark, tmp_path):
    from snapweave.sinks import write_snapshot, write_stats
    import os
    names = ["plain", "a b", "c:d=e%f", "x'y\"z#*?[]{^"]
    snap = Snapshot(make_manifest(spark, [(n, "x.py", b"1") for n in names]))
    write_snapshot(snap.sections(), f"{tmp_path}/documents")
    write_stats(snap.stats, f"{tmp_path}/stats", f"{tmp_path}/documents")
    rows = spark.read.parquet(f"{tmp_path}/stats").collect()
    assert len(rows) == len(names) and all(os.path.isdir(r["output_file"]) and r["timestamp"] for r in rows)


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"repo", "text_files", "binary_files", "ignored_items", "total_files",
                               "total_chars", "errors", "timestamp"}
    assert set(QUERIES) <= set(e.queries()) and set(QUERIES) <= set(e.oracle_sql()) <= set(e.queries())


def test_empty_and_rules_only_manifests(spark):
    empty = spark.createDataFrame(
        [], "repo string, path string, content binary, size bigint")
    snap = Snapshot(empty)
    assert snap.stats.count() == 0 and snap.sections().count() == 0
    only_rules = make_manifest(spark, [(".gitignore", b"*.log\n")])
    snap = Snapshot(only_rules)
    st = snap.stats.first()
    assert (st["text_files"], st["ignored_items"]) == (1, 0)
    texts = [r["text"] for r in snap.sections().orderBy("section", "key").collect()]
    assert texts[0].startswith("/* ====") and "└── .gitignore" in "".join(texts)
    assert not any("IGNORED FILES" in t for t in texts)  # no report without ignored items

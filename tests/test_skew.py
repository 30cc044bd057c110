"""A hot repository: the rule join, kept off broadcast, must have its skewed partitions split."""

from pyspark.sql import functions as F

from manifests import make_manifest
from snapweave.operators.classify import file_facts
from snapweave.operators.rules import apply_rules, rule_files
from snapweave.operators.scan import Scan, entries
from snapweave.options import Options
from snapweave.session import cut_lineage

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    # several map tasks on any number of cores: a skewed partition is split by its map outputs
    "spark.sql.files.maxPartitionBytes": "8KB",
    "spark.sql.files.openCostInBytes": "1KB",
}


def _manifest(spark):
    rows = [("hot", f"src/d{i % 50}/f{i}.py", b"x") for i in range(4000)]
    for r in range(12):
        rows += [(f"cold{r}", f"a/f{i}.py", b"y") for i in range(5)]
    for repo in ["hot"] + [f"cold{r}" for r in range(12)]:
        rows.append((repo, ".gitignore", b"*.log\n!keep.log\nd1\n"))
    return make_manifest(spark, rows)


def test_rule_join_splits_hot_repository(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        m = _manifest(spark)
        files = cut_lineage(rule_files(m))
        e = cut_lineage(entries(file_facts(m, with_chars=False)))
        flagged = apply_rules(e, files, broadcast_bytes=0)
        rows = flagged.collect()
        n_ignored = sum(1 for r in rows if r["ignored"])
        plan = flagged._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan
        assert "SortMergeJoin" in plan and "skew=true" in plan, plan
        assert n_ignored > 0
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_repository_results_unchanged(spark):
    m = _manifest(spark)
    a = Scan(m).dispositions.select("repo", "path", "disposition")
    b = Scan(m, options=Options(broadcast_bytes=0)).dispositions.select(
        "repo", "path", "disposition")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    d1 = a.filter((F.col("repo") == "hot") & (F.col("path") == "src/d1")).first()
    assert d1["disposition"] == "directory"


def _with_conf(spark, fn):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        return fn()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    return plan


def _hot_folder(spark):
    rows = [("r", f"big/f{i}.py", b"x") for i in range(4000)]
    rows += [("r", f"d{k}/g{i}.py", b"y") for k in range(12) for i in range(4)]
    rows.append(("r", "big/sub/h.log", b"z"))
    rows.append(("r", "big/node_modules/pkg/x.js", b"1"))
    return make_manifest(spark, rows)


def test_hot_folder_joins_are_split(spark):
    from snapweave.operators.scan import blocked_dirs, visible
    from snapweave.operators.tree import tree_lines

    def run():
        s = Scan(_hot_folder(spark), options=Options(broadcast_bytes=0))
        vis = visible(s.flagged, blocked_dirs(s.flagged))
        assert "skew=true" in _final_plan(vis)
        lines = tree_lines(s.dispositions)
        assert "skew=true" in _final_plan(lines)
        return lines.count()

    # root, big/, 4000 files, sub/, h.log, node_modules/, pkg/, 12 folders with 4 files each
    assert _with_conf(spark, run) == 1 + 1 + 4000 + 1 + 1 + 1 + 1 + 12 * 5


def test_hot_folder_of_folders_is_split(spark):
    """One folder holds most of all folders: the join of folders with their parent's last child splits it."""
    from snapweave.operators import tree
    rows = [("r", f"hot/d{i:05d}/x.py", b"") for i in range(6000)] + [("r", f"c{i % 40}/e{i}/y.py", b"") for i in range(400)]
    te = cut_lineage(tree.tree_entries(entries(file_facts(make_manifest(spark, rows), with_chars=False)).repartition(8)))
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        last = cut_lineage(tree.last_siblings(te))
        joined = te.filter("is_dir").join(last.select("repo", "parent", "last"), ["repo", "parent"])
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {len(r.child_prefix) // 4 for r in tree.child_prefixes(te, last).collect()} == {1, 2}


def test_deep_paths(spark):
    from snapweave.operators.tree import tree_lines
    deep = "/".join(f"d{i}" for i in range(500))
    m = make_manifest(spark, [("r", f"{deep}/x.py", b""), ("r", "a/b/c.py", b""), ("r", "z.py", b"")])
    lines = [r.line for r in tree_lines(Scan(m, with_chars=False).dispositions).orderBy("key").collect()]
    assert len(lines) == 1 + 500 + 1 + 2 + 1 + 1
    at = next(i for i, x in enumerate(lines) if x.endswith("x.py"))
    assert lines[at] == "\u2502   " + " " * 4 * 499 + "\u2514\u2500\u2500 x.py"

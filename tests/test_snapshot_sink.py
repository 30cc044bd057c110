"""Documents read back: every line is numbered in its place, whatever blocks the part files are read in."""

from pyspark.sql import functions as F

from snapweave import queries as Q
from snapweave.sinks import read_lines, write_snapshot


def _sections(spark, n):
    rows = [(repo, 2, f"{i:05d}", f"é{'x' * (i * i % 41)}\r\n\n{i}\n") for repo in ("a", "b") for i in range(n)]
    return spark.createDataFrame(rows, "repo string, section int, key string, text string").repartition(7)


def _expected(n):
    lines = [x for i in range(n) for x in (f"é{'x' * (i * i % 41)}\r", "", str(i))]
    look = [len(x) + (ord(x[0]) if x else 0) + 1 for x in lines]
    return len(lines), sum(len(x) + 1 for x in lines), sum((i + 1) * k for i, k in enumerate(look))


def test_lines_are_numbered_over_blocks_and_files(spark, tmp_path, monkeypatch):
    numbered = []

    def running(df, order, weight, name="before"):
        numbered.append(df.count())
        return Q_running(df, order, weight, name)
    Q_running = Q.running_before
    monkeypatch.setattr(Q, "running_before", running)
    out, n = str(tmp_path / "docs"), 2000
    write_snapshot(_sections(spark, n), out, num_partitions=3)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "4096")
        lines = read_lines(spark, out)
        assert lines.select("repo", "file", "block").distinct().count() > lines.select("repo", "file").distinct().count()
        got = {r.repo: (r.n_lines, r.n_chars, r.order_sum) for r in Q.line_sums(lines).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {repo: _expected(n) for repo in ("a", "b")}
    assert numbered[0] < 6 * n / 20  # running sums see a row per block, not per line


def test_no_task_of_the_sink_holds_a_whole_part_file(spark, monkeypatch):
    """A part file holds up to 128 MB of text: it is read by lines, not as one cell that is split again for each."""
    seen = []
    running = Q.running_before
    monkeypatch.setattr(Q, "running_before", lambda df, *a, **k: seen.append(df) or running(df, *a, **k))
    Q.q_snapshot_sink(spark, "/root/testdata/sf0.001").collect()
    plan = seen[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "split(" not in plan, plan


def test_a_changed_order_changes_the_sum(spark, tmp_path):
    s = _sections(spark, 50)
    sums = []
    for name, key in (("a", F.col("key")), ("b", F.when(F.col("key") == "00010", "00011a").otherwise(F.col("key")))):
        write_snapshot(s.withColumn("key", key), f"{tmp_path}/{name}")
        sums.append([r.order_sum for r in Q.line_sums(read_lines(spark, f"{tmp_path}/{name}")).orderBy("repo").collect()])
    assert all(x != y for x, y in zip(*sums))

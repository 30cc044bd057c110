import os
import tempfile

from pyspark.sql import functions as F

from snapweave.plans.snapshot import Snapshot
from snapweave.sources.manifest import manifest_from_table, manifest_rejects
from snapweave.sources.tree_source import manifest_from_tree


def _tree(base):
    files = {
        ".gitignore": b"*.log\n",
        "__init__.py": b"",
        "src/a.py": b"print(1)\n",
        "src/.hidden/b.txt": b"b",
        "node_modules/pkg/i.js": b"x",
        "logs/x.log": b"l",
        ".codebase/track_ignore.txt": b"# h\nsrc/a.py\n",
        "img.png": b"\x89PNG",
    }
    for rel, data in files.items():
        p = os.path.join(base, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(data)
    return files


def test_tree_source_keeps_hidden_names(spark):
    base = tempfile.mkdtemp(prefix="snapweave-tree-")
    files = _tree(base)
    m = manifest_from_tree(spark, [base], repos=["proj"], prune=False)
    rows = {r["path"]: r for r in m.filter("NOT is_dir").collect()}
    assert set(rows) == set(files)
    assert rows["src/a.py"]["content"] == bytearray(b"print(1)\n")
    # default-ignored, reserved and binary paths keep their row but skip the bytes; rule files are read
    assert rows["node_modules/pkg/i.js"]["content"] is None and rows["img.png"]["content"] is None
    assert rows[".codebase/track_ignore.txt"]["content"] is not None
    assert {r["repo"] for r in rows.values()} == {"proj"}
    folders = {r["path"] for r in m.filter("is_dir").collect()}
    assert folders == {"src", "src/.hidden", "node_modules", "node_modules/pkg", "logs", ".codebase"}


def test_tree_source_empty_linked_and_closed_folders(spark):
    base = tempfile.mkdtemp(prefix="snapweave-tree-")
    _tree(base)
    os.makedirs(os.path.join(base, "empty"))
    os.symlink(os.path.join(base, "src"), os.path.join(base, "link_top"))
    os.symlink(os.path.join(base, "logs"), os.path.join(base, "src", "link_below"))
    os.symlink(os.path.join(base, "nowhere"), os.path.join(base, "broken"))
    for target in (1, 256):
        m = manifest_from_tree(spark, [base], repos=["proj"], target_partitions=target)
        snap = Snapshot(m)
        disp = {r["path"]: (r["is_dir"], r["disposition"]) for r in snap.dispositions.collect()}
        assert disp["empty"] == (True, None) and disp["link_top"] == (True, None)
        assert disp["src/link_below"] == (True, None) and not any(p.startswith("link_top/") for p in disp)
        assert disp["broken"] == (False, "binary")
        lines = [r["line"] for r in snap.tree_lines.orderBy("key").collect()]
        assert "├── empty/" in lines and "├── link_top/" in lines


def test_unlistable_folders_have_no_entries(monkeypatch):
    from snapweave.sources import tree_source as T
    base = tempfile.mkdtemp(prefix="snapweave-tree-")
    _tree(base)
    real = os.scandir

    def scandir(path):
        if str(path).endswith("src"):
            raise PermissionError(path)
        return real(path)

    monkeypatch.setattr(T.os, "scandir", scandir)
    reader = T.TreeReader({"paths": f'["{base}"]', "repos": '["p"]'})
    rows = {r[1] for part in reader.partitions() for r in reader.read(part)}
    assert "src" in rows and "src/a.py" not in rows and "logs/x.log" in rows


def test_bounded_reads():
    from snapweave.sources import tree_source as T
    base = tempfile.mkdtemp(prefix="snapweave-tree-")
    for name, data, want in (("a.zzz", b"\0" * 9000, 4096), ("b.zzz", b"text " * 2000, 10_000), ("c.mp4", b"x" * 9000, None),
                             ("d.txt", b"\0" * 9000, 9000), ("e.zzz", b"\xff" + b"a" * 8000, 4096), ("f.txt", b"", 0)):
        full = os.path.join(base, name)
        with open(full, "wb") as f:
            f.write(data)
        got = list(T.read_file(full, name, len(data), False, None, 1 << 20))
        assert [(s, None if d is None else len(d)) for s, d in got] == [(0, want)], name
        assert list(T.read_file(full, name, len(data), True, None, 1 << 20)) == [(0, None)]
    assert list(T.read_file(os.path.join(base, "missing"), "missing", 5, False, None, 99)) == [(0, None)]


def test_spans_and_chunks_are_the_file():
    import io
    import random
    from snapweave.sources import tree_source as T
    rng = random.Random(6)
    for _ in range(400):
        data = b"".join(rng.choice([b"a", b"\n", b"\r\n", b"long " * 5]) for _ in range(rng.randint(0, 60)))
        split, limit = rng.randint(1, 80), rng.randint(1, 40)
        rows = [r for a in range(0, len(data), split) for r in T.chunks_of(io.BytesIO(data), len(data), (a, min(len(data), a + split)), limit)]
        at = 0
        for start, some in rows:
            assert start == at and some and (some.endswith(b"\n") or start + len(some) == len(data))
            at += len(some)
        assert b"".join(x for _, x in rows) == data


def test_a_line_too_long_for_a_cell_makes_a_file_unreadable(monkeypatch):
    from snapweave.sources import tree_source as T
    base = tempfile.mkdtemp(prefix="snapweave-tree-")
    with open(os.path.join(base, "x.txt"), "wb") as f:
        f.write(b"ok\n" + b"y" * 5000 + b"\nrest\n")
    monkeypatch.setattr(T, "MAX_BYTES", 4000)
    rows = list(T.read_file(os.path.join(base, "x.txt"), "x.txt", 5009, False, None, 1000))
    assert rows[-1][1] is None and all(d is None or d.endswith(b"\n") for _, d in rows)


def test_large_files_are_many_rows_and_tasks(spark):
    base = tempfile.mkdtemp(prefix="snapweave-tree-")
    line = "räksmörgås %06d €\r\n"
    text = "".join(line % i for i in range(20_000))
    data = text.encode()
    for name in ("big.txt", "big.zzz", "sub/big.py"):
        os.makedirs(os.path.dirname(os.path.join(base, name)), exist_ok=True)
        with open(os.path.join(base, name), "wb") as f:
            f.write(data)
    with open(os.path.join(base, "big.bin9"), "wb") as f:
        f.write(b"\0" + data)
    m = manifest_from_tree(spark, [base], repos=["p"], chunk_bytes=30_000, split_bytes=150_000)
    rows = m.filter("NOT is_dir").select("path", "start", F.octet_length("content").alias("n"), F.spark_partition_id().alias("task")).collect()
    for name in ("big.txt", "big.zzz", "sub/big.py"):
        mine = [r for r in rows if r.path == name]
        assert sum(r.n for r in mine) == len(data) and len(mine) > 10 and max(r.n for r in mine) < 31_000
        assert len({r.task for r in mine}) == -(-len(data) // 150_000)
    assert [(r.start, r.n) for r in rows if r.path == "big.bin9"] == [(0, 4096)]
    snap = Snapshot(m)
    st = snap.stats.first()
    assert (st.text_files, st.binary_files, st.errors) == (3, 1, 0)
    sec = snap.sections().filter("section = 2").orderBy("key", "part").collect()
    want = text.replace("\r\n", "\n")
    documents = "".join(r.text for r in sec)
    assert documents.count(want) == 3 and len(sec) > 30


def test_pruned_folders_are_not_listed(monkeypatch):
    from snapweave.sources import tree_source as T
    base = tempfile.mkdtemp(prefix="snapweave-tree-")
    _tree(base)
    for rel in ("node_modules/pkg/deep/er/x.js", "build_out/a/b.txt", "keep/k.py"):
        p = os.path.join(base, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        open(p, "wb").close()
    with open(os.path.join(base, ".gitignore"), "ab") as f:
        f.write(b"build_out\n")
    listed, real = [], os.scandir
    monkeypatch.setattr(T.os, "scandir", lambda p: listed.append(os.path.relpath(p, base)) or real(p))
    for target in ("1", "256"):
        for prune, never in (("true", {"node_modules/pkg", "build_out", ".codebase"}), ("false", set())):
            listed.clear()
            reader = T.TreeReader({"paths": f'["{base}"]', "repos": '["p"]', "prune": prune, "targetPartitions": target})
            rows = {r[1]: r for part in reader.partitions() for r in reader.read(part)}
            assert never.isdisjoint(listed) and not any(p.startswith("node_modules/pkg/") for p in listed if never)
            assert {"node_modules/pkg", "build_out", ".codebase/track_ignore.txt", "keep/k.py"} <= set(rows)
            assert ("node_modules/pkg/deep/er/x.js" in rows) == (prune == "false")
            assert (rows["src/a.py"][3] is None) == (prune == "true")  # dropped by the repository's own rule


def test_pruning_changes_no_document(spark):
    base = tempfile.mkdtemp(prefix="snapweave-tree-")
    _tree(base)
    os.makedirs(os.path.join(base, "node_modules/pkg/deep"))
    for as_git in (False, True):
        from snapweave.options import Options
        a, b = (Snapshot(manifest_from_tree(spark, [base], repos=["p"], prune=prune, prune_folders=as_git),
                         options=Options(prune_folders=as_git)) for prune in (True, False))
        order = ["section", "key"]
        assert a.sections().orderBy(*order).collect() == b.sections().orderBy(*order).collect()
        assert a.stats.collect() == b.stats.collect()


def test_names_are_judged_as_in_the_table(spark):
    from manifests import make_manifest
    from snapweave.operators.classify import file_facts
    from snapweave.sources.tree_source import says_name
    names = ["a.py", "x.PNG", "Makefile", "deps.lock", "x.tgz", "x.txt.gz", "x.txt.br", ".bashrc", "n.zzz", "a.svg", "b.mp3",
             "..a", "a.", ".gz", "x.JSON", "noext"]
    facts = file_facts(make_manifest(spark, [(n, b"") for n in names]), with_chars=False)
    assert {r["path"]: r["by_name"] for r in facts.collect()} == {n: says_name(n) for n in names}


def test_tree_source_snapshot(spark):
    base = tempfile.mkdtemp(prefix="snapweave-tree-")
    _tree(base)
    snap = Snapshot(manifest_from_tree(spark, [base], repos=["proj"]))
    disp = {r["path"]: r["disposition"] for r in snap.dispositions.collect()}
    assert disp["src/a.py"] == "file"          # custom rule
    assert disp["logs/x.log"] == "file"        # .gitignore rule, the folder itself not pruned
    assert disp["node_modules/pkg"] == "directory"
    assert disp["__init__.py"] == "text"
    assert disp["img.png"] == "binary"
    assert disp[".codebase"] == "directory"


def _absolute(spark):
    return spark.createDataFrame([("p", "/home/u/p/src/x.py", "/home/u/p", b"1"),
                                  ("p", "/elsewhere/y.py", "/home/u/p", b"2"),
                                  ("p", "\\home\\u\\p\\.\\\\z.md", "/home/u/p", b"3"),
                                  ("p", None, "/home/u/p", b"4"), ("p", "/home/u/p/", "/home/u/p", b"5")],
                                 "r string, full string, root string, data binary")


def test_manifest_from_table_relative(spark):
    df = _absolute(spark)
    m = manifest_from_table(df, repo="r", path="full", content="data", root="root", rejects="apart")
    assert sorted(r["path"] for r in m.collect()) == ["src/x.py", "z.md"]
    assert m.filter(F.col("size") != 1).count() == 0
    bad = manifest_rejects(df, repo="r", path="full", root="root")
    assert sorted((str(r["path"]), r["reason"]) for r in bad.collect()) == [
        ("/elsewhere/y.py", "path outside its root"), ("/home/u/p/", "empty path"), ("None", "no path")]


def test_unusable_rows_fail_the_job(spark):
    import pytest
    m = manifest_from_table(_absolute(spark), repo="r", path="full", content="data", root="root")
    with pytest.raises(Exception, match="manifest row rejected"):
        m.select("path").collect()
    with pytest.raises(Exception, match="manifest row rejected"):
        Snapshot(m).stats


def test_a_file_that_is_also_a_folder(spark):
    from manifests import make_manifest
    snap = Snapshot(make_manifest(spark, [("a", b"one\n"), ("a/b.py", b"two\n")]))
    assert sorted((r["path"], r["is_dir"], r["disposition"]) for r in snap.dispositions.collect()) == [
        ("a", False, "text"), ("a", True, None), ("a/b.py", False, "text")]
    st = snap.stats.first()
    assert (st["text_files"], st["errors"]) == (2, 0)
    assert snap.sections().filter("section = 2").count() == 2
    assert [r["line"] for r in snap.tree_lines.orderBy("key").collect()] == [".", "├── a/", "│   └── b.py", "└── a"]


def test_tree_source_splits_large_folders(spark):
    base = tempfile.mkdtemp(prefix="snapweave-tree-")
    files = _tree(base)
    for i in range(30):
        p = os.path.join(base, "src", "big", f"f{i}.py")
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(b"%d" % i)
    want = set(files) | {f"src/big/f{i}.py" for i in range(30)}
    for target, per, least in ((1, 5000, 1), (4, 7, 3), (256, 7, 10)):
        m = manifest_from_tree(spark, [base], repos=["proj"], target_partitions=target, files_per_partition=per, prune=False)
        got = [r["path"] for r in m.filter("NOT is_dir").collect()]
        assert sorted(got) == sorted(want)  # each file exactly once
        assert m.rdd.getNumPartitions() >= least

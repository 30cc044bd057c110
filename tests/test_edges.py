"""Edge tables of FIXTURES.md sections 4-7, values derived by reading the original tool."""

import pytest
from pyspark.sql import functions as F

from manifests import make_manifest
from snapweave.functions import paths as P
from snapweave.functions.text import size_label
from snapweave.operators.classify import is_text, name_verdict, with_mime
from snapweave.operators.scan import Scan
from snapweave.operators.tree import tree_lines
from snapweave.plans.snapshot import Snapshot

CLASSIFY = [
    ("a/Makefile", None, True),
    ("prod.env", None, True),
    ("Yarn.LOCK", b"\x00", True),
    ("deps.LOCK", b"\x00", False),
    ("logo.PNG", b"abc", False),
    ("icon.svg", b"<svg/>", True),
    ("notes.txt", b"a\x00b", True),
    ("x.zzz", b"", True),
    ("x.zzz", b"a\x00b", False),
    ("x.zzz", "é".encode(), True),
    ("x.zzz", b"\xff", False),
    ("x.zzz", b"a" * 4095 + "é".encode(), False),
    ("x.zzz", b"a" * 4096 + b"\x00", True),
    ("x.zzz", None, False),
    (".bashrc", b"a", True),
    ("x.tgz", b"abc", True),       # alias -> application/x-tar: undecided, sniffed
    ("x.txt.gz", b"\x00", False),  # denied extension before MIME
    ("x.txt.br", b"\x00", True),   # encoding skipped: text/plain
]


def test_classification(spark):
    rows = [(f"{i}/{p}", c) for i, (p, c, _) in enumerate(CLASSIFY)]
    m = make_manifest(spark, rows).withColumn("name", P.name(F.col("path")))
    m = with_mime(m)
    got = {r["path"]: r["t"] for r in m.select(
        "path", is_text(name_verdict(F.col("name"), F.col("mime")), F.col("content")).alias("t")
    ).collect()}
    for i, (p, _, want) in enumerate(CLASSIFY):
        assert got[f"{i}/{p}"] is want, (p, want)


GITIGNORE = b"*.txt\n!docs/**/*.txt\ndocs/de\n"
TRACK = b"# header\n/build\ntests/*\n"
RULES = [
    ("a.txt", "file", None),
    ("docs/a.txt", "keep", None),
    ("docs/fr/a.txt", "keep", None),
    ("docs/de/a.txt", "pruned", "docs/de"),
    ("docs/x.log", "file", None),
    ("build/x.py", "pruned", "build"),
    ("sub/build/x.py", "file", None),
    ("node_modules/x.js", "file", None),
    ("node_modules/pkg/y.js", "pruned", "node_modules/pkg"),
    ("tests/t.py", "file", None),
    ("tests/__data__/d.py", "pruned", "tests/__data__"),
    ("src/a.log.py", "keep", None),
    ("x.log/y.py", "pruned", "x.log"),
    (".codebase/codebase.txt", "pruned", ".codebase"),
    (".codebaserc", "keep", None),
]


def test_rules_and_pruning(spark):
    rows = [(p, b"x") for p, _, _ in RULES] + [(".gitignore", GITIGNORE),
                                              (".codebase/track_ignore.txt", TRACK)]
    s = Scan(make_manifest(spark, rows))
    disp = {r["path"]: r["disposition"] for r in s.dispositions.collect()}
    for path, outcome, d in RULES:
        if outcome == "pruned":
            assert path not in disp, path
            assert disp[d] == "directory", (path, d)
        elif outcome == "file":
            assert disp[path] == "file", path
        else:
            assert disp[path] in ("text", "binary"), path
    assert disp[".gitignore"] == "text"
    assert disp["node_modules"] is None  # shown, not an item (folder patterns skip the folder)


def _tree(spark, max_depth=None):
    paths = ["README", "__init__.py", "src/b.py", "src/A.py", "docs/i.md", ".codebaserc"]
    s = Scan(make_manifest(spark, [(p, b"x") for p in paths]))
    rows = tree_lines(s.dispositions, max_depth=max_depth).orderBy("key").collect()
    return [r["line"] for r in rows]


def test_tree(spark):
    assert _tree(spark) == [".", "├── docs/", "│   └── i.md", "├── src/", "│   ├── A.py",
                            "│   └── b.py", "└── README"]


def test_tree_depth_zero(spark):
    assert _tree(spark, max_depth=0) == [".", "├── docs/", "├── src/", "└── README"]


def test_sections(spark):
    rows = [("a.py", b"x\r\ny\r"), ("Makefile", None), ("e.txt", b""), ("b.txt", b"a\xffb")]
    snap = Snapshot(make_manifest(spark, rows))
    sec = {r["key"]: r["text"] for r in snap.sections().filter("section = 2").collect()}
    by_path = {k.split("\x01")[0][1:]: v for k, v in sec.items()}
    assert by_path["a.py"] == "/* ===== a.py ===== */\nx\ny\n\n\n"
    assert by_path["Makefile"].startswith("/* ===== ERROR: Could not read file: Makefile ===== */\n")
    assert by_path["e.txt"] == "/* ===== e.txt ===== */\n\n\n"
    assert by_path["b.txt"] == "/* ===== b.txt ===== */\na�b\n\n"
    st = snap.stats.first()
    assert (st["text_files"], st["errors"], st["binary_files"]) == (4, 1, 0)


@pytest.mark.parametrize("size,label", [(0, "0 Bytes"), (512, "512.00 Bytes"), (1024, "1.00 KB"),
                                        (1152, "1.12 KB"), (1408, "1.38 KB"),
                                        (2 ** 50, "1024.00 TB"), (1023, "1023.00 Bytes")])
def test_size_label(spark, size, label):
    df = spark.range(1).select(F.lit(size).cast("bigint").alias("s"))
    assert df.select(size_label(F.col("s"))).first()[0] == label

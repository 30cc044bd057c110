import pytest
from pyspark.sql import functions as F

from manifests import make_manifest
from snapweave.functions import paths as P
from snapweave.operators.classify import is_text, name_verdict, with_mime
from snapweave.operators.scan import Scan
from snapweave.options import Options
from snapweave.plans.snapshot import Snapshot


def _disp(spark, rows, **kw):
    s = Scan(make_manifest(spark, rows), options=Options(**kw))
    return {r["path"]: r["disposition"] for r in s.dispositions.collect()}


def test_prune_folders(spark):
    rows = [("node_modules/x.js", b"1"), ("node_modules/pkg/y.js", b"2"), ("a.py", b"3")]
    default = _disp(spark, rows)
    assert default["node_modules"] is None and default["node_modules/x.js"] == "file"
    git_like = _disp(spark, rows, prune_folders=True)
    assert git_like["node_modules"] == "directory"
    assert "node_modules/x.js" not in git_like and git_like["a.py"] == "text"


def test_strict_boundary(spark):
    cut = b"a" * 4095 + "é".encode()
    m = make_manifest(spark, [("x.zzz", cut)]).withColumn("name", P.name(F.col("path")))
    m = with_mime(m)
    v = name_verdict(F.col("name"), F.col("mime"))
    strict, loose = m.select(is_text(v, F.col("content")), is_text(v, F.col("content"), False)).first()
    assert strict is False and loose is True


def test_mime_override(spark):
    rows = [("x.zzz", b"\x00\x01")]
    assert _disp(spark, rows)["x.zzz"] == "binary"
    assert _disp(spark, rows, mime_overrides=((".zzz", "text/plain"),))["x.zzz"] == "text"


def test_duplicate_paths_fail_loudly(spark):
    m = make_manifest(spark, [("a.py", b"1"), ("a.py", b"2")])
    with pytest.raises(ValueError, match="listed twice"):
        Snapshot(m).stats
    Snapshot(m, options=Options(require_unique_paths=False)).stats  # allowed when asked


def test_show_dunder(spark):
    snap = Snapshot(make_manifest(spark, [("__init__.py", b""), ("a.py", b"")]),
                    options=Options(hide_dunder=False))
    lines = [r["line"] for r in snap.tree_lines.orderBy("key").collect()]
    assert lines == [".", "├── __init__.py", "└── a.py"]

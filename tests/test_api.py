from pyspark.sql import functions as F

from manifests import make_manifest
import snapweave as sw


def test_api_end_to_end(spark):
    m = make_manifest(spark, [("src/a.py", b"1"), ("b.log", b"2"), ("node_modules/p/x.js", b"3"),
                              (".gitignore", b"src/*.py\n")])
    parts = sw.path_parts(m).filter(F.col("path") == "src/a.py").first()
    assert (parts["name"], parts["suffix"], parts["parent"], parts["depth"]) == ("a.py", ".py", "src", 1)
    assert sw.ancestors(m).filter(F.col("path") == "node_modules/p/x.js").count() == 2
    assert [r["pattern"] for r in sw.parse_rules(m).collect()] == ["src/*.py"]
    flagged = sw.is_ignored(m)
    assert flagged.filter("path = 'src/a.py'").first()["ignored"] is True
    assert "node_modules/p/x.js" not in {r["path"] for r in sw.prune(flagged).collect()}
    assert sw.is_text(m).filter("path = 'b.log'").first()["is_text"] is True
    disp = sw.scan(m)
    lines = [r["line"] for r in sw.tree(disp).orderBy("key").collect()]
    assert lines[0] == "." and "└── b.log" in lines
    sections, stats = sw.snapshot(m)
    assert stats.first()["text_files"] == 1  # only .gitignore is kept
    assert sections.filter("section = 2").count() == 1

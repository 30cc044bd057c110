from snapweave.operators.rules import parse_rule_file


def test_gitignore_lines_kept_raw_and_numbered():
    p = parse_rule_file("gitignore", b"# c\r\n*.txt\r\n\r\n  docs/de\n!keep.txt\n")
    assert p["found"]
    assert [(r["ordinal"], r["pattern"], r["include"]) for r in p["lines"]] == [
        (1, "*.txt", True), (2, "  docs/de", True), (3, "!keep.txt", False)]
    assert p["plan"][0]["rule_set"] == "gitignore" and p["plan"][0]["include"] is True


def test_track_lines_are_stripped():
    p = parse_rule_file("track_ignore", b"# header\n\n  /build  \ntests/*\n")
    assert [r["pattern"] for r in p["lines"]] == ["/build", "tests/*"]


def test_invalid_line_disables_the_file():
    p = parse_rule_file("gitignore", b"*.txt\n!\n")
    assert p == {"found": False, "plan": None, "lines": []}


def test_unreadable_or_undecodable():
    assert parse_rule_file("gitignore", None)["found"] is False
    assert parse_rule_file("gitignore", b"\xff\xfe*.txt")["found"] is False


def test_slash_only_is_listed_but_no_rule():
    p = parse_rule_file("gitignore", b"/\n")
    assert p["found"] and p["lines"][0]["regex"] is None and p["plan"] is None


def test_blocks_merge_same_polarity():
    p = parse_rule_file("gitignore", b"a\nb\n!c\nd\n")
    assert [b["include"] for b in p["plan"]] == [True, False, True]


import pytest  # noqa: E402

from manifests import make_manifest  # noqa: E402
from snapweave.operators.scan import Scan  # noqa: E402


@pytest.mark.parametrize("bad", [b"*.py\n[z-a]\n", b"*.py\nabc\\\n", b"*.py\n!\n"])
def test_a_bad_line_costs_its_own_file_only(spark, bad):
    rows = [(r, p, b"x") for r in ("a", "b", "c") for p in ("m.py", "n.txt")]
    rows += [("a", ".gitignore", b"*.txt\n"), ("b", ".gitignore", bad), ("c", ".gitignore", b"*.txt\n")]
    got = {(r["repo"], r["path"]): r["disposition"] for r in Scan(make_manifest(spark, rows)).dispositions.collect()}
    for r in ("a", "c"):
        assert got[r, "n.txt"] == "file" and got[r, "m.py"] == "text"
    assert got["b", "n.txt"] == "text" and got["b", "m.py"] == "text"


@pytest.mark.parametrize("bound", [8 << 20, 0])
def test_control_characters_in_patterns(spark, bound):
    from snapweave.options import Options
    line = "k\x1d\x1e\x1fz.py"
    rows = [("a", line, b"x"), ("a", "m.py", b"x"), ("a", ".codebase/track_ignore.txt", f"{line}\n!nothing\n".encode()),
            ("b", "m.py", b"x"), ("b", ".codebase/track_ignore.txt", b"m.py\n")]
    s = Scan(make_manifest(spark, rows), options=Options(broadcast_bytes=bound))
    got = {(r["repo"], r["path"]): r["ignored"] for r in s.flags.collect()}
    assert got["a", line] is True and got["a", "m.py"] is False and got["b", "m.py"] is True

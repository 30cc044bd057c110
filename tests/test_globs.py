import re

import pytest

from snapweave.functions.constants import DEFAULT_IGNORE_PATTERNS
from snapweave.functions.globs import PatternError, default_rules_regex, translate

CASES = [
    ("node_modules/", r"^(?:.+/)?node_modules/.*$", True),
    ("*.ext", r"^(?:.+/)?[^/]*\.ext(?:/.*)?$", True),
    ("name", r"^(?:.+/)?name(?:/.*)?$", True),
    ("/name", r"^name(?:/.*)?$", True),
    ("a/b", r"^a/b(?:/.*)?$", True),
    ("a/*", r"^a/[^/]+(?:/.*)?$", True),
    ("a/**/b", r"^a(?:/.+)?/b(?:/.*)?$", True),
    ("a/**", r"^a/.*$", True),
    ("**/a", r"^(?:.+/)?a(?:/.*)?$", True),
    ("!p", r"^(?:.+/)?p(?:/.*)?$", False),
    ("[!ab]", r"^(?:.+/)?[^ab](?:/.*)?$", True),
    ("?x", r"^(?:.+/)?[^/]x(?:/.*)?$", True),
    ("\\#x", r"^(?:.+/)?\#x(?:/.*)?$", True),
    ("  docs/de  ", r"^docs/de(?:/.*)?$", True),
]


@pytest.mark.parametrize("pattern,regex,include", CASES)
def test_translate(pattern, regex, include):
    assert translate(pattern) == (regex, include)


@pytest.mark.parametrize("line", ["", "   ", "# comment", "/"])
def test_no_rule(line):
    assert translate(line) == (None, None)


def test_invalid():
    with pytest.raises(PatternError):
        translate("!")
    with pytest.raises(PatternError):
        translate("abc\\")
    with pytest.raises(PatternError):
        translate("[z-a]")


@pytest.mark.parametrize("line,regex", [
    ("**", r"^[^/]+(?:/.*)?$"), ("a/**/**/b", r"^a(?:/.+)?/b(?:/.*)?$"), ("[]a]x", r"^(?:.+/)?[\]a]x(?:/.*)?$"),
    ("[ab", r"^(?:.+/)?\[ab(?:/.*)?$"), ("[]", r"^(?:.+/)?\[\](?:/.*)?$"), ("[^a]", r"^(?:.+/)?[\^a](?:/.*)?$"),
    ("a\\*b", r"^(?:.+/)?a\*b(?:/.*)?$"), ("/a/", r"^a/.*$"), ("a/**/", r"^a/.*$"), ("a**b", r"^(?:.+/)?a[^/]*[^/]*b(?:/.*)?$"),
])
def test_corners(line, regex):
    assert translate(line) == (regex, True)


@pytest.mark.parametrize("path,hit", [
    ("node_modules", False),  # a folder pattern does not match the folder itself
    ("node_modules/x.js", True),
    ("a/node_modules/pkg", True),
    ("x.log", True),
    ("x.log/y.py", True),
    ("src/a.log.py", False),
    ("build.py", False),
    ("sub/build/x", True),
    ("a.DS_Store", True),
])
def test_default_regex(path, hit):
    rx = re.compile(default_rules_regex(DEFAULT_IGNORE_PATTERNS))
    assert bool(rx.match(path)) is hit


def test_last_match_semantics_examples():
    txt, _ = translate("*.txt")
    neg, inc = translate("!docs/**/*.txt")
    assert inc is False
    assert re.match(txt, "docs/fr/a.txt") and re.match(neg, "docs/fr/a.txt")
    assert re.match(neg, "docs/a.txt")
    assert not re.match(neg, "a.txt")

"""gitignore-style patterns ("gitwildmatch") to anchored regular expressions.

A rule line goes through three small steps, once per line (a small table), never per path:

1. :func:`parse` reads the line into a :class:`Rule`: a polarity, a list of :class:`Step` (one per path
   segment, each with its tokens and whether any number of folders may come before it) and what the
   pattern covers below its last step.
2. :func:`emit` writes one regex fragment per token kind (``FRAGMENTS``) and per step.
3. :func:`translate` compiles the result, so that a line that is no valid pattern is known here.

Every regex uses only non-capturing groups, character classes and backslash-escaped punctuation, so
Java (Spark's ``rlike``), Python ``re`` and RE2 (DuckDB) read it the same way. Java needs ``(?d)``
in front so that ``.`` stops only at ``\\n``; :func:`java_regex` adds it.

Grammar (a path is relative, ``/``-separated, with no leading or trailing slash):

====================  ==========================================
pattern               regex
====================  ==========================================
``name/``             ``^(?:.+/)?name/.*$`` (below the folder, not the folder itself)
``*.ext``             ``^(?:.+/)?[^/]*\\.ext(?:/.*)?$``
``name``              ``^(?:.+/)?name(?:/.*)?$``
``/name``             ``^name(?:/.*)?$``
``a/b``               ``^a/b(?:/.*)?$`` (an inner slash anchors)
``a/*``               ``^a/[^/]+(?:/.*)?$``
``a/**/b``            ``^a(?:/.+)?/b(?:/.*)?$``
``a/**``              ``^a/.*$``
``**/a``              same as ``a``
``**``                ``^[^/]+(?:/.*)?$``
``?`` ``[ab]`` ``[!ab]``  ``[^/]`` ``[ab]`` ``[^ab]``
``!p``                regex of ``p`` with include = False
blank, ``#...``, ``/``    no rule
====================  ==========================================
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

ANY_DEPTH = "**"
PUNCTUATION = frozenset(".^$*+?()[]{}|\\/-&~#")

#: A token of a segment: an escape, a run of stars, one character, a set, or a literal.
TOKEN = re.compile(r"\\(?P<escaped>.)|(?P<dangling>\\\Z)|(?P<star>\*)|(?P<any>\?)"
                   r"|\[(?P<set>[!^]?+\]?+[^\]]*)\]|(?P<literal>.)", re.S)


class PatternError(ValueError):
    """A rule line that cannot be compiled; it disables its whole rule file."""


@dataclass
class Step:
    """One path segment; ``deep``: any number of folders may come before it."""

    segment: str
    deep: bool = False


@dataclass
class Rule:
    include: bool
    steps: list[Step] = field(default_factory=list)
    below_only: bool = False  # the pattern covers what is below its last step, not the step itself


def quoted(text: str, special=PUNCTUATION) -> str:
    return "".join("\\" + c if c in special else c for c in text)


FRAGMENTS = {
    "escaped": quoted,
    "star": lambda _: "[^/]*",
    "any": lambda _: "[^/]",
    "literal": quoted,
}


def fragment(token: re.Match) -> str:
    if token["set"] is not None:
        members = token["set"].removeprefix("!")
        return "[" + ("^" if members != token["set"] else "") + quoted(members, "[]\\&^") + "]"
    if token["dangling"]:
        raise PatternError("dangling escape")
    return FRAGMENTS[token.lastgroup](token[token.lastgroup])


def segment_regex(segment: str) -> str:
    """A lone star is a name of one character or more; elsewhere a star may be empty."""
    return "[^/]+" if segment == "*" else "".join(map(fragment, TOKEN.finditer(segment)))


def clean_line(line: str) -> str:
    """Whitespace handling of a rule line: both ends, unless it ends with an escaped space."""
    return line.lstrip() if line.endswith("\\ ") else line.strip()


def is_rule_line(line: str) -> bool:
    """Lines listed in the pattern report: not blank and not a comment."""
    s = line.strip()
    return bool(s) and not s.startswith("#")


def parse(line: str) -> Rule | None:
    """The rule of a line, None when it is no rule."""
    text = clean_line(line)
    if text == "/" or not is_rule_line(text):
        return None
    rule = Rule(include=not text.startswith("!"))
    text = text.removeprefix("!")
    if not text:
        raise PatternError(f"empty pattern {line!r}")
    below = text.endswith("/") and len(text) > 1
    body = text[:-1] if below else text
    anchored = "/" in body
    deep = not anchored
    for segment in body.removeprefix("/").split("/"):
        if segment == ANY_DEPTH:
            deep = True
            continue
        rule.steps.append(Step(segment, deep))
        deep = False
    if not rule.steps:  # nothing but "**"; "/**/" asks for an empty name, which no path has
        rule.steps.append(Step("" if below and body.startswith("/") else "*", deep=below))
    elif deep:  # a "**" at the end: below the last step
        below = True
    rule.below_only = below
    return rule


def emit(rule: Rule) -> str:
    out = "^"
    for i, step in enumerate(rule.steps):
        lead = ("(?:.+/)?" if step.deep else "") if i == 0 else ("(?:/.+)?/" if step.deep else "/")
        out += lead + segment_regex(step.segment)
    return out + ("/.*" if rule.below_only else "(?:/.*)?") + "$"


def translate(line: str) -> tuple[str | None, bool | None]:
    """``(regex, include)`` of one rule line, ``(None, None)`` when it is no rule.

    Raises :class:`PatternError` for a line that cannot be compiled."""
    rule = parse(line)
    if rule is None:
        return None, None
    regex = emit(rule)
    try:
        re.compile(regex)
    except re.error as e:
        raise PatternError(f"{line!r}: {e}") from e
    return regex, rule.include


def java_regex(regex: str) -> str:
    """Regex for Spark's ``rlike``: UNIX_LINES so that ``.`` behaves as in Python and RE2."""
    return "(?d)" + regex


def default_rules_regex(patterns) -> str:
    """All default patterns as one alternation (none of them negates, so OR is exact). What many begin with
    stands there once, so that a path is not walked once for each pattern."""
    rules = _share([translate(p)[0][1:-1] for p in patterns], "(?:.+/)?[^/]*")
    return "^(?:" + "|".join(_share(rules, "(?:.+/)?")) + ")$"


def _share(rules: list[str], start: str) -> list[str]:
    """``rules`` with all that begin with ``start``, whole steps of a path, as one."""
    rest = [r[len(start):] for r in rules if r.startswith(start)]
    others = [r for r in rules if not r.startswith(start)]
    return others + ([start + "(?:" + "|".join(rest) + ")"] if rest else [])

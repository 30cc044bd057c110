"""Path expressions (N1-N4). All are built-in Catalyst expressions: they stay inside whole-stage
codegen and need no Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import RESERVED_DIR


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_path(c) -> Column:
    """Backslashes to slashes; empty segments (leading, trailing and doubled slashes) and ``.``
    segments are dropped."""
    segments = F.split(F.translate(_c(c), "\\", "/"), "/")
    return F.array_join(F.filter(segments, lambda s: (s != "") & (s != ".")), "/")


def rel_path(path, root) -> Column:
    """``path`` relative to ``root``: '' for the root itself, NULL when outside it."""
    p, r = norm_path(path), norm_path(root)
    below = F.substr(p, F.length(r) + 2)
    return (F.when(r == "", p)
            .when(p == r, F.lit(""))
            .when(p.startswith(F.concat(r, F.lit("/"))), below))


def parts(c) -> Column:
    return F.split(_c(c), "/")


def name(c) -> Column:
    """Last segment."""
    return F.element_at(parts(c), -1)


def parent(c) -> Column:
    """Path without its last segment; '' for a top-level entry."""
    return F.regexp_extract(_c(c), r"(?s)^(.*)/[^/]*$", 1)


def depth(c) -> Column:
    """0 for a top-level entry (the root's children)."""
    return F.size(parts(c)) - 1


def suffix(name_col) -> Column:
    """``pathlib`` suffix: from the last dot, if that dot is neither first nor last."""
    return F.regexp_extract(_c(name_col), r"(?s)^.+(\.[^.]+)$", 1)


def ancestors(c) -> Column:
    """Proper ancestors, outermost first: ``a/b/c`` -> ``[a, a/b]``."""
    ps = parts(c)
    return F.transform(F.slice(ps, 1, F.size(ps) - 1),
                       lambda _x, i: F.array_join(F.slice(ps, 1, i + 1), "/"))


def is_reserved(c) -> Column:
    """The reserved output folder and everything below it."""
    p = _c(c)
    return (p == RESERVED_DIR) | p.startswith(RESERVED_DIR + "/")


def tree_key(path_col, is_dir_col) -> Column:
    """O1 as a byte-comparable string: per segment a flag (``0`` directory, ``1`` file), the
    lower-cased name, ``\\x01``, the name, ``\\x01``. Ancestors are directories. Ordering these
    strings equals ordering ``array<struct<not_dir, lname, name>>`` (pre-order, directories first,
    case-insensitive, ties by exact name), because ``\\x01`` sorts below every character of a name
    and a parent's key is a prefix of its children's keys."""
    ps = parts(path_col)
    n = F.size(ps)
    seg = lambda flag, x: F.concat(flag, F.lower(x), F.lit("\u0001"), x, F.lit("\u0001"))
    anc = F.array_join(F.transform(F.slice(ps, 1, n - 1), lambda x: seg(F.lit("0"), x)), "")
    leaf = seg(F.when(is_dir_col, F.lit("0")).otherwise(F.lit("1")), F.element_at(ps, -1))
    return F.concat(anc, leaf)


def content_key(path_col) -> Column:
    """O3 as a byte-comparable string: a folder's files (flag ``0``) come before its subfolders
    (flag ``1``), by exact name. Depends on the path alone, so the manifest side can compute it."""
    ps = parts(path_col)
    n = F.size(ps)
    anc = F.array_join(F.transform(F.slice(ps, 1, n - 1),
                                   lambda x: F.concat(F.lit("1"), x, F.lit("\u0001"))), "")
    return F.concat(anc, F.lit("0"), F.element_at(ps, -1), F.lit("\u0001"))

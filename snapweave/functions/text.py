"""Byte and text expressions (P11, X1-X3, X13), all built-in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import SIZE_UNITS, SNIFF_BYTES


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sniff_is_text(content, strict_boundary: bool = True) -> Column:
    """Empty -> text; NUL in the first 4096 bytes -> binary; first 4096 bytes valid UTF-8 ->
    text, else binary (a character cut at byte 4096 makes the file binary); NULL (unreadable) ->
    binary. ``substring`` on BINARY counts bytes. ``strict_boundary=False`` also accepts a head
    that is valid once up to three bytes at the cut are dropped."""
    b = _c(content)
    head = F.substring(b, 1, SNIFF_BYTES)
    no_nul = ~F.contains(head, F.lit(bytearray(b"\x00")))
    valid = F.call_function("is_valid_utf8", head.cast("string"))
    if not strict_boundary:
        cut = F.octet_length(b) > SNIFF_BYTES
        for k in (1, 2, 3):
            shorter = F.substring(b, 1, SNIFF_BYTES - k).cast("string")
            valid = valid | (cut & F.call_function("is_valid_utf8", shorter))
    return (F.when(b.isNull(), F.lit(False))
            .when(F.octet_length(b) == 0, F.lit(True))
            .otherwise(no_nul & valid))


def decode_replace(content) -> Column:
    """UTF-8 decode, one U+FFFD per bad sequence (Python's ``errors='replace'``)."""
    return F.call_function("make_valid_utf8", _c(content).cast("string"))


def universal_newlines(text) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n``, as a text-mode read does (two literal
    replacements, no regex: every ``\\r\\n`` first, then the ``\\r`` left over)."""
    t = F.replace(_c(text), F.lit("\r\n"), F.lit("\n"))
    return F.replace(t, F.lit("\r"), F.lit("\n"))


def text_length(content) -> Column:
    """X3 without building the text: code points after decoding, minus one per ``\\r\\n`` (the
    pair becomes one ``\\n``; a lone ``\\r`` keeps the length)."""
    raw = _c(content).cast("string")
    t = F.when(F.call_function("is_valid_utf8", raw), raw).otherwise(
        F.call_function("make_valid_utf8", raw))
    pairs = F.when(F.contains(t, F.lit("\r")),
                   (F.length(t) - F.length(F.replace(t, F.lit("\r\n"), F.lit("")))) / 2
                   ).otherwise(F.lit(0))
    return (F.length(t) - pairs).cast("bigint")


def read_text(content) -> Column:
    """X1 then X2: what a text-mode read of the bytes returns."""
    return universal_newlines(decode_replace(content))


def size_label(size) -> Column:
    """``0 Bytes``; otherwise divide by 1024 while >= 1024 (at most up to TB), two decimals
    rounded half-even on the exact binary value (``format_number`` with a pattern)."""
    s = _c(size).cast("double")
    out = F.when(_c(size) == 0, F.lit("0 Bytes"))
    for i, unit in enumerate(SIZE_UNITS):
        lo = float(1024 ** i)
        scaled = s / F.lit(lo)
        cond = (s < F.lit(float(1024 ** (i + 1)))) if i < len(SIZE_UNITS) - 1 else F.lit(True)
        out = out.when(cond, F.concat(F.call_function("format_number", scaled, F.lit("0.00")), F.lit(" " + unit)))
    return out

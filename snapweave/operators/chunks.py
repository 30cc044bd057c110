"""Files in chunks: text, counts and classification of content that is cut anywhere.

A chunked manifest has a row per chunk, ``repo, path, start, content, size``: the bytes of a file from
``start`` on, ``size`` being the whole file's. A file's chunks follow one another without gaps; none is
empty but a file's only one. So a file may be larger than a cell, and its chunks are read and decoded
by as many tasks.

What a chunk's text is depends on the bytes before it in two ways: a UTF-8 sequence may be open, and a
``\\r`` may wait for its ``\\n``. Both are told by the last three bytes before the chunk, and "the last three
bytes of all that came before" composes: each chunk sends its own last bytes to the places where the next
chunks may start (up to three, as chunks may be as short as a byte), and a chunk puts together
what it is sent. No chunk waits for another and no file is gathered; the key is the place in the file.

A piece is what a chunk adds to the text: the sequence that was open before it, then its own bytes but
for a sequence that is open at its end, which the next piece takes. Decoding restarts at such a place,
so the pieces are together the text of the whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.constants import GITIGNORE_PATH, SNIFF_BYTES, TRACK_IGNORE_PATH
from ..functions.text import read_text, sniff_is_text, text_length
from ..options import DEFAULT, Options
from .classify import name_verdict, with_mime
from .rules import default_hit

KEY = ["repo", "path", "start"]
#: Bytes of a chunk up to which its summary holds it whole.
SHORT = 16
_CONT = "[89AB]."
#: A started and unfinished UTF-8 sequence at the end of hexadecimal bytes.
_OPEN = (f"^(?:..)*?((?:C[2-9A-F]|D.|E.|F[0-4])|(?:E0[AB].|E[1-9A-CEF]{_CONT}|ED[89].|F0[9AB].|F[1-3]{_CONT}|F48.)"
         f"|(?:F0[9AB].|F[1-3]{_CONT}|F48.){_CONT})$")


def _last(b: Column, n: int) -> Column:
    return F.substring(b, -n, n)


def open_bytes(b: Column) -> Column:
    """How many bytes at the end of ``b`` (0 to 3) are an unfinished UTF-8 sequence."""
    n = F.length(F.regexp_extract(F.hex(_last(b, 3)), _OPEN, 1)) / F.lit(2)
    return F.when(_last(b, 1) < F.lit(bytearray(b"\x80")), F.lit(0.0)).otherwise(n)  # most end with ASCII


def _open_part(before: Column) -> Column:
    n = open_bytes(before).cast("int")
    return F.when(n > 0, F.substring(before, -n, n)).otherwise(F.lit(bytearray()))


def _drop(b: Column, n: Column) -> Column:
    return F.substring(b, F.lit(1), (F.octet_length(b) - n).cast("int"))


def _joins(before: Column, content: Column) -> Column:
    """Does a ``\\r\\n`` lie across the cut?"""
    return (_last(before, 1) == F.lit(bytearray(b"\r"))) & (F.substring(content, 1, 1) == F.lit(bytearray(b"\n")))


def _effective(before: Column, content: Column, last: Column) -> Column:
    whole = F.concat(_open_part(before), content)
    return _drop(whole, F.when(last, F.lit(0)).otherwise(open_bytes(F.concat(before, content)).cast("int")))


def piece_text(before: Column, content: Column, last: Column) -> Column:
    """What a chunk adds to the text. ``before``: the three bytes before it (fewer at a file's start)."""
    text = read_text(_effective(before, content, last))
    return F.when(_joins(before, content), F.substr(text, F.lit(2))).otherwise(text)


def summaries(chunks: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Per chunk what all other steps need of its bytes: ``n`` bytes, ``short`` (a short chunk, whole, else its
    first bytes that may belong to the sequence before), ``tail``, the characters of the rest, and of the
    chunks at a file's start the bytes for the sniff. One pass over ``content``, nothing moved."""
    c, p = F.col("content"), F.col("path")
    m = with_mime(chunks.withColumn("name", P.name(p)), overrides=options.mime_overrides)
    m = m.withColumn("by_name", name_verdict(F.col("name"), F.col("mime")))
    n = F.octet_length(c)
    whole = n <= SHORT
    lead = F.length(F.regexp_extract(F.hex(F.substring(c, 1, 3)), f"^((?:{_CONT}){{0,3}})", 1)) / F.lit(2)
    lead = F.when(F.substring(c, 1, 1) < F.lit(bytearray(b"\x80")), F.lit(0.0)).otherwise(lead)
    rest = F.substring(c, (lead + 1).cast("int"), (n - lead - open_bytes(c)).cast("int"))
    counts = ~whole & (F.col("by_name").isNull() | (F.col("by_name") == "text")) & ~P.is_reserved(p) & ~default_hit(p)
    sniffed = F.col("by_name").isNull() & (F.col("start") <= SNIFF_BYTES)
    return m.select(
        *KEY, "size", "mime", "by_name", c.isNotNull().alias("readable"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n"),
        F.when(whole, c).otherwise(F.substring(c, F.lit(1), lead.cast("int"))).alias("short"),
        (F.substring(c, 1, 1) == F.lit(bytearray(b"\n"))).alias("feed"), _last(c, 3).alias("tail"),
        F.when(counts, text_length(rest)).alias("rest_chars"),
        F.when(sniffed, F.substring(c, F.lit(1), (SNIFF_BYTES + 1 - F.col("start")).cast("int"))).alias("head"),
        F.when(p.isin(GITIGNORE_PATH, TRACK_IGNORE_PATH), c).alias("rule_bytes"))


def states(summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last three bytes before each place where a chunk may start, twice ``(repo, path, start, ...)``: ``code``, as
    a number, where a chunk of three bytes or more ends (a sum of its own in a hash map, no list), and
    ``parts``, put together, where shorter ones end. Of a longer chunk only an open sequence is sent further
    than to its end, as nothing else has a part in what comes there."""
    end, tail, n = F.col("start") + F.col("n"), F.col("tail"), F.col("n")
    sending = summary.filter((n > 0) & (end < F.col("size")))
    code = F.conv(F.hex(tail), 16, 10).cast("bigint")
    long = sending.filter(n >= 3).groupBy("repo", "path", end.alias("start")).agg(F.max(code).alias("code"))
    to = [F.struct((end + d).alias("start"), end.alias("end"), _last(tail, 3 - d).alias("b")) for d in range(3)]
    sent = sending.filter((n < 3) | (open_bytes(tail) > 0)).select(
        "repo", "path", F.explode(F.when(n < 3, F.array(*to)).otherwise(F.array(*to[1:]))).alias("s"))
    got = sent.groupBy("repo", "path", F.col("s.start").alias("start")).agg(
        F.array_sort(F.collect_list(F.struct("s.end", "s.b"))).alias("parts"))  # three at most
    before = F.aggregate("parts", F.lit(bytearray()), lambda a, x: F.concat(a, x["b"]))
    return long, got.select("repo", "path", "start", _last(before, 3).alias("parts"))


def placed(summary: DataFrame) -> DataFrame:
    """The written summaries with ``before``, ``last`` and ``chars``, the characters of the chunk's piece."""
    long, parts = states(summary)
    known = F.coalesce(F.unhex(F.lpad(F.hex("code"), 6, "0")), F.col("parts"), F.lit(bytearray()))
    x = summary.join(long, KEY, "left").join(parts, KEY, "left").withColumn("before", known).drop("code", "parts")
    x = x.withColumn("last", ~F.col("readable") | (F.col("start") + F.col("n") >= F.col("size")))
    before, short = F.col("before"), F.col("short")
    cut = (_last(before, 1) == F.lit(bytearray(b"\r"))) & F.col("feed")
    whole = text_length(_effective(before, short, F.col("last")))
    left_open = F.when(F.col("last") & (open_bytes(F.col("tail")) > 0), F.lit(1)).otherwise(F.lit(0))
    parts = text_length(F.concat(_open_part(before), short)) + F.col("rest_chars") + left_open
    chars = F.when(F.col("n") <= SHORT, whole).otherwise(parts) - F.coalesce(cut.cast("int"), F.lit(0))
    return x.withColumn("chars", F.when(F.col("readable"), chars))


def chunked_facts(chunks: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """The facts of files (as :func:`.classify.file_facts`) from ``chunks``, the written result of :func:`placed`.
    Per file partial aggregates, but for at most ``SNIFF_BYTES`` first bytes and the bytes of rule files."""
    def in_order(name: str) -> Column:
        parts = F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("start", F.col(name).alias("b")))))
        joined = F.aggregate(parts, F.lit(bytearray()), lambda a, x: F.concat(a, x["b"]))
        return F.when(F.size(parts) > 0, joined)

    f = chunks.groupBy("repo", "path").agg(
        F.max("size").alias("size"), F.bool_and("readable").alias("readable"), F.max("mime").alias("mime"),
        F.max("by_name").alias("by_name"), F.sum("chars").alias("chars"), in_order("head").alias("head"),
        in_order("rule_bytes").alias("rule_bytes"))
    sniff = F.coalesce(F.col("readable") & sniff_is_text(F.col("head"), options.strict_boundary), F.lit(False))
    f = f.withColumn("sniff_text", F.when(F.col("by_name").isNull(), sniff))
    f = f.withColumn("is_text", F.when(F.col("by_name").isNotNull(), F.col("by_name") == "text").otherwise(sniff))
    counted = F.col("is_text") & F.col("readable") & ~P.is_reserved(F.col("path")) & ~default_hit(F.col("path"))
    return f.select("repo", "path", "size", "readable", "mime", "by_name", "sniff_text", "is_text",
                    F.when(F.col("readable"), F.col("rule_bytes")).alias("rule_bytes"),
                    F.when(counted, F.col("chars")).alias("text_chars"))


def pieces(chunks: DataFrame, placed_chunks: DataFrame) -> DataFrame:
    """``(repo, path, start, text, n_chars)`` of every readable chunk; bodies stay where they are read when
    Spark broadcasts the places, else move once."""
    where = placed_chunks.filter("readable").select(*KEY, "before", "last", "chars")
    x = chunks.select(*KEY, "content").join(where, KEY)
    return x.select(*KEY, piece_text(F.col("before"), F.col("content"), F.col("last")).alias("text"),
                    F.col("chars").cast("bigint").alias("n_chars"))

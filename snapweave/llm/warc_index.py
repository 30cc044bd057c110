"""WARC archives with a two-level capture index.

Writing. Each task writes the pages it reads as WARC/1.1 records, one gzip member per record, to an
archive in the shared folder; nothing is shuffled for it but the decision which records are
revisits. Of records with equal payloads (SHA-1 and length) of at least ``MIN_REVISIT`` bytes, the one
with the largest page id holds the payload, the others are ``revisit`` records that refer to it and
keep only the HTTP head. Archive names carry a random part and only those that a committed task
returned are read, so a task that runs twice does no harm.

Index. One line per record, keyed by the URL with its host reversed (``com,example)/path``) and the
page id, is range-partitioned and sorted by key; each task writes one index file of
gzip-compressed blocks of ``BLOCK_LINES`` lines. The sparse directory has the first key, offset and
length of every block; the first keys of the index files are its upper level.

Reading. A look-up finds the index file by binary search over the files' first keys, the block by
binary search over that file's directory, reads the block's byte range, finds the line by binary
search, and reads the record's byte range from its archive. Look-ups are sorted by key first, so a
block is read once per task. :func:`read_all` looks every record up again this way.

Files are reached through ``pyarrow.fs``, by the scheme of ``spark.checkpoint.dir`` (or of the given
folder), so that any shared file system it knows will do.

Defined cases: null html is the empty payload; null URLs are written as empty target URIs; null ids
count as smaller than any id and are returned as null; rows that repeat an id and a payload: one is
the response, the others revisit it; an empty table gives no archives and no rows; other columns do
not matter.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, scratch_path, ship_package
from .common import map_batches, table, text_or_empty

MIN_REVISIT = 1000
BLOCK_LINES = 3000
#: Records of one index file, whose look-ups are one task.
FILE_LINES = 100_000
OPEN_FILES = 64
LEVEL = 1
#: Characters that keys and headers hold only percent-encoded.
UNSAFE = re.compile("[\\x00-\\x20\\x7f]")
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records -----------------------------------------------------------------------------------

def url_key(url: str) -> str:
    """The URL with its host reversed by labels, lower-cased, without scheme, user and port. Spaces and
    control characters are percent-encoded, so that no key holds the index's separators or sorts below
    them."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").rstrip(".")
        path = parts.path or "/"
        key = ",".join(reversed(host.split("."))) + ")" + path + ("?" + parts.query if parts.query else "")
    except ValueError:
        key = ")" + url
    return UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", key)


def clean(url: str) -> str:
    """A header value: no line ends or other control characters, no space at its ends."""
    return UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)


def record_id(page: str) -> str:
    return f"<urn:page:{page}>"


def record(page: str, url: str, payload: bytes, digest: str, refers: str | None) -> bytes:
    """A WARC record; ``refers`` is the page whose record holds the payload of a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}",
             f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(url)}",
             f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Parsed:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def headers_of(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:] if ": " in line)


def parse(raw: bytes) -> Parsed:
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = headers_of(head)
    block = rest[:int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return Parsed(headers, headers_of(http), payload)


def packed(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def unpacked(raw: bytes) -> bytes:
    return zlib.decompress(raw, 31)


# --- files ---------------------------------------------------------------------------------------

def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a URI; Hadoop writes ``file:/x`` for ``file:///x``."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pa.fs.FileSystem.from_uri(uri)


def read_range(files: dict, uri: str, offset: int, length: int) -> bytes:
    """Bytes of a file; ``files`` keeps the last ``OPEN_FILES`` files open."""
    if uri not in files:
        if len(files) >= OPEN_FILES:
            files.pop(next(iter(files))).close()
        fs, path = opened(uri)
        files[uri] = fs.open_input_file(path)
    return files[uri].read_at(length, offset)


def name_in(folder: str, kind: str) -> str:
    return f"{folder}/{kind}-{uuid.uuid4().hex}.gz"


# --- writing -------------------------------------------------------------------------------------

def write_records(folder: str):
    """Task: pages (id, page, url, html, refers) to one archive; index rows."""
    def run(batches):
        uri, sink, offset = name_in(folder, "warc"), None, 0
        for b in batches:
            cols = {n: [] for n in INDEX_COLUMNS}
            for page, url, html, refers in zip(*(b.column(n).to_pylist() for n in ("page", "url", "html", "refers"))):
                if sink is None:
                    fs, path = opened(uri)
                    sink = fs.open_output_stream(path, compression=None)
                raw = packed(record(page, url, html, hashlib.sha1(html).hexdigest(), refers))
                sink.write(raw)
                for n, v in zip(cols, (f"{url_key(clean(url))} {page}", uri, offset, len(raw))):
                    cols[n].append(v)
                offset += len(raw)
            yield pa.RecordBatch.from_pydict(cols | {"id": b.column("id")})
        if sink is not None:
            sink.close()
    return run


INDEX_COLUMNS = ("key", "file", "offset", "length")


def revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (id, url, html) with ``refers``: the id, as text, of the page whose record holds the
    payload, null for responses."""
    ids = cut_lineage(pages.select("id", F.unhex(F.sha1("html")).alias("digest"), F.octet_length("html").alias("n"))
                      .filter(F.col("n") >= MIN_REVISIT))
    shared = ids.groupBy("digest", "n").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    others = cut_lineage(ids.join(shared, ["digest", "n"]).select(
        "id", F.col("digest").alias("d"), "keep", F.col("id").eqNullSafe(F.col("keep")).alias("same")))
    first = others.filter(~F.col("same")).select("id", "d", F.coalesce(F.col("keep").cast("string"), F.lit("")).alias("refers"))
    again = others.filter("same").groupBy("id", "d").count().filter("count > 1")
    told = first.distinct()
    rows = pages.withColumn("digest", F.unhex(F.sha1("html")))
    told = told.withColumnRenamed("id", "told_id")
    out = rows.join(told, rows["id"].eqNullSafe(told["told_id"]) & (rows["digest"] == told["d"]), "left") \
        .drop("told_id", "d")
    if not again.isEmpty():  # rows that repeat the response: all but one of them refer to it
        a = again.withColumnRenamed("id", "a_id").drop("count")
        hit = out["id"].eqNullSafe(a["a_id"]) & (out["digest"] == a["d"])
        twice = out.join(a, hit, "left_semi").withColumn("copy", F.row_number().over(
            Window.partitionBy("id", "digest").orderBy("url")))
        twice = twice.withColumn("refers", F.when(F.col("copy") > 1, F.coalesce(F.col("id").cast("string"), F.lit(""))))
        out = out.join(a, hit, "left_anti").unionByName(twice.drop("copy"))
    return out.drop("digest")


def write_index(folder: str):
    """Task: sorted index lines to one index file of compressed blocks; directory rows."""
    def run(batches):
        uri, sink, offset = name_in(folder, "index"), None, 0
        block: list[str] = []
        first = ""

        def flush():
            nonlocal sink, offset
            if sink is None:
                fs, path = opened(uri)
                sink = fs.open_output_stream(path, compression=None)
            raw = packed("\n".join(block).encode())
            sink.write(raw)
            row = pa.RecordBatch.from_pydict({"first": [first], "file": [uri], "offset": [offset], "length": [len(raw)]})
            offset += len(raw)
            block.clear()
            return row

        for b in batches:
            for key, file, at, n in zip(*(b.column(c).to_pylist() for c in INDEX_COLUMNS)):
                if not block:
                    first = key
                block.append(f"{key}\t{file}\t{at}\t{n}")
                if len(block) >= BLOCK_LINES:
                    yield flush()
        if block:
            yield flush()
        if sink is not None:
            sink.close()
    return run


@dataclass
class Archive:
    """Written archives: ``lines`` (id, key, file, offset, length) and the block ``directory``."""

    lines: DataFrame
    directory: DataFrame


def write_archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> Archive:
    """Writes archives and index of ``pages`` to ``folder`` (one in the shared folder by default)."""
    spark = pages.sparkSession
    ship_package(spark)
    folder = folder or scratch_path(spark)
    make_folder(folder)
    p = pages.select(F.col(id_col).alias("id"), text_or_empty(url_col).alias("url"),
                     text_or_empty(html_col).cast("binary").alias("html"))
    rows = revisits(p).withColumn("page", F.coalesce(F.col("id").cast("string"), F.lit("")))
    kind = p.schema["id"].dataType.simpleString()
    lines = cut_lineage(rows.mapInArrow(write_records(folder), f"key string, file string, offset bigint, "
                                                               f"length bigint, id {kind}"))
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // FILE_LINES))
    by_key = lines.select(*INDEX_COLUMNS).repartitionByRange(files, "key").sortWithinPartitions("key", "file", "offset")
    directory = cut_lineage(by_key.mapInArrow(write_index(folder), "first string, file string, offset bigint, length bigint"))
    return Archive(lines, directory)


def make_folder(uri: str) -> None:
    fs, path = opened(uri)
    fs.create_dir(path, recursive=True)


# --- reading ---------------------------------------------------------------------------------------

def find_lines(lines: list[str], key: str) -> list[list[str]]:
    """The index lines of ``key`` in a block, by binary search."""
    i = bisect.bisect_left(lines, key + "\t")
    out = []
    while i < len(lines) and lines[i].startswith(key + "\t"):
        out.append(lines[i].split("\t"))
        i += 1
    return out


def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
    """Task: sorted look-ups of one index file (left: key) against its directory (right)."""
    rows = sorted(zip(*(right.column(c).to_pylist() for c in ("first", "offset", "length", "file"))))
    firsts = [r[0] for r in rows]
    out = {n: [] for n in ("key", "headers_id", "payload_bytes", "payload_digest", "record_type", "refers", "intact")}
    block, lines, files, archives = -1, [], {}, {}
    for key in sorted(set(left.column("key").to_pylist())) if rows else []:
        # The key may begin in the block before the one whose first key equals it.
        i = max(0, bisect.bisect_left(firsts, key) - 1)
        found = []
        while i < len(rows) and firsts[i] <= key:
            if i != block:
                _, at, n, uri = rows[i]
                block, lines = i, unpacked(read_range(files, uri, at, n)).decode().split("\n")
            found += find_lines(lines, key)
            i += 1
        for _, uri, at, n in found:
            r = parse(unpacked(read_range(archives, uri, int(at), int(n))))
            digest = r.headers["WARC-Payload-Digest"].removeprefix("sha1:")
            size = int(r.http["Content-Length"])
            kind = r.headers["WARC-Type"]
            intact = kind == "revisit" or len(r.payload) == size and hashlib.sha1(r.payload).hexdigest() == digest
            refers = r.headers.get("WARC-Refers-To")
            for name, v in zip(out, (key, r.headers["WARC-Record-ID"], size, digest, kind,
                                     refers and refers.removeprefix("<urn:page:").removesuffix(">"), intact)):
                out[name].append(v)
    return pa.table(out, schema=FOUND)


FOUND = pa.schema([("key", pa.string()), ("headers_id", pa.string()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers", pa.string()),
                   ("intact", pa.bool_())])
FOUND_DDL = ("key string, headers_id string, payload_bytes bigint, payload_digest string, record_type string, "
             "refers string, intact boolean")


def file_of(firsts: list[str], names: list[str]):
    """Task: the index files that may hold each key, by binary search over the files' first keys."""
    def run(batch) -> dict:
        keys, files = [], []
        for k in batch.column("key").to_pylist():
            hi = bisect.bisect_right(firsts, k)
            lo = max(0, bisect.bisect_left(firsts, k) - 1)
            for i in range(lo, hi):
                keys.append(k)
                files.append(names[i])
        return {"key": keys, "file": files}
    return run


def look_ups(archive: Archive, keys: DataFrame) -> DataFrame:
    """The records of ``keys`` (column ``key``), read through the index."""
    uppers = archive.directory.groupBy("file").agg(F.min("first").alias("first")).collect()
    # One row per index file, so as many as the tasks that wrote it: bounded by the partition count.
    uppers.sort(key=lambda r: r["first"])
    firsts, names = [r["first"] for r in uppers], [r["file"] for r in uppers]
    dealt = map_batches(keys.select("key"), file_of(firsts, names), "key string, file string")
    return dealt.groupBy("file").cogroup(archive.directory.groupBy("file")).applyInArrow(look_up, FOUND_DDL)


def read_all(archive: Archive) -> DataFrame:
    """Every record of the archive, read back through the index, as a written table; raises if any
    record that was written is not found, or is found twice."""
    found = cut_lineage(look_ups(archive, archive.lines.select("key").distinct()))
    written, read = archive.lines.count(), found.count()
    if written != read:
        raise RuntimeError(f"{written} records were written and {read} read back")
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = read_all(write_archive(pages))
    kind = pages.schema["page_id"].dataType.simpleString()

    def page(text: Column) -> Column:
        return F.when(text != "", text).cast(kind)

    ident = F.regexp_extract("headers_id", "^<urn:page:(.*)>$", 1)
    return found.select(
        page(ident).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page(F.col("refers")).alias("refers_to"), "intact")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT *, row_number() OVER (PARTITION BY payload_bytes, payload_digest ORDER BY page_id DESC) AS n,
             max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN n > 1 AND payload_bytes >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND payload_bytes >= 1000 THEN last END AS refers_to, true AS intact
FROM g
"""

"""A manifest read straight from directory trees, as a Python data source.

``spark.read.format("snapweave_tree").option("paths", "<json list of roots>").load()``

Why not ``binaryFile``: with recursive lookup it silently drops every name starting with ``_`` or
``.`` and everything inside such folders (``.gitignore``, ``__init__.py``), which a source snapshot
must keep. Here every folder has a row of its own (``is_dir``), so empty folders and links to
folders show; links to folders are not followed; a folder that cannot be listed is shown without
its contents.

Parallelism: the driver lists folders, shallowest first, until there are ``targetPartitions`` input
partitions; what is left is walked whole, one partition per folder. A listed folder with many files
is split by a hash of the name, about ``filesPerPartition`` files each. So one large folder in an
otherwise small tree is opened up without any setting.

Descent stops at folders that the rules ignore (the default patterns, the reserved folder, and the
repository's own two rule files, which the driver reads first): such a folder has its row, what is
below it none, as nothing below an ignored folder is ever shown. Without ``prune`` everything is listed, and the
repository's own rules drop no bytes.

Bytes are read only when they can matter. None are read for paths that the rules drop, nor for
files that are binary by name; of a file that its name does not decide, the first ``SNIFF_BYTES`` are read,
and the rest only if they look like text. The two rule files are always read.

A file is read in chunks of about ``chunkBytes``, a row each (``start`` is the chunk's first byte), which end
after a line feed; so a file has no greatest size and no task holds more than a chunk. In a folder that the
driver lists, a file beyond ``splitBytes`` is several input partitions, each reading the lines that begin
in its share. A single line beyond ``MAX_BYTES`` (Spark's limit for one cell) makes a file unreadable.

Roots must be visible to the executors (a shared file system).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.constants import (BINARY_MIME_PREFIXES, DEFAULT_IGNORE_PATTERNS, DENIED_EXTENSIONS,
                                   GITIGNORE_PATH, KNOWN_TEXT_NAMES, MIME_ALIASES, MIME_ENCODINGS,
                                   MIME_TYPES, READABLE_MIME_PREFIXES, RESERVED_DIR, SNIFF_BYTES,
                                   TEXT_NAME_ENDINGS, TRACK_IGNORE_PATH)
from ..functions.globs import default_rules_regex
from ..operators.rules import compile_plan, parse_rule_file, verdict

SCHEMA = "repo string, path string, start bigint, content binary, size bigint, is_dir boolean"
FORMAT = "snapweave_tree"
MAX_BYTES = (1 << 31) - (1 << 20)


class _Part(InputPartition):
    """Entries of one folder: those of a hash shard, or (``whole``) everything below it; or a ``span`` of
    bytes of one file."""

    def __init__(self, root: str, repo: str, rel: str, whole: bool, rules: str, shard: int = 0, shards: int = 1,
                 span: tuple[int, int] | None = None):
        self.root, self.repo, self.rel = root, repo, rel
        self.whole, self.rules, self.shard, self.shards, self.span = whole, rules, shard, shards, span


def _join(rel: str, name: str) -> str:
    return f"{rel}/{name}" if rel else name


def _listed(folder: str) -> list[os.DirEntry]:
    """Entries by name; none if the folder cannot be listed."""
    try:
        with os.scandir(folder) as it:
            return sorted(it, key=lambda e: e.name)
    except OSError:
        return []


def says_name(name: str) -> str | None:
    """``text`` or ``binary`` where the name decides, as :func:`..operators.classify.name_verdict`."""
    low = name.lower()
    if low in KNOWN_TEXT_NAMES or name.endswith(TEXT_NAME_ENDINGS):
        return "text"
    suffix = re.match(r"(?s).+\.([^.]+)$", name)
    if suffix and suffix[1].lower() in DENIED_EXTENSIONS:
        return "binary"
    stem, ext = os.path.splitext(name)
    aliases = dict(MIME_ALIASES)
    if ext.lower() in aliases:
        ext = aliases[ext.lower()]
    elif ext in MIME_ENCODINGS:
        ext = os.path.splitext(stem)[1]
    mime = _MIME.get(ext.lower(), "")
    if mime.startswith(READABLE_MIME_PREFIXES):
        return "text"
    return "binary" if mime.startswith(BINARY_MIME_PREFIXES) else None


_MIME = dict(MIME_TYPES)


def looks_like_text(head: bytes) -> bool:
    try:
        head.decode()
    except UnicodeDecodeError:
        return False
    return b"\0" not in head


RULE_FILES = (GITIGNORE_PATH, TRACK_IGNORE_PATH)


def own_rules(root: str) -> str:
    """The plan of a repository's own rule files, as :func:`..operators.rules.repo_plans` has it."""
    blocks = []
    for rel in RULE_FILES:
        try:
            with open(os.path.join(root, rel), "rb") as f:
                blocks += parse_rule_file("gitignore" if rel == GITIGNORE_PATH else "track_ignore", f.read())["plan"] or []
        except OSError:
            pass
    return json.dumps(blocks)


class Rules:
    """What is ignored in a repository; nothing is if ``off``."""

    def __init__(self, plan: str, off: bool, folders_as_git: bool):
        self.off, self.folders_as_git = off, folders_as_git
        self.default = re.compile(default_rules_regex(DEFAULT_IGNORE_PATTERNS))
        self.sets = compile_plan(plan)

    def ignore(self, rel: str, is_dir: bool = False) -> bool:
        if self.off:
            return False
        if rel == RESERVED_DIR or rel.startswith(RESERVED_DIR + "/"):
            return True
        seen = rel + "/" if is_dir and self.folders_as_git else rel
        return bool(self.default.match(seen)) or any(verdict(blocks, seen) for _, blocks in self.sets)


def chunks_of(f, size: int, span: tuple[int, int], limit: int):
    """``(start, bytes)`` of the lines that begin in the span; None for bytes of a line too long for a cell."""
    at, end = span
    f.seek(max(0, at - 1))
    if at:
        while (some := f.readline(limit)) and not some.endswith(b"\n"):
            pass
        at = f.tell()
    rest = b""
    while at < end or rest:
        data = rest + f.read(max(0, min(limit, end - at - len(rest))))
        # The line that the chunk ends in is read to its end if it is the span's last or fills the chunk.
        over = at + len(data) >= end
        cut = data.rfind(b"\n") + 1
        if over or not cut:
            if not data.endswith(b"\n"):
                data += f.readline(MAX_BYTES - len(data) + 1)
            if len(data) > MAX_BYTES:
                yield at, None
                return
            cut = len(data)
        if not cut:
            return
        yield at, data[:cut]
        rest, at = data[cut:], at + cut


def read_file(full: str, rel: str, size: int, dropped: bool, span: tuple[int, int] | None, limit: int):
    """``(start, bytes)`` rows of what the manifest needs of a file; None where there is nothing to read."""
    verdict = "text" if dropped is None or rel in RULE_FILES else says_name(rel.rsplit("/", 1)[-1])
    if dropped and rel not in RULE_FILES or verdict == "binary":
        yield 0, None
        return
    try:
        with open(full, "rb") as f:
            if verdict is None and not looks_like_text(head := f.read(SNIFF_BYTES)):
                if not span or not span[0]:
                    yield 0, head
                return
            if not size and not span:
                yield 0, f.read(limit)
            else:
                yield from chunks_of(f, size, span or (0, size), size + 1 if rel in RULE_FILES else limit)
    except OSError:
        yield span[0] if span else 0, None


class TreeReader(DataSourceReader):
    """Options: ``paths`` (JSON list of roots), ``repos`` (JSON list of names, default the folder
    names), ``targetPartitions`` (default 256), ``filesPerPartition`` (default 5,000), ``readAllContent``,
    ``prune`` (default true), ``pruneFolders`` (folders are tested as git does), ``chunkBytes`` (default 64 MB),
    ``splitBytes`` (default 512 MB)."""

    def __init__(self, options):
        self.roots = json.loads(options.get("paths", "[]"))
        names = options.get("repos")
        self.repos = json.loads(names) if names else [
            os.path.basename(os.path.abspath(r).rstrip(os.sep)) for r in self.roots]
        self.read_all = options.get("readAllContent", "false").lower() == "true"
        self.prune = options.get("prune", "true").lower() == "true"
        self.as_git = options.get("pruneFolders", "false").lower() == "true"
        self.target = max(1, int(options.get("targetPartitions", "256")))
        self.files = max(1, int(options.get("filesPerPartition", "5000")))
        self.chunk = max(1, int(options.get("chunkBytes", str(64 << 20))))
        self.split = max(1, int(options.get("splitBytes", str(512 << 20))))

    def descend(self, rules: Rules, rel: str) -> bool:
        return not (self.prune and rules.ignore(rel, True))

    def partitions(self):
        parts: list[_Part] = []
        todo = deque((os.path.abspath(root), repo, "", own_rules(root) if self.prune else "[]") for root, repo in zip(self.roots, self.repos))
        while todo and len(parts) + len(todo) < self.target:
            root, repo, rel, plan = todo.popleft()
            rules = Rules(plan, False, self.as_git)
            here = _listed(os.path.join(root, rel))
            todo += [(root, repo, below, plan) for e in here if e.is_dir(follow_symlinks=False)
                     and self.descend(rules, below := _join(rel, e.name))]
            shards = -(-len(here) // self.files)
            parts += [_Part(root, repo, rel, False, plan, k, shards) for k in range(shards)]
            for e in here:
                size = _size(e)
                if size > self.split and not e.is_dir():
                    parts += [_Part(root, repo, _join(rel, e.name), False, plan, span=(a, min(size, a + self.split)))
                              for a in range(0, size, self.split)]
        return parts + [_Part(root, repo, rel, True, plan) for root, repo, rel, plan in todo]

    def read(self, part: _Part):
        rules = Rules(part.rules, False, self.as_git)
        if part.span:
            full = os.path.join(part.root, part.rel)
            yield from self.rows(part, full, part.rel, os.path.getsize(full), rules)
            return
        todo = [part.rel]
        while todo:
            folder = todo.pop()
            for e in _listed(os.path.join(part.root, folder)):
                rel = _join(folder, e.name)
                if part.shards > 1 and zlib.crc32(rel.encode("utf-8", "surrogateescape")) % part.shards != part.shard:
                    continue
                if e.is_dir():
                    yield (part.repo, rel, 0, None, 0, True)
                    if self.descend(rules, rel):
                        if part.whole and not e.is_symlink():
                            todo.append(rel)
                    elif rel == RESERVED_DIR and not e.is_symlink():
                        yield from self.rule_file(part, rules)
                    continue
                size = _size(e)
                if part.whole or size <= self.split:
                    yield from self.rows(part, e.path, rel, size, rules)

    def rule_file(self, part: _Part, rules: Rules):
        """The one file below the reserved folder that matters."""
        full = os.path.join(part.root, TRACK_IGNORE_PATH)
        if os.path.isfile(full):
            yield from self.rows(part, full, TRACK_IGNORE_PATH, os.path.getsize(full), rules)

    def rows(self, part: _Part, full: str, rel: str, size: int, rules: Rules):
        dropped = None if self.read_all else rules.ignore(rel)
        for start, data in read_file(full, rel, size, dropped, part.span, self.chunk):
            yield (part.repo, rel, start, data, size, False)


def _size(e: os.DirEntry) -> int:
    try:
        return e.stat().st_size
    except OSError:
        return 0


class TreeDataSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


def manifest_from_tree(spark, roots, repos=None, read_all_content: bool = False,
                       target_partitions: int = 256, files_per_partition: int = 5000, prune: bool = True,
                       prune_folders: bool = False, chunk_bytes: int = 64 << 20, split_bytes: int = 512 << 20):
    """A chunked manifest (:mod:`..operators.chunks`) of the files and folders below the given roots (one
    repository per root). ``prune_folders`` as in :class:`..options.Options`; ``prune=False`` lists what is
    below ignored folders, too."""
    from ..session import ship_package
    ship_package(spark)
    spark.dataSource.register(TreeDataSource)
    r = spark.read.format(FORMAT).option("paths", json.dumps([str(x) for x in roots]))
    if repos is not None:
        r = r.option("repos", json.dumps(list(repos)))
    return (r.option("readAllContent", str(read_all_content).lower())
            .option("targetPartitions", str(target_partitions))
            .option("filesPerPartition", str(files_per_partition))
            .option("prune", str(prune).lower()).option("pruneFolders", str(prune_folders).lower())
            .option("chunkBytes", str(chunk_bytes)).option("splitBytes", str(split_bytes)).load())

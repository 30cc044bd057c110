"""Phrase collocations from count streams in prefix and suffix order.

A phrase of 2 to 5 words is a candidate if it occurs often enough; it is scored at its weakest cut by how
much more often it occurs than its two parts would together by chance.

1. Chunks. Tasks turn texts into streams of word places, ``CHUNK`` words or more each (whole documents of one
   language; a break after each piece), written once beside the chunk's sorted list of words with their counts.
2. Orders. A chunk sends each bucket of words (by a hash of the word) one packed run of its distinct
   words and counts. A task merges the runs of a bucket, numbers the words that are frequent, and answers
   each chunk with the numbers of its own. The chunk pairs neighbouring frequent words; an m-gram is
   named by the numbers of its first and of its last m-1 words, so a phrase is counted only where both of
   these are frequent (a phrase is never more frequent than its parts, so none is lost). Pairs go the same
   way, runs sorted in prefix order and merged by sorting; neighbouring frequent bigrams make trigrams,
   and so on. Streams shrink with each order.
3. Lockstep merge. The frequent phrases of all orders are one count stream. Phrases with each of their
   cuts meet it in prefix order (first part: left counts) and in suffix order (rest: right counts) as
   sort-merge joins; an order's links to the one before, again merged, give the most frequent
   extension by one word, which decides containment: a longer phrase that is as frequent as a part of
   it makes every phrase between them as frequent.
4. Scores are whole numbers from decimals of 38 digits.

Growth: streams and runs grow with the corpus; nothing is broadcast by this module and the driver gets
one sum for each order. A task holds a chunk with its words, or a bucket of about ``BUCKET`` pairs; a pair
that fills the corpus is one entry of each chunk's run. There are chunks times buckets of runs, but
never more than distinct pairs of chunks. Counts per language and extension are partial
aggregates; the rank limit of a language applies before its shuffle.

Defined cases: null and empty texts have no words; a null language counts as ``und``; ids do not matter and
repeated rows count as often as they occur; equal scores go by count, then by the phrase's bytes; a
document longer than a chunk is a chunk of its own; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut_lineage, drop_table, ship_package
from .common import mixed, table

LEAST, LONGEST, TOP = 100, 5, 2000
#: Words of a chunk, bytes of text that are split at once.
CHUNK, SLICE = 1_000_000, 1 << 22
#: Chunks' worth of words that a task holds of all languages.
HELD = 4
#: Words or pairs of all chunks that a task merges.
BUCKET = 1_000_000
BREAK = b"\xff"  # no byte of UTF-8
MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)

CHUNKS = "chunk bigint, lang string, size bigint, entries bigint, stream binary, words binary, counts binary"
WORD_RUNS = "bucket bigint, chunk bigint, lang string, words binary, data binary"
WORD_COUNTS = "chunk bigint, data binary, lang string, number bigint, word binary, f bigint"
PAIRS = "chunk bigint, bucket bigint, data binary"
COUNTS = "chunk bigint, data binary, number bigint, first bigint, last bigint, f bigint"


# --- chunks ------------------------------------------------------------------------------------

def tokens(text: bytes):
    """Lists of words and breaks of a text, in slices that end between words."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            # The word that the slice cuts goes to the next one, whole.
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\t", at, end), text.rfind(b"\n", at, end))
            end = cut + 1 if cut >= at else min((p for p in (text.find(c, end) for c in (b" ", b"\t", b"\n")) if p >= 0),
                                                default=len(text))
        yield text[at:end].lower().translate(MARKS).replace(BREAK, b" \xff ").split()
        at = end
    yield [BREAK]


class Chunk:
    """The words of one language as dictionary-encoded runs."""

    def __init__(self):
        self.runs, self.words = [], 0

    def add(self, text: bytes) -> None:
        for some in tokens(text):
            self.runs.append(pa.array(some, pa.binary()).dictionary_encode())
            self.words += len(some)

    def row(self, chunk: int, lang: str) -> dict:
        runs = pa.chunked_array(self.runs).unify_dictionaries()
        words = np.array(runs.chunk(0).dictionary.to_pylist(), object)
        local = np.concatenate([c.indices.to_numpy() for c in runs.chunks])
        counts = np.bincount(local, minlength=len(words))
        counts[words == BREAK] = -1
        # Frequent words have small places, the break the last one.
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        stream = place[local]
        stream[stream == len(words) - 1] = -1
        words, counts = words[order[:-1]], counts[order[:-1]]
        ranked = words.argsort()
        return {"chunk": chunk, "lang": lang, "size": int(counts.sum()), "entries": len(words),
                "stream": packed(squeezed(stream)), "words": joined(words[ranked]),
                "counts": packed(ranked, counts[ranked])}


def squeezed(stream: np.ndarray) -> np.ndarray:
    """Breaks in a row say no more than one."""
    keep = stream >= 0
    keep[1:] |= stream[:-1] >= 0
    return stream[keep]


def joined(words) -> bytes:
    """Words in order, compressed; no word holds a line feed."""
    return zstandard.compress(b"\n".join(words), 1)


def packed(*columns: np.ndarray) -> bytes:
    """Equally long columns of whole numbers, compressed by bytes of equal weight."""
    whole = np.stack([c.astype(np.int64) for c in columns])
    return zstandard.compress(whole.reshape(-1, 1).view(np.uint8).T.tobytes(), 1)


def unpacked(data: bytes, columns: int) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T.copy().view("<i8")
    return flat.reshape(columns, -1)


def steps(rising: np.ndarray) -> np.ndarray:
    """The differences of sorted numbers, which pack better; sums restore them."""
    return np.diff(rising, prepend=0)


def chunked(docs: DataFrame, text_col: str, lang_col: str, size: int = CHUNK) -> DataFrame:
    """All chunks: streams, lists of words, and counts, columns as ``CHUNKS``."""
    schema = to_arrow_schema(StructType.fromDDL(CHUNKS))

    def run(batches):
        task, number, open_chunks, held = TaskContext.get().partitionId(), 0, {}, 0

        def flushed(lang: str):
            nonlocal number, held
            chunk = open_chunks.pop(lang)
            held -= chunk.words
            number += 1
            return pa.RecordBatch.from_pylist([chunk.row(task << 32 | number, lang)], schema=schema)

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("t")):
                chunk = open_chunks.setdefault(lang, Chunk())
                held -= chunk.words
                chunk.add(text.as_py())
                held += chunk.words
                if chunk.words >= size:
                    yield flushed(lang)
                while held >= HELD * size:  # many languages: the largest goes
                    yield flushed(max(open_chunks, key=lambda x: open_chunks[x].words))
        for lang in list(open_chunks):
            yield flushed(lang)

    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("t"))
    return rows.filter("t IS NOT NULL").mapInArrow(run, CHUNKS)


# --- orders ------------------------------------------------------------------------------------

def runs_of(buckets: np.ndarray):
    """``(bucket, its entries)`` of each bucket that has some, entries in order."""
    order = np.argsort(buckets, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(buckets[order])) + 1):
        if len(some):
            yield int(buckets[some[0]]), some


def word_runs(chunks: DataFrame, buckets: int) -> DataFrame:
    """The words of each chunk as a run ``(bucket, chunk, lang, words, data)`` for each bucket."""
    schema = to_arrow_schema(StructType.fromDDL(WORD_RUNS))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                words = zstandard.decompress(r["words"]).split(b"\n") if r["entries"] else []
                local, n = unpacked(r["counts"], 2)
                of = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
                rows = [{"bucket": bucket, "chunk": r["chunk"], "lang": r["lang"], "words": joined([words[i] for i in some]),
                         "data": packed(local[some], n[some])} for bucket, some in runs_of(of)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return chunks.select("chunk", "lang", "entries", "words", "counts").mapInArrow(run, WORD_RUNS)


def counted_words(rows: list[dict], least: int) -> list[dict]:
    """All words of a bucket: those that are frequent with their numbers, and for each chunk the numbers of
    those it holds."""
    out, told, number = [], [], rows[0]["bucket"] << 32
    for lang in sorted({r["lang"] for r in rows}):
        some = [r for r in rows if r["lang"] == lang]
        lists = [zstandard.decompress(r["words"]).split(b"\n") for r in some]
        words = pa.chunked_array([pa.array(x, pa.binary()) for x in lists]).combine_chunks().dictionary_encode()
        at = words.indices.to_numpy()
        local, n = np.concatenate([unpacked(r["data"], 2) for r in some], axis=1)
        sums = np.zeros(len(words.dictionary), np.int64)
        np.add.at(sums, at, n)
        often = np.flatnonzero(sums >= least)
        numbers = np.full(len(sums), -1, np.int64)
        numbers[often] = number + np.arange(len(often))
        number += len(often)
        out += [{"lang": lang, "word": w, "number": k, "f": f} for w, k, f in zip(
            words.dictionary.take(pa.array(often)).to_pylist(), numbers[often].tolist(), sums[often].tolist())]
        ends = np.cumsum([len(x) for x in lists])
        for r, a, b in zip(some, ends - [len(x) for x in lists], ends):
            mine = numbers[at[a:b]]
            told.append({"chunk": r["chunk"], "data": packed(local[a:b][mine >= 0], mine[mine >= 0])})
    return out + told


def paired(chunk: int, stream: np.ndarray, local: np.ndarray, numbers: np.ndarray, buckets: int) -> list[dict]:
    """The next order of a chunk: its stream, and its distinct pairs with their counts for each bucket.
    ``local`` and ``numbers``: places in the chunk's list and numbers of the entries that are frequent."""
    number = np.sort(numbers)
    place = np.full(max(int(stream.max(initial=0)), int(local.max(initial=0))) + 2, -1, np.int64)
    place[local] = np.searchsorted(number, numbers)
    now = place[stream]  # the last place is that of breaks (-1) and stays -1
    both = (now[:-1] >= 0) & (now[1:] >= 0)
    pair, at, counts = np.unique(now[:-1][both] * len(number) + now[1:][both], return_inverse=True, return_counts=True)
    follow = np.full(len(both), -1, np.int64)
    follow[both] = at
    first, last = number[pair // max(1, len(number))], number[pair % max(1, len(number))]
    bucket = (mixed(mixed(first) + last.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    out = [{"chunk": chunk, "bucket": None, "data": packed(squeezed(follow))}]
    return out + [{"chunk": chunk, "bucket": b, "data": packed(steps(first[some]), steps(some), last[some], counts[some])}
                  for b, some in runs_of(bucket)]


def counted(bucket: int, chunks: list[int], data: list[bytes], least: int) -> list[dict]:
    """All pairs of a bucket, merged in prefix order: the frequent ones with their numbers, and for each
    chunk the numbers of those it holds."""
    runs = [unpacked(d, 4) for d in data]
    first, local = (np.concatenate([r[i].cumsum() for r in runs]) for i in (0, 1))
    last, n = (np.concatenate([r[i] for r in runs]) for i in (2, 3))
    of = np.repeat(np.arange(len(runs)), [r.shape[1] for r in runs])
    order = np.lexsort((last, first))
    first, last = first[order], last[order]
    new = np.ones(len(order), bool)
    new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(n[order], starts)
    often = sums >= least
    number = np.where(often, np.cumsum(often) - 1 + (bucket << 32), -1)
    out = [{"first": first[starts[often]], "last": last[starts[often]], "number": number[often], "f": sums[often]}]
    each = np.empty(len(order), np.int64)
    each[order] = np.repeat(number, np.diff(np.append(starts, len(order))))
    told = np.flatnonzero(each >= 0)
    return out + [{"chunk": chunks[run], "data": packed(local[told[some]], each[told[some]])} for run, some in runs_of(of[told])]


def next_pairs(streams: DataFrame, numbers: DataFrame, tasks: int, buckets: int) -> DataFrame:
    """``(chunk, bucket, data)``: streams (no bucket) and pairs of the next order. ``streams``, ``numbers``:
    ``(chunk, data)``."""
    schema = to_arrow_schema(StructType.fromDDL(PAIRS))

    def run(stream: pa.Table, told: pa.Table) -> pa.Table:
        if not (stream.num_rows and told.num_rows):
            return schema.empty_table()
        local, number = np.concatenate([unpacked(d, 2) for d in told["data"].to_pylist()], axis=1)
        return pa.Table.from_pylist(paired(stream["of"][0].as_py(), unpacked(stream["data"][0].as_py(), 1)[0], local, number,
                                           buckets), schema=schema)

    return streams.withColumnRenamed("chunk", "of").repartition(tasks, "of").groupBy("of").cogroup(
        numbers.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(run, PAIRS)


def next_counts(pairs: DataFrame, tasks: int, least: int) -> DataFrame:
    """Frequent pairs ``(number, first, last, f)`` and answers to chunks ``(chunk, data)``, as one table."""
    schema = to_arrow_schema(StructType.fromDDL(COUNTS))

    def run(group: pa.Table) -> pa.Table:
        found, *answers = counted(group["bucket"][0].as_py(), group["chunk"].to_pylist(), group["data"].to_pylist(), least)
        n = len(found["f"])
        rows = pa.table([pa.array(found[f.name], f.type) if f.name in found else pa.nulls(n, f.type) for f in schema],
                        schema=schema)
        return pa.concat_tables([rows, pa.Table.from_pylist(answers, schema=schema)])

    asked = pairs.filter("bucket IS NOT NULL")
    return asked.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(run, COUNTS)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                  longest: int = LONGEST, chunk: int = CHUNK, bucket: int = BUCKET) -> tuple[DataFrame, list[DataFrame]]:
    """``(lang, n)``, and for each order a written table of its frequent phrases: ``lang, number, phrase, end``
    (its last word), ``f``, and from order 2 on ``first`` and ``last``, the numbers of the phrases
    without the last and without the first word."""
    spark = docs.sparkSession
    ship_package(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    chunks = cut_lineage(chunked(docs, text_col, lang_col, chunk))
    sizes = cut_lineage(chunks.groupBy("lang").agg(F.sum("size").alias("n")))
    buckets = -(-(chunks.agg(F.sum("entries")).first()[0] or 1) // bucket)
    schema = to_arrow_schema(StructType.fromDDL(WORD_COUNTS))

    def run(group: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(counted_words(group.to_pylist(), least), schema=schema)

    counts = cut_lineage(word_runs(chunks, buckets).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(run, WORD_COUNTS))
    word = F.col("word").cast("string")
    orders = [cut_lineage(counts.filter("f IS NOT NULL").select("lang", "number", word.alias("phrase"), word.alias("end"), "f"))]
    streams = chunks.select("chunk", F.col("stream").alias("data"))
    numbers = counts.filter("data IS NOT NULL").select("chunk", "data")
    used = [chunks, counts]
    for _ in range(longest - 1):
        # A pair for each occurrence of a frequent phrase at most.
        places = orders[-1].agg(F.sum("f")).first()[0] or 0
        pairs = cut_lineage(next_pairs(streams, numbers, tasks, max(1, -(-places // bucket))))
        found = cut_lineage(next_counts(pairs, tasks, least))
        for before in used:
            drop_table(before)
        used = [pairs, found]
        streams = pairs.filter("bucket IS NULL").select("chunk", "data")
        numbers = found.filter("data IS NOT NULL").select("chunk", "data")
        shorter = orders[-1]
        first = shorter.select("lang", F.col("number").alias("first"), F.col("phrase").alias("start"))
        last = shorter.select(F.col("number").alias("last"), "end")
        named = found.filter("f IS NOT NULL").join(first, "first").join(last, "last")
        orders.append(cut_lineage(named.select("lang", "number", F.concat_ws(" ", "start", "end").alias("phrase"), "end", "f",
                                               "first", "last")))
    for before in used:
        drop_table(before)
    return sizes, orders


# --- left, right and extension counts ----------------------------------------------------------

def merged(phrases: DataFrame, stream: DataFrame, key: str) -> DataFrame:
    """Sort-merge join of ``phrases`` with the count stream of all parts, both in order of ``key``."""
    return phrases.join(stream.hint("merge"), ["lang", key])


def cuts(orders: list[DataFrame]) -> DataFrame:
    """``(lang, phrase, a, k, l, r)`` of every cut of every phrase of two words or more."""
    every = orders[0].select("lang", "phrase", "f")
    whole = None
    for m, order in enumerate(orders[1:], 2):
        if m <= len(orders) - 1:
            every = every.unionByName(order.select("lang", "phrase", "f"))
        some = order.select("lang", "phrase", F.col("f").alias("a"))
        whole = some if whole is None else whole.unionByName(some)
    words = whole.withColumn("w", F.split("phrase", " "))
    each = words.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    parts = each.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"),
                        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    lefts = merged(parts, every.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), "left")
    both = merged(lefts, every.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), "right")
    return both.select("lang", "phrase", "a", "k", "l", "r")


def maximal(orders: list[DataFrame]) -> DataFrame:
    """``(lang, phrase)`` of the phrases of two words or more with no extension that is as frequent."""
    kept = None
    for order, longer in zip(orders[1:], orders[2:] + [None]):
        some = order.select("lang", "phrase", "number", "f")
        if longer is not None:
            ways = longer.select(F.explode(F.array("first", "last")).alias("number"), F.col("f").alias("more"))
            most = ways.groupBy("number").agg(F.max("more").alias("more"))
            some = some.join(most.hint("merge"), "number", "left").filter("more IS NULL OR 100 * more < 100 * f")
        some = some.select("lang", "phrase")
        kept = some if kept is None else kept.unionByName(some)
    return kept


def score(a, n, left, right):
    """``floor(1000 * a * n / (left * right))``, exact."""
    big = "decimal(18,0)"
    of = (F.lit(1000).cast("decimal(4,0)") * a.cast("decimal(15,0)") * n.cast(big)).cast("decimal(38,0)")
    return F.call_function("div", of, (left.cast(big) * right.cast(big)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                 longest: int = LONGEST, top: int = TOP, chunk: int = CHUNK) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    sizes, orders = phrase_counts(docs, text_col, lang_col, least, longest, chunk)
    scored = cuts(orders).join(sizes, "lang").withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    kept = weakest.join(maximal(orders).hint("merge"), ["lang", "phrase"], "left_semi")
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, pid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM lists),
sizes AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
windows AS (
    SELECT lang, word AS w1, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3, lead(word, 3) OVER p AS w4,
           lead(word, 4) OVER p AS w5 FROM words WINDOW p AS (PARTITION BY pid ORDER BY i)),
grams AS (
    SELECT lang, w1 AS phrase, 1 AS m FROM windows
    UNION ALL SELECT lang, w1 || ' ' || w2, 2 FROM windows WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3 FROM windows WHERE w3 IS NOT NULL
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 4 FROM windows WHERE w4 IS NOT NULL
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, 5 FROM windows WHERE w5 IS NOT NULL),
counts AS (SELECT lang, phrase, m, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
parts AS (
    SELECT lang, phrase, f AS a, m, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS lhs,
           array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rhs
    FROM (SELECT *, unnest(range(1, m)) AS k FROM counts WHERE m > 1)),
scored AS (
    SELECT p.lang, p.phrase, p.m, a, n, k, x.f AS l, y.f AS r, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM parts p JOIN counts x ON p.lang = x.lang AND p.lhs = x.phrase JOIN counts y ON p.lang = y.lang AND p.rhs = y.phrase
    JOIN sizes s ON p.lang = s.lang),
weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
    SELECT * FROM weakest w WHERE NOT EXISTS (
        SELECT 1 FROM counts c WHERE c.lang = w.lang AND c.m > w.m AND 100 * c.f >= 100 * w.a
        AND contains(' ' || c.phrase || ' ', ' ' || w.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
WHERE rank <= 2000
"""

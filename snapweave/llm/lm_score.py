"""Language-model scores by deleted interpolation.

The model is a word bigram whose maximum-likelihood estimates are mixed,

    P(w | v) = l2[b] * c(v, w) / c(v) + l1[b] * c(w) / N + l0[b] / (V + 1),

with weights by context-frequency bucket ``b`` (the octave of ``c(v)``; bucket 0 is an unseen
context, which has no bigram part). The weights are learned by expectation-maximisation on
held-out counts: of the training documents, one part (remainder 0) is deleted from the counts and
supplies the events, the others supply the estimates. The scores then use the counts of all training
documents. Every document is closed by an end token and starts from a start context, whose
count is that of the end token.

Counts grow with the corpus and never meet in one place. Documents are dealt to splits by a hash of
id and text. A split asks for the counts of its distinct words and bigrams once, as sorted 64-bit
hashes packed by hash range; a bucket of hash ranges adds up what all splits report and answers each
in the order of its question; split and answers meet again and every token's counts are at hand. So
the shuffles hold one entry per distinct bigram of a split (not per token), a frequent word is one
entry per split, and no count table is joined, broadcast or collected. The driver sees only totals
and the histogram of held-out events on a fixed grid (at most ``CELLS`` rows).

Words and bigrams are told apart by 64-bit hashes.

Defined cases: null text counts as empty (one end token); a null id counts as the empty text, so it
is a training document; repeated rows are counted and scored one by one; without training documents
every probability is 1; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_table, ship_package
from .common import table, text_or_empty

#: Characters of a split, and the least number of splits.
SPLIT_CHARS, LEAST_SPLITS = 8_000_000, 12
FOLDS, HELD_OUT, DELETED = 5, 1, 0
BUCKETS, OCTAVE_PARTS, SPAN = 32, 4, 64
CELLS = BUCKETS * (OCTAVE_PARTS * SPAN) ** 2
EM_ROUNDS, LEAST_WEIGHT = 60, 1e-9
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
WORD, PAIR = 0, 1


# --- packed arrays -------------------------------------------------------------------------------

def planes(a: np.ndarray) -> bytes:
    """The bytes of an integer array, all first bytes first: high planes are zeros and compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def from_planes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, "<u8"), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return planes(counts.astype("<u8"))


def unpack_counts(raw: bytes) -> np.ndarray:
    return from_planes(raw, "<u8").astype(np.int64)


# --- tokens of a split -----------------------------------------------------------------------------

class Numbers(dict):
    """Words by first appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokens:
    """The tokens of a split's documents: ``ends[i]`` is where document ``i`` ends; ``word`` and
    ``pair`` number each token in the sorted distinct hashes ``words`` and ``pairs``; ``context``
    numbers its context in ``words``."""

    def __init__(self, texts: list[bytes]):
        numbers = Numbers({b"\n": 0})  # the end token; no word holds white space
        parts, sizes = [], []
        for t in texts:
            w = t.lower().split()
            w.append(b"\n")
            parts.append(np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)))
            sizes.append(len(w))
        token = np.concatenate(parts) if parts else np.empty(0, np.int32)
        del parts
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
        hashes[0] = END
        del numbers
        self.words, place = np.unique(hashes, return_inverse=True)
        place = place.astype(np.int32)
        self.ends = np.cumsum(np.array(sizes, np.int64))
        self.word = place[token]
        del token
        end = place[0]
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[:1] = end  # the start context is counted by the end token
        keys = np.where(self.context == end, START, self.words[self.context])
        keys *= np.uint64(0x9FB21C651E98DF25)
        keys += self.words[self.word]
        keys = spread(keys)
        # Sorted by hand: np.unique would hold several arrays of 64-bit places at once.
        order = np.argsort(keys)
        keys = keys[order]
        new = np.empty(len(keys), bool)
        new[:1] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        self.pairs = keys[new]
        del keys
        self.pair = np.empty(len(order), np.int32)
        self.pair[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)

    def tokens_of(self, documents: np.ndarray) -> np.ndarray:
        """A flag per token: does it belong to a flagged document?"""
        return np.repeat(documents, np.diff(self.ends, prepend=0))


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal hash ranges ends in sorted ``keys``."""
    edges = [(i << 64) // buckets for i in range(1, buckets)]
    return np.concatenate([np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)


ASKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("split", pa.int32()), ("deleted", pa.bool_()),
                   ("keys", pa.binary()), ("counts", pa.binary())])
ASKED_DDL = "kind int, bucket int, split int, deleted boolean, keys binary, counts binary"


def ask(buckets: int):
    """Task: the documents of a split to its questions, with its own training counts."""
    def run(group: pa.Table) -> pa.Table:
        t = Tokens(group.column("t").to_pylist())
        rest = group.column("rest").to_numpy()
        train = t.tokens_of(rest != HELD_OUT)
        rows = {n: [] for n in ASKED.names}
        for kind, keys, at in ((WORD, t.words, t.word), (PAIR, t.pairs, t.pair)):
            counts = np.bincount(at[train], minlength=len(keys))
            a = 0
            for bucket, b in enumerate(bucket_bounds(keys, buckets).tolist()):
                if b > a:
                    for n, v in zip(rows, (kind, bucket, group.column("split")[0].as_py(), bool(rest[0] == DELETED),
                                           pack_keys(keys[a:b]), pack_counts(counts[a:b]))):
                        rows[n].append(v)
                a = b
        return pa.table(rows, schema=ASKED)
    return run


ANSWERED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("split", pa.int32()), ("train", pa.binary()),
                      ("core", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64()), ("core_types", pa.int64()),
                      ("core_tokens", pa.int64())])
ANSWERED_DDL = ("kind int, bucket int, split int, train binary, core binary, types bigint, tokens bigint, "
                "core_types bigint, core_tokens bigint")


def answer(group: pa.Table) -> pa.Table:
    """Task: all questions of one hash range to answers in their order; one row of totals."""
    asked = sorted(zip(*(group.column(c).to_pylist() for c in ("split", "deleted", "keys", "counts"))))
    keys = [unpack_keys(k) for _, _, k, _ in asked]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([unpack_counts(c) for _, _, _, c in asked])
    mine = np.repeat([d for _, d, _, _ in asked], [len(k) for k in keys])
    train = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    core = np.bincount(at, weights=np.where(mine, 0, counts), minlength=len(distinct)).astype(np.int64)
    kind, bucket = group.column("kind")[0].as_py(), group.column("bucket")[0].as_py()
    rows = {n: [] for n in ANSWERED.names}

    def add(*values):
        for n, v in zip(rows, (kind, bucket, *values)):
            rows[n].append(v)

    add(-1, b"", b"", int((train > 0).sum()), int(train.sum()), int((core > 0).sum()), int(core.sum()))
    a = 0
    for (split, deleted, _, _), k in zip(asked, keys):
        part = at[a:a + len(k)]
        add(split, pack_counts(train[part]), pack_counts(core[part]) if deleted else b"", 0, 0, 0, 0)
        a += len(k)
    return pa.table(rows, schema=ANSWERED)


class Counts:
    """A split's tokens with the counts that were answered (column ``train`` or ``core``)."""

    def __init__(self, docs: pa.Table, answers: pa.Table, column: str):
        self.tokens = t = Tokens(docs.column("t").to_pylist())
        by = {WORD: [], PAIR: []}
        rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", column))))
        for kind, _, raw in rows:
            by[kind].append(unpack_counts(raw))
        word, pair = (np.concatenate(by[k]) for k in (WORD, PAIR))
        self.word, self.context, self.pair = word[t.word], word[t.context], pair[t.pair]

    def bucket(self) -> np.ndarray:
        return np.minimum(np.where(self.context > 0, np.log2(np.maximum(self.context, 1)).astype(np.int64) + 1, 0), BUCKETS - 1)

    def shares(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Maximum-likelihood estimates of the bigram and the unigram."""
        return self.pair / np.maximum(self.context, 1), self.word / max(n, 1)


# --- weights -------------------------------------------------------------------------------------

def events(types: int, tokens: int):
    """Task: the events of a split of deleted documents on the grid of their estimates."""
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.table({n: [] for n in ("bucket", "cell", "n", "s2", "s1")}, schema=EVENTS)
        c = Counts(docs, answers, "core")
        p2, p1 = c.shares(tokens)
        r2, r1 = p2 * (types + 1), p1 * (types + 1)

        def step(r):
            with np.errstate(divide="ignore"):
                i = np.floor(np.log2(r) * OCTAVE_PARTS) + OCTAVE_PARTS * SPAN // 2
            return np.where(r > 0, np.clip(i, 1, OCTAVE_PARTS * SPAN - 1), 0).astype(np.int64)

        cell = (c.bucket() * (OCTAVE_PARTS * SPAN) + step(r2)) * (OCTAVE_PARTS * SPAN) + step(r1)
        cells, at = np.unique(cell, return_inverse=True)
        return pa.table({"bucket": cells // (OCTAVE_PARTS * SPAN) ** 2, "cell": cells, "n": np.bincount(at),
                         "s2": np.bincount(at, weights=r2), "s1": np.bincount(at, weights=r1)}, schema=EVENTS)
    return run


EVENTS = pa.schema([("bucket", pa.int64()), ("cell", pa.int64()), ("n", pa.int64()), ("s2", pa.float64()), ("s1", pa.float64())])
EVENTS_DDL = "bucket bigint, cell bigint, n bigint, s2 double, s1 double"


def em(n: np.ndarray, r2: np.ndarray, r1: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights ``(l2, l1, l0)`` of the greatest likelihood of events that occur ``n`` times and have
    bigram and unigram estimates ``r2`` and ``r1`` in units of the uniform one."""
    estimates = np.stack([r2, r1, np.ones_like(r1)])
    w = np.full(3, 1 / 3)
    for _ in range(rounds):
        part = w[:, None] * estimates
        w = (n * part / part.sum(axis=0)).sum(axis=1)
        w /= w.sum()
    return w


def weights(rows: list, rounds: int = EM_ROUNDS) -> np.ndarray:
    """One row of weights per bucket; a bucket without events has those of all events."""
    out = np.tile(np.array([0.0, 0.0, 1.0]), (BUCKETS, 1))
    if rows:
        b, n, s2, s1 = (np.array([r[c] for r in rows], float) for c in ("bucket", "n", "s2", "s1"))
        r2, r1 = s2 / n, s1 / n
        out[:] = em(n, r2, r1, rounds)
        for k in np.unique(b).astype(int):
            at = b == k
            out[k] = em(n[at], r2[at], r1[at], rounds)
    out[0, 0] = 0.0
    out = np.maximum(out, [0.0, LEAST_WEIGHT, LEAST_WEIGHT])
    return out / out.sum(axis=1, keepdims=True)


# --- scores --------------------------------------------------------------------------------------

def score_split(mix: np.ndarray, types: int, tokens: int):
    """Task: the scores of a split's documents."""
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        c = Counts(docs, answers, "train")
        p2, p1 = c.shares(tokens)
        l2, l1, l0 = mix[c.bucket()].T
        model = np.log10(l2 * p2 + l1 * p1 + l0 / (types + 1)) if tokens else np.zeros(len(p1))
        base = np.log10((c.word + 0.5) / (tokens + 0.5 * (types + 1)))
        starts = np.concatenate([[0], c.tokens.ends[:-1]])
        return pa.table({
            "id": docs.column("id"), "held_out": pa.array(docs.column("rest").to_numpy() == HELD_OUT),
            "n_tokens": c.tokens.ends - starts, "n_known": np.add.reduceat((c.word > 0).astype(np.int64), starts),
            "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(model, starts)})
    return run


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split_chars: int = SPLIT_CHARS,
           least_splits: int = LEAST_SPLITS) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship_package(spark)
    d = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    size = d.agg(F.sum(F.length("text"))).first()[0] or 0
    many = max(least_splits, -(-size // split_chars))
    few = -(-many // FOLDS)  # the deleted documents have splits of their own
    place = F.xxhash64("id", "text")
    rest = remainder(F.col("id"))
    d = d.select("id", rest.alias("rest"), F.when(rest == DELETED, many + F.pmod(place, F.lit(few)))
                 .otherwise(F.pmod(place, F.lit(many))).cast("int").alias("split"), F.col("text").cast("binary").alias("t"))
    asked = d.groupBy("split").applyInArrow(ask(many), ASKED_DDL)
    answers = cut_lineage(asked.groupBy("kind", "bucket").applyInArrow(answer, ANSWERED_DDL))
    totals = answers.filter((F.col("split") < 0) & (F.col("kind") == WORD)).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "tokens", "core_types", "core_tokens")]).first()
    told = answers.filter("split >= 0").select("kind", "bucket", "split", "train", "core")
    deleted = F.col("split") >= many
    found = d.filter(deleted).groupBy("split").cogroup(told.filter(deleted).groupBy("split")).applyInArrow(
        events(totals["core_types"], totals["core_tokens"]), EVENTS_DDL)
    grid = cut_lineage(found.groupBy("bucket", "cell").agg(*[F.sum(c).alias(c) for c in ("n", "s2", "s1")]))
    mix = weights(grid.orderBy("cell").collect())
    drop_table(grid)
    kind = docs.schema[id_col].dataType.simpleString()
    out = d.groupBy("split").cogroup(told.select("kind", "bucket", "split", "train").groupBy("split")).applyInArrow(
        score_split(mix, totals["types"], totals["tokens"]),
        f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(totals["tokens"]).cast("bigint").alias("train_tokens"),
                      "base_score", "score")


def query(spark, sf_dir):
    return scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

"""Best-fit packing of tokenised documents by a configuration linear program.

1. Tokens. Documents become token ids in tasks, are cut only where longer than a sequence, and leave
   as one row of numbers per piece (no text and no ids are shuffled). The tokenizer drops white
   space, so the ids of a text are those of its white-space separated words in order; each task keeps
   the ids of the words it has met (at most ``CACHE`` of them) and encodes only new ones.
2. Histogram. Only the number of pieces of each length goes to the driver: at most ``capacity``
   rows, whatever the input.
3. Linear program. A configuration is a multiset of lengths that fits one sequence. In rounds,
   multiplicative weights price the lengths by how far they are still uncovered; a knapsack dynamic program
   over the capacity finds the configurations of the highest price through the longest open lengths;
   each is used until one of its lengths is covered. A phase covers all demand with about one configuration a
   length, whatever the input. Prices also prove a bound on any packing (the program's dual, by the same
   knapsack); phases are repeated, with lengths that left room priced up, until the number is within ``GAP``
   of the bound, or ``PHASES`` times; the best one counts.
4. Rounding. Each configuration is used as many whole times as its share says; what remains is packed
   best-fit decreasing, by counts, into the room that is left and then into new sequences. If best-fit
   decreasing of everything needs fewer sequences, its plan is taken: the result is never worse.
5. Assignment. The plan says for each length which ranks go to which sequences at which offset. Pieces
   are ranked within their length in two levels (salted groups of about ``GROUP``, and running sums
   over groups), so that a length that a third of the pieces have is never one task's, and each
   finds its place in the plan by binary search. The plan's size is bounded by the configurations.

Defined cases: null text counts as empty (one piece of the end id); empty texts and repeated rows are
packed like any other; null ids pass through; an empty table gives no rows; other columns do not
matter.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import map_batches, table, text_or_empty

CAPACITY, END_ID = 2048, 0
CACHE = 1_000_000
GROUP = 2_048
ANCHORS, RATE = 16, 1.0
#: The linear program ends within this of its bound, or after so many phases.
GAP, PHASES = 0.001, 8


# --- tokens ------------------------------------------------------------------------------------

#: The tokenizer's own rules, which :func:`words_of` and the table of words rely on.
EXPECTED = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


@lru_cache(maxsize=1)
def tokenizer(path: str):
    from tokenizers import Tokenizer
    found = Tokenizer.from_file(path)
    rules = json.loads(found.to_str())
    if any(rules[part] != rule for part, rule in EXPECTED.items()):
        raise ValueError(f"{path}: words are split here as by a lower-casing tokenizer that drops white space; its rules differ")
    return found


#: A full stop or comma between an ASCII letter and the end of a word is a token of its own, so it may
#: be split off beforehand; that halves the number of different words.
TAIL = re.compile(rb"(?<=[a-z])([.,])(?=[ \n]|$)")


def words_of(text: bytes) -> list[bytes]:
    """The white-space separated words, ASCII letters lower-cased as the tokenizer would; a text
    that may hold one of the tokenizer's special strings keeps its case."""
    return text.split() if b"<|" in text else TAIL.sub(rb" \1", text.lower()).split()


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones stand for
    themselves, the others follow from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (chr(256 + i) for i in range(256))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


def is_plain(word: str) -> bool:
    """Lower-case letters in composed form: the tokenizer's normaliser leaves such a word as it is
    and its pre-tokenizer keeps it whole, so that its merges alone give the ids."""
    return word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word)


class WordIds:
    """The ids of words as little-endian bytes; new words are encoded many at a time, plain ones by
    the tokenizer's model alone."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.encode, self.model = tokenizer(path).encode_batch_fast, tokenizer(path).model
        self.alphabet = byte_alphabet()
        self.known: dict[bytes, bytes] = {}

    def learn(self, new: list[bytes]) -> None:
        merge, letter = self.model.tokenize, self.alphabet.__getitem__
        other = []
        for w in new:
            word = w.decode()
            if is_plain(word):
                merged = merge(word if word.isascii() else "".join(map(letter, w)))
                self.known[w] = array("I", [t.id for t in merged]).tobytes()
            else:
                other.append(w)
        encoded = self.encode([w.decode() for w in other], add_special_tokens=False)
        self.known.update(zip(other, (array("I", e.ids).tobytes() for e in encoded)))

    def of(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of each text."""
        if len(self.known) > CACHE:
            self.known.clear()
        words = list(chain.from_iterable(texts))
        ids = list(map(self.known.get, words))
        unknown = [i for i, x in enumerate(ids) if x is None]
        self.learn(list({words[i] for i in unknown}))
        for i in unknown:
            ids[i] = self.known[words[i]]
        parts = iter(ids)
        return [b"".join(islice(parts, len(t))) for t in texts]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """``(piece, start, length, crc32)`` of the pieces of a document's ids."""
    size = 4 * capacity
    return [(i // size, i // 4, len(p) // 4, zlib.crc32(p))
            for i in range(0, len(ids), size) for p in (ids[i:i + size],)]


def piece_batch(path: str, capacity: int):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batch) -> dict:
        table = word_ids(path)
        ids = batch.column(0).to_pylist()
        cols: dict[str, list] = {n: [] for n in ("id", "piece", "start", "length", "ids_crc32")}
        # Documents in small groups: new words are encoded together, memory stays bounded.
        for i in range(0, len(ids), 256):
            texts = [words_of(t) for t in batch.column(1).slice(i, 256).to_pylist()]
            for doc, tokens in zip(ids[i:i + 256], table.of(texts)):
                for row in cut(tokens + end, capacity):
                    for n, v in zip(cols, (doc, *row)):
                        cols[n].append(v)
        return cols

    return run


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("t")),
                       piece_batch(path, capacity),
                       f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


# --- the linear program ----------------------------------------------------------------------------

def priced(size: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack dynamic program over the capacity: for each room the number of the length that the
    best filling of that room takes last, -1 where it is the filling of one token less; and the values of
    the fillings. Of equal fillings it takes the longest length."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1, np.int64)
    ends = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        n = ends[c]
        best[c] = best[c - 1]
        if n:
            gain = best[c - size[:n]] + value[:n]
            j = n - 1 - int(gain[::-1].argmax())
            if gain[j] > best[c]:
                best[c], took[c] = gain[j], j
    return took, best


def filling(took: np.ndarray, size: np.ndarray, room: int) -> Counter:
    """The best filling of a room: how often it takes each length (numbers into ``size``)."""
    out: Counter = Counter()
    while room > 0:
        j = int(took[room])
        if j < 0:
            room -= 1
            continue
        out[j] += 1
        room -= int(size[j])
    return out


def configuration(first: int, took: np.ndarray, open_: np.ndarray, lengths: np.ndarray, left: np.ndarray,
                  capacity: int) -> dict[int, int]:
    """The best configuration with the open length ``first``, within what is left of each length; room
    that this frees goes to the longest lengths that fit."""
    size = lengths[open_]
    wanted = filling(took, size, capacity - int(size[first]))
    wanted[first] += 1
    config = {int(open_[j]): n for j, k in wanted.items() if (n := min(k, int(left[open_[j]])))}
    room = capacity - sum(int(lengths[j]) * k for j, k in config.items())
    while True:
        fits = np.flatnonzero(left[:np.searchsorted(lengths, room, side="right")] >= 1)[::-1]
        j = next((int(j) for j in fits if left[j] - config.get(int(j), 0) >= 1), None)
        if j is None:
            return config
        config[j] = config.get(j, 0) + 1
        room -= int(lengths[j])


def covered(lengths: np.ndarray, demand: np.ndarray, price: np.ndarray, capacity: int, anchors: int = ANCHORS,
            rate: float = RATE) -> tuple[list[tuple[dict[int, int], float]], np.ndarray]:
    """One phase: configurations and how many times each is used, covering ``demand`` up to less than one
    piece of each length, and what is left. A length's weight falls exponentially with its covered share.
    One knapsack table per round gives the best configurations through the ``anchors`` longest uncovered
    lengths; each is used until one of its lengths is covered."""
    left = demand.astype(float)
    used: dict[tuple, float] = defaultdict(float)
    while (left >= 1).any():
        open_ = np.flatnonzero(left >= 1)
        size = lengths[open_]
        took, _ = priced(size, price[open_] * np.exp(rate * (left[open_] / demand[open_] - 1)), capacity)
        for first in range(len(open_) - 1, max(-1, len(open_) - 1 - anchors), -1):
            if left[open_[first]] >= 1:
                config = configuration(first, took, open_, lengths, left, capacity)
                times = min(left[j] / k for j, k in config.items())
                used[tuple(sorted(config.items()))] += times
                for j, k in config.items():
                    left[j] -= k * times
    return [(dict(c), x) for c, x in used.items()], left


def threshold_bound(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> float:
    """The best bound by prices with a threshold: 1 for lengths that leave less than the threshold's room,
    none below the threshold, and the share of the capacity between (no sequence holds more than 1)."""
    best = 0.0
    for t in range(capacity // 2 + 1):
        price = np.where(lengths > capacity - t, 1.0, np.where(lengths < t, 0.0, lengths / capacity))
        best = max(best, float(price @ demand))
    return best


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP,
               phases: int = PHASES) -> tuple[list[tuple[dict[int, int], float]], float, float]:
    """The best phase's configurations, their number, and the bound that prices prove for the demand it
    covers. Prices start as sizes; after a phase, lengths in sequences with room left get dearer by a factor
    that is exponential in that room, so the next one serves them first. Any prices prove a bound: the
    demand's worth over that of the dearest configuration, which the knapsack finds; so do thresholds. Phases end when
    the number is within ``gap`` of the bound."""
    price = lengths.astype(float)
    best = None
    for _ in range(phases):
        used, left = covered(lengths, demand, price, capacity)
        number = sum(x for _, x in used)
        done = demand - left
        dearest = priced(lengths, price, capacity)[1][capacity]
        bound = max(float(done @ price) / dearest, threshold_bound(lengths, done, capacity))
        if best is None or number - bound < best[1] - best[2]:
            best = used, number, bound
        if number <= (1 + gap) * bound:
            break
        loss = np.zeros(len(lengths))
        for config, x in used:
            room = 1 - sum(int(lengths[j]) * k for j, k in config.items()) / capacity
            for j, k in config.items():
                loss[j] += room * k * x / demand[j]
        price = price * np.exp(loss)
    return best


Groups = list[tuple[list[int], int]]


def best_fit(histogram: dict[int, int], capacity: int, begun: Groups = ()) -> Groups:
    """Best-fit decreasing by counts: each piece into the fullest sequence that still takes it, into those
    ``begun`` first. Equal pieces fill a sequence one after the other, so equal sequences stay together
    and there are at most about three groups a length."""
    by_room: dict[int, list] = defaultdict(list)
    for config, times in begun:
        by_room[capacity - sum(config)].append((list(config), times))
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        for room in sorted(r for r in by_room if r >= n):
            each = room // n
            while left and by_room[room]:
                config, times = by_room[room].pop()
                full = min(times, left // each)
                if full:
                    by_room[room - each * n].append((config + [n] * each, full))
                    left -= full * each
                    times -= full
                if times and left:  # less than one sequence's worth
                    by_room[room - left * n].append((config + [n] * left, 1))
                    left, times = 0, times - 1
                if times:
                    by_room[room].append((config, times))
                    break
            if not by_room[room]:
                del by_room[room]
            if not left:
                break
        each = capacity // n
        if left >= each:
            by_room[capacity - each * n].append(([n] * each, left // each))
        if left % each:
            by_room[capacity - left % each * n].append(([n] * (left % each), 1))
    return [g for groups in by_room.values() for g in groups]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Groups:
    """``(lengths in one sequence, number of such sequences)`` that use up the histogram: the rounded
    linear program, or best-fit decreasing where that needs fewer."""
    rest = {n: c for n, c in sorted(histogram.items()) if c > 0}
    if not rest:
        return []
    lengths, demand = np.array(list(rest)), np.array(list(rest.values()))
    left = demand.copy()
    rounded = []
    for config, x in sorted(fractional(lengths, demand, capacity)[0], key=lambda c: -c[1]):
        times = min([int(x + 1e-9)] + [int(left[j] // k) for j, k in config.items()])
        if times > 0:
            rounded.append(([int(lengths[j]) for j, k in sorted(config.items(), reverse=True) for _ in range(k)], times))
            for j, k in config.items():
                left[j] -= k * times
    rounded = best_fit({int(n): int(k) for n, k in zip(lengths, left) if k}, capacity, rounded)
    plain = best_fit(rest, capacity)
    return min(rounded, plain, key=lambda groups: sum(times for _, times in groups))


def slots(bins: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows ``(first rank, first sequence, offset)``: ranks from the first on go to the
    sequences from the first on."""
    out: dict[int, list] = defaultdict(list)
    used: Counter = Counter()
    sequence = 0
    for lengths, times in bins:
        offset = 0
        for n in lengths:
            out[n].append((used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


# --- assignment ------------------------------------------------------------------------------------

def ranked(found: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``found`` with the rank of each piece within its length, from 0 without gaps."""
    spark = found.sparkSession
    groups = spark.createDataFrame([(n, 1 + c // GROUP) for n, c in histogram.items()], "length bigint, groups bigint")
    salted = found.join(F.broadcast(groups), "length").withColumn(
        "salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("groups"))).drop("groups")
    before = salted.groupBy("length", "salt").count().withColumn("before", F.coalesce(F.sum("count").over(
        Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = salted.withColumn("n", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")))
    return local.join(before.drop("count"), ["length", "salt"]).withColumn(
        "rank", F.col("before") + F.col("n") - 1).drop("salt", "before", "n")


def place_batch(places: dict[int, np.ndarray]):
    def run(batch) -> dict:
        cols = {n: batch.column(n) for n in ("id", "piece", "start", "length", "ids_crc32")}
        length = np.asarray(batch.column("length"))
        rank = np.asarray(batch.column("rank"))
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for n in np.unique(length):
            rows, at = places[int(n)], length == n
            i = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
            sequence[at] = rows[i, 1] + rank[at] - rows[i, 0]
            offset[at] = rows[i, 2]
        return cols | {"sequence_id": sequence, "offset": offset}

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = cut_lineage(pieces(docs, path, id_col, text_col, capacity))
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    places = slots(plan(histogram, capacity))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(ranked(found, histogram), place_batch(places),
                       f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
                       "sequence_id bigint, offset bigint")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), default_tokenizer()).withColumnRenamed("id", "doc_id")

"""SimHash near-duplicates found with vantage-point trees.

A text's fingerprint has a bit set where over half of the hashes of its word shingles have it.
Fingerprints that differ in at most ``max_bits`` bits are linked; a component is what links reach.

Search. Exact copies of a fingerprint are one point. A vantage-point tree over the Hamming distance
deals the points to shards: at a node with vantage point ``v`` and radius ``r``, points within ``r``
of ``v`` go inside; points farther than ``r - max_bits`` go outside. By the triangle inequality two
points within ``max_bits`` of each other are then together in at least one child, so every link is
found in some shard, and branches that cannot hold a partner are never visited. Only points near a
boundary are in both children. The tree is fitted on a bounded sample (``SAMPLE_PER_SHARD`` points a
shard, ``MAX_SHARDS`` shards at most) and sent to the tasks; every point is dealt. A task continues
the same tree over its shard down to leaves of ``LEAF`` points, where distances are computed
exactly, in blocks.

Dense groups. A node is split only if its children have at most ``GAIN`` of its pairs between them:
at depth ``d`` of a tree of ``s`` shards at most ``s**2 * GAIN**d`` nodes are split, none is deeper
than ``2 * log(s) / log(1 / GAIN)``, and all pairs of the shards are never more than those of the
points. The fullest node is split first; the tree has ``MAX_NODES`` nodes and ``MAX_HELD`` sample points
at most, whatever the data. A shard that stays larger than two of ``SHARD`` points (a dense ball, whose
points no radius parts) is dealt to sub-shards by a salt, and every pair of sub-shards is a group of its
own, so that all its points meet and no task holds more than two sub-shards. A task compares a node that
does not split in blocks: points that differ in one bit are linked by look-up, and the points that are
not yet in the largest component by then are compared with all.

A shard gives a spanning forest of its links (each point to the least point of its part), never
all pairs of a dense group. Components over shards come from rounds of large-star and small-star
steps on these edges as DataFrames, each round written to the shared folder.

The tree over near-uniform 64-bit fingerprints keeps about 0.65 of the points on either side of a
node, so its work grows as points to the power 1.6, and copies at boundaries as the power 0.6.

Defined cases: null or empty text has no shingle and fingerprint zero; fewer words than the shingle
length are one shingle; rows that repeat an id are in the component of their own text each; null
ids lose against any other id; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_table, ship_package
from .common import map_batches, rows_of, table

SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: Points of a shard (a few seconds of one task, a few MB), and the least number of shards.
SHARD, LEAST_SHARDS = 131_072, 16
LEAF, BLOCK = 1_024, 4_096
SAMPLE_PER_SHARD, MAX_SHARDS = 32, 1 << 15
#: Share of a node's pairs that its children may have; bounds of the tree that is sent to the tasks.
GAIN, MAX_NODES, MAX_HELD = 0.9, 1 << 17, 1 << 24


# --- fingerprints ------------------------------------------------------------------------------

def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text, ASCII letters lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):  # long texts in blocks
        bits = np.unpackbits(hashes[i:i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint_batch(shingle: int):
    def run(batch) -> dict:
        f = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
        return {"id": batch.column(0), "fp": f.view(np.int64)}

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)``, the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return map_batches(rows, fingerprint_batch(shingle), f"id {kind}, fp bigint")


# --- vantage-point trees -----------------------------------------------------------------------

def distances(points: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(points ^ v)


def split(points: np.ndarray, max_bits: int) -> tuple[np.uint64, int] | None:
    """Vantage point and radius that leave the larger child smallest; None if the children would have
    more than ``GAIN`` of the node's pairs. Candidates are spread over the points."""
    best, found, pairs = len(points), None, GAIN * len(points) ** 2
    for v in points[np.linspace(0, len(points) - 1, num=min(6, len(points)), dtype=np.int64)]:
        n = np.bincount(distances(points, v), minlength=65).cumsum()
        for r in range(64):
            inside, outside = int(n[r]), len(points) - (int(n[r - max_bits]) if r >= max_bits else 0)
            if max(inside, outside) < best and inside and inside ** 2 + outside ** 2 <= pairs:
                best, found = max(inside, outside), (v, r)
    return found


class Tree:
    """A fitted tree as arrays: vantage point, radius, children; a negative child ``-1 - s`` is
    shard ``s``. ``weights``: share of the sample in each shard. ``parts``: sub-shards of each shard;
    the groups of a shard, one or all pairs of its sub-shards, start at ``first``."""

    def __init__(self, sample: np.ndarray, shards: int, max_bits: int):
        self.vantage, self.radius, self.inside, self.outside = [], [], [], []
        self.max_bits, self.weights = max_bits, []
        self.root = -1
        self.fit(sample, max(2, len(sample) // max(1, shards)) if shards > 1 else len(sample))
        self.shards = len(self.weights)
        self.size_parts(0, 1)

    def fit(self, sample: np.ndarray, enough: int) -> None:
        held, total = len(sample), max(1, len(sample))
        # Nodes by size, the largest first: size, number of entry, sample, the child it is.
        todo = [(-len(sample), 0, sample, None)]
        entries = 1
        while todo:
            _, _, points, child = heapq.heappop(todo)
            found = None
            if len(points) > enough and len(self.vantage) < MAX_NODES and held < MAX_HELD:
                found = split(points, self.max_bits)
            if found is None:
                self.put(child, -1 - len(self.weights))
                self.weights.append(len(points) / total)
                continue
            v, r = found
            node = len(self.vantage)
            self.put(child, node)
            for a, x in ((self.vantage, v), (self.radius, r), (self.inside, 0), (self.outside, 0)):
                a.append(x)
            d = distances(points, v)
            for side, at in ((self.inside, d <= r), (self.outside, d > r - self.max_bits)):
                some = points[at]
                heapq.heappush(todo, (-len(some), entries, some, (side, node)))
                entries += 1
                held += len(some)
            held -= len(points)

    def put(self, child: tuple[list, int] | None, node: int) -> None:
        if child is None:
            self.root = node
        else:
            child[0][child[1]] = node

    def size_parts(self, n: int, shard: int) -> None:
        """Sub-shards of about ``shard`` points for shards of more than two such, ``n`` points in all."""
        sizes = np.array(self.weights) * n
        self.parts = np.where(sizes > 2 * shard, np.ceil(sizes / shard), 1).astype(np.int64)
        groups = np.maximum(1, self.parts * (self.parts - 1) // 2)
        self.first = np.cumsum(groups) - groups

    def deal(self, points: np.ndarray):
        """``(group, numbers of its points)`` for every group that gets some; any two points of a shard
        are together in a group."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield from self.deal_parts(-1 - node, points, at)
                continue
            d = distances(points[at], self.vantage[node])
            todo.append((self.inside[node], at[d <= self.radius[node]]))
            todo.append((self.outside[node], at[d > self.radius[node] - self.max_bits]))

    def deal_parts(self, shard: int, points: np.ndarray, at: np.ndarray):
        first, parts = int(self.first[shard]), int(self.parts[shard])
        if parts == 1:
            yield first, at
            return
        # Multiplying spreads near points over the salts.
        salt = (points[at] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)
        of = [at[salt == np.uint64(i)] for i in range(parts)]
        for j in range(1, parts):
            for i in range(j):
                both = np.concatenate((of[i], of[j]))
                if len(both):
                    yield first + j * (j - 1) // 2 + i, both


class Forest:
    """Union-find over the points of a shard."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, pairs_a: np.ndarray, pairs_b: np.ndarray) -> None:
        for a, b in zip(pairs_a.tolist(), pairs_b.tolist()):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)


def join_labels(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``up`` (least member of each point's component) after linking ``a`` with ``b``."""
    while True:
        a, b = up[a], up[b]
        differ = a != b
        if not differ.any():
            return up
        a, b = a[differ], b[differ]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != (up := up[up])).any():
            pass


def near_labels(points: np.ndarray, max_bits: int) -> np.ndarray:
    """The least member of each point's component, for a node that is not split further."""
    n = len(points)
    up, most = np.arange(n), -1
    if n > LEAF and max_bits:
        order = np.argsort(points)
        ranked = points[order]
        for bit in range(64):
            other = ranked ^ np.uint64(1 << bit)
            at = np.minimum(np.searchsorted(ranked, other), n - 1)
            hit = ranked[at] == other
            up = join_labels(up, order[hit], order[at[hit]])
        most = int(np.bincount(up).argmax())
    for i in range(0, n, LEAF):
        rows = np.arange(i, min(n, i + LEAF))
        if most >= 0:
            # Rows of the largest component need no look: points outside it are compared with it.
            rows = rows[up[rows] != up[most]]
        found = []
        for j in range(0, n if len(rows) else 0, LEAF):
            a, b = np.nonzero(np.bitwise_count(points[rows, None] ^ points[j:j + LEAF]) <= max_bits)
            a, b = up[rows[a]], up[b + j]
            differ = a != b
            if differ.any():
                found.append(np.unique(a[differ] * n + b[differ]))
        if found:
            pairs = np.concatenate(found)
            up = join_labels(up, pairs // n, pairs % n)
    return up


def link_all(points: np.ndarray, max_bits: int) -> Forest:
    """Links all points of a shard within ``max_bits``: the tree goes on down to leaves; a node that
    does not split (a dense group) is compared in blocks."""
    forest = Forest(len(points))
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        found = split(points[at], max_bits) if len(at) > LEAF else None
        if found is not None:
            d = distances(points[at], found[0])
            todo += [at[d <= found[1]], at[d > found[1] - max_bits]]
            continue
        up = near_labels(points[at], max_bits)
        linked = np.flatnonzero(up != np.arange(len(at)))
        forest.link(at[linked], at[up[linked]])
    return forest


def deal_batch(tree: Tree):
    def run(batch) -> dict:
        points = np.asarray(batch.column("fp")).view(np.uint64)
        shards, fps = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for s, at in tree.deal(points):
            shards.append(np.full(len(at), s, np.int64))
            fps.append(points[at])
        return {"shard": np.concatenate(shards), "fp": np.concatenate(fps).view(np.int64)}

    return run


def shard_edges(max_bits: int):
    def run(group: pa.Table) -> pa.Table:
        points = np.sort(np.asarray(group.column("fp")).view(np.uint64))
        forest = link_all(points, max_bits)
        roots = np.fromiter((forest.root(i) for i in range(len(points))), np.int64, len(points))
        linked = np.flatnonzero(roots != np.arange(len(points)))
        return pa.table({"a": points[linked].view(np.int64), "b": points[roots[linked]].view(np.int64)})

    return run


def links(points: DataFrame, max_bits: int = MAX_BITS, shard: int = SHARD) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints whose components are those of all pairs within
    ``max_bits``. ``points``: a written table of the distinct ``fp``."""
    ship_package(points.sparkSession)
    n = points.count()
    tree = Tree(np.empty(0, np.uint64), 1, max_bits)
    if n > LEAF:
        # Boundary points are copied, so that a tree of this many shards holds more than n points.
        shards = min(MAX_SHARDS, max(LEAST_SHARDS, int((n / shard) ** 1.6) + 1))
        wanted = SAMPLE_PER_SHARD * shards
        # Hash order over distinct fingerprints: a uniform sample, the same on every run.
        share = min(1.0, 1.5 * wanted / n)
        rows = points.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * wanted)
        sample = np.sort(rows.select("fp").toArrow()["fp"].to_numpy().view(np.uint64))
        tree = Tree(sample, shards, max_bits)
        tree.size_parts(n, shard)
    dealt = map_batches(points.select("fp"), deal_batch(tree), "shard bigint, fp bigint")
    return dealt.groupBy("shard").applyInArrow(shard_edges(max_bits), "a bigint, b bigint")


# --- components --------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges`` but the roots; the root is the least node of its
    component. Alternating large-star and small-star steps; a round's result is a table."""
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        before = edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The sides with one row a node are written: a node may be the centre of most edges, and AQE splits hot
        # keys only of shuffles that the planner inserts.
        least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .filter("a <> b").distinct()
        large = cut_lineage(large)
        drop_table(least)
        low = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                            F.col("m").alias("b")).filter("a <> b").distinct()
        edges = cut_lineage(small)
        drop_table(large)
        drop_table(low)
        # Done when every node has one edge, to a root: the edges no longer change.
        same = edges.count() == before.count() and edges.join(before, ["a", "b"], "left_anti").isEmpty()
        drop_table(before)
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                max_bits: int = MAX_BITS) -> DataFrame:
    """Per row: id, ``fp``, ``root`` (names its component) and ``component_id`` (its least id)."""
    marked = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    points = cut_lineage(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(points, max_bits))
    named = points.join(roots, points["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = cut_lineage(named.groupBy("root").agg(F.min("least").alias("component_id")))
    of_fp = cut_lineage(named.select("fp", "root").join(least, "root").select("fp", "root", "component_id"))
    return marked.join(of_fp, "fp").select("id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, all columns: the one with the least id,
    of a repeated id the one with the least fingerprint, of a repeated text the least row as JSON."""
    found = cut_lineage(near_groups(docs, id_col, text_col, shingle, max_bits))
    again = cut_lineage(found.groupBy("id").count().filter("count > 1").select(F.col("id").alias("again_id")))
    rows = rows_of(docs, id=F.col(id_col), text=F.col(text_col).cast("binary"))
    lost = found.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("lost_id")).distinct()
    if again.isEmpty():
        return rows.join(lost, rows["id"].eqNullSafe(lost["lost_id"]), "left_anti").select("row.*")
    # Ids that several rows have do not tell rows apart; those rows go by id and fingerprint.
    hit = rows["id"].eqNullSafe(again["again_id"])
    single = rows.join(again, hit, "left_anti")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("best"))
    best = best.select("root", F.col("best.id").alias("best_id"), F.col("best.fp").alias("best_fp"))
    several = rows.join(again, hit, "left_semi").withColumn("fp", fingerprint_udf(shingle)("text"))
    several = several.join(best, several["id"].eqNullSafe(best["best_id"]) & (several["fp"] == best["best_fp"]))
    once = several.groupBy("root").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return single.join(lost, single["id"].eqNullSafe(lost["lost_id"]), "left_anti").select("row") \
        .unionByName(once.select("row")).select("row.*")


def fingerprint_udf(shingle: int):
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return F.pandas_udf(run, "bigint")


def query(spark, sf_dir):
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")

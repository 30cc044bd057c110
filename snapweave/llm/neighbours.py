"""Nearest neighbours by a block matrix join of int8 products.

The question vectors and all candidates are cut into blocks; every block of questions meets every block
of candidates in one cell, a task of bounded memory.

1. Tiles. Unit vectors become int8 by a scale of their own; a tile of products is exact integer
   arithmetic (run as 32-bit floats, in which sums of ``EXACT`` products are exact). With the
   residual ``r = u - s * q`` of either vector, the cosine differs from the scaled integer product by at
   most ``|r_a||s_b q_b| + |s_a q_a||r_b| + |r_a||r_b|``, which gives an upper and a lower bound.
2. Survivors. A pair whose upper bound is below a question's k-th best exact cosine so far, or below the
   k-th best lower bound of the tile, cannot be among the nearest. The others are computed again from
   the original vectors in double precision, component by component in order, so equal vectors
   have equal cosines wherever they are.
3. Heaps. Each question keeps a heap of its k best pairs; the heaps of all cells are merged by a
   window's rank limit, which Spark applies before and after its shuffle.

The bounds are exact, so the result is that of comparing everything: recall is 1.

Copies. Vectors that many rows share are one question, and only the ``k + 1`` rows of least id of each
distinct vector are candidates: no other row of theirs can be among the ``k`` nearest of anyone. A
cluster of copies is thus never compared with itself pair by pair.

Growth: the work is questions times candidates, as the stated question set asks. Each candidate is sent
once per block of questions, each question once per block of candidates, blocks being equally large,
which is the least for a given memory. Nothing is broadcast; the driver gets row counts.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part;
vectors of different lengths are not compared; null ids are no questions and as candidates come after
all others; rows that repeat an id are rows of their own, each a question, and a question's own row alone is left
out; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..session import cut_lineage, drop_table, ship_package
from .common import table

NEAREST, EVERY = 5, 50
#: Vectors and components of a block, vectors of a tile, pairs computed at once.
BLOCK, COMPONENTS, TILE, PAIRS = 16_384, 1 << 22, 1_024, 1 << 14
#: Products of two int8 numbers whose sum a 32-bit float holds exactly.
EXACT = (1 << 24) // (127 * 127)
#: Covers the rounding of the bounds themselves.
SLACK = 1e-9


# --- one cell ----------------------------------------------------------------------------------

class Block:
    """Vectors of one length, in double precision, with their int8 form."""

    def __init__(self, vectors: pa.ChunkedArray):
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks])
        x = flat.astype(np.float64).reshape(len(vectors), -1)
        # A power of two changes no cosine and keeps squares of any double in range.
        _, exponent = np.frexp(np.abs(x).max(axis=1))
        self.x = np.ldexp(x, -exponent[:, None])
        self.norm = np.sqrt(in_order(self.x * self.x))
        unit = self.x / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.int8 = np.rint(unit / self.scale[:, None]).astype(np.int8)
        near = self.int8 * self.scale[:, None]
        self.size = np.sqrt((near * near).sum(axis=1))
        self.rest = np.sqrt(((unit - near) ** 2).sum(axis=1))


def in_order(products: np.ndarray) -> np.ndarray:
    """The sum of each row, added from the first to the last component."""
    total = np.zeros(len(products))
    for column in products.T:
        total += column
    return total


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], EXACT):
        out += a[:, i:i + EXACT].astype(np.float32) @ b[:, i:i + EXACT].astype(np.float32).T
    return out


def cosines(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    dots = [in_order(a.x[i[p:p + PAIRS]] * b.x[j[p:p + PAIRS]]) for p in range(0, len(i), PAIRS)]
    dots = np.concatenate(dots) if dots else np.empty(0)
    return np.clip(dots / (a.norm[i] * b.norm[j]), -1, 1)


def nearest(asked: Block, candidates: Block, k: int) -> list[list[tuple[float, int]]]:
    """For each question the ``k`` best ``(cosine, -number)`` of the candidates as a heap."""
    heaps = [[] for _ in asked.norm]
    floor = np.full(len(heaps), -np.inf)
    for s in range(0, len(candidates.norm), TILE):
        c = slice(s, s + TILE)
        for r in range(0, len(heaps), TILE):
            q = slice(r, r + TILE)
            near = int8_products(asked.int8[q], candidates.int8[c]) * asked.scale[q, None] * candidates.scale[None, c]
            wide = asked.rest[q, None] * (candidates.size + candidates.rest)[None, c] \
                + asked.size[q, None] * candidates.rest[None, c] + SLACK
            least = floor[q]
            if near.shape[1] >= k:
                low = near - wide
                least = np.maximum(least, np.partition(low, -k, axis=1)[:, -k])
            i, j = np.nonzero(near + wide >= least[:, None])
            i, j = i + r, j + s
            exact = cosines(asked, candidates, i, j)
            better = exact >= floor[i]
            for row, number, cosine in zip(i[better].tolist(), j[better].tolist(), exact[better].tolist()):
                heap, item = heaps[row], (cosine, -number)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
                if len(heap) == k:
                    floor[row] = heap[0][0]
    return heaps


def cell(k: int, schema: pa.Schema):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not (asked.num_rows and rows.num_rows):
            return schema.empty_table()
        # In order of ids, nulls last, so that a candidate's number decides ties.
        rows = rows.sort_by("id")
        a, b = Block(asked["v"]), Block(rows["v"])
        heaps = nearest(a, b, k)
        i = np.repeat(np.arange(len(heaps)), [len(h) for h in heaps])
        pairs = [p for h in heaps for p in h]
        j = np.array([-n for _, n in pairs], np.int64)
        return pa.table({"q": asked["q"].take(pa.array(i)), "id": rows["id"].take(pa.array(j)),
                         "score": np.array([c for c, _ in pairs], np.float64),
                         "same": (a.x[i] == b.x[j]).all(axis=1) & (a.norm[i] == b.norm[j])}, schema=schema)

    return run


# --- the join of blocks ------------------------------------------------------------------------

def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of the vectors that take part."""
    v = F.col(vector_col)
    if not isinstance(vectors.schema[vector_col].dataType.elementType, FloatType):
        v = v.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(
        v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def block_join(asked: DataFrame, candidates: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``(q, id, score, same)`` of the ``k`` nearest candidates of each question. ``asked``: a written table
    ``(q, v)``; ``candidates``: a written table ``(id, v)``; ``same`` tells equal vectors."""
    spark = candidates.sparkSession
    ship_package(spark)
    longest = candidates.agg(F.max(F.size("v"))).first()[0] or 1
    block = max(1, min(block, COMPONENTS // longest))
    n, questions = candidates.count(), asked.count()
    cores = spark.sparkContext.defaultParallelism
    columns = max(-(-n // block), min(cores, n // TILE), 1)
    rows = max(-(-questions // block), 1)
    tasks = min(columns * rows, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * cores))
    key = ["dim", "column", "row"]

    def dealt(df: DataFrame, own: str, of: int, others: str, many: int) -> DataFrame:
        placed = df.select("*", F.size("v").alias("dim"), F.pmod(F.xxhash64(*df.columns), F.lit(of)).alias(own),
                           F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(many - 1).cast("bigint"))).alias(others))
        return placed.repartition(tasks, *key)

    id_type = candidates.schema["id"].dataType.simpleString()
    schema = pa.schema([("q", pa.int64()), ("id", pa_type(id_type)), ("score", pa.float64()), ("same", pa.bool_())])
    a = dealt(asked, "row", rows, "column", columns).groupBy(*key)
    b = dealt(candidates, "column", columns, "row", rows).groupBy(*key)
    pairs = a.cogroup(b).applyInArrow(cell(k, schema), f"q bigint, id {id_type}, score double, same boolean")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def pa_type(name: str) -> pa.DataType:
    return {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}[name]


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST,
               every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, id, score)`` of the ``k`` nearest rows of each row whose id ``every`` divides."""
    rows = valid(vectors, id_col, vector_col)
    # The nearest of a vector may hold the row that asks, so one more is kept.
    least = Window.partitionBy("v").orderBy(F.asc_nulls_last("id"))
    candidates = cut_lineage(rows.withColumn("place", F.row_number().over(least))
                             .filter(F.col("place") <= k + 1).drop("place"))
    askers = cut_lineage(rows.filter(F.col("id") % every == 0).groupBy("v", "id").agg(F.count(F.lit(1)).alias("copies")))
    asked = cut_lineage(askers.select("v").distinct().withColumn("q", F.monotonically_increasing_id()).select("q", "v"))
    found = block_join(asked, candidates, k + 1, block)
    best = cut_lineage(found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "same"))).alias("best")))
    of = askers.join(asked, "v").join(best, "q")
    drop_table(candidates)
    # The row that asks is the first of its id among the rows of its own vector.
    own = F.filter("best", lambda b: b["same"] & b["id"].eqNullSafe(F.col("id")))
    others = F.filter("best", lambda b: ~b["rank"].eqNullSafe(F.element_at(F.col("own"), 1)["rank"]))
    kept = of.withColumn("own", F.when(F.size(own) > 0, own)).select(
        F.col("id").alias("query_id"), F.slice(others, 1, k).alias("near"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    each = kept.select("query_id", F.posexplode("near").alias("place", "b"))
    return each.select("query_id", (F.col("place") + 1).alias("rank"), F.col("b.id").alias("id"), F.col("b.score").alias("score"))


def query(spark, sf_dir):
    return neighbours(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


SQL = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
      AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM v),
pairs AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id,
           greatest(-1, least(1, list_dot_product(q.x, c.x) / (q.norm * c.norm))) AS score
    FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.x) = len(c.x)),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

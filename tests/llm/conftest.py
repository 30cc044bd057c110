import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import CLASH, DOCS, LONG, SF, duck, edge_rows, edge_vectors, write_tables  # noqa: E402

@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    """Tables of edge cases: documents with clashing extra columns, pages and labels."""
    from pyspark.sql import functions as F
    docs = spark.createDataFrame(edge_rows(), DOCS)
    docs = docs.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASH)])
    pages = spark.createDataFrame(
        [(1, "http://a.example/x", None), (2, None, ""), (None, "http://b.example/", "<p>no id</p>"),
         (3, "not a url \n", "plain text & more"), (4, "http://c.example/", "<p>" + "same payload " * 100),
         (5, "http://c.example/", "<p>" + "same payload " * 100), (5, "http://c.example/", "<p>" + "same payload " * 100),
         (6, "http://[bad/", "<p>" + "same payload " * 100), (7, "http://d.example/", "<article><p>" + LONG),
         (8, "http://a.com/x", "p"), (9, "http://a.com/x 5\x01z", "q"), (10, "http://[bad\tx", "r"), (11, "http://b.com/\x00", "s"),
         (None, None, None)], "page_id long, url string, html string").withColumn("id", F.lit("x")).withColumn("key", F.lit(1))
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (8, None, 0), (None, 1, 0), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame(edge_vectors(), "vec_id long, embedding array<float>")
    vectors = vectors.select("*", *[F.lit("x").alias(c) for c in ("id", "v", "q", "rank", "score", "dim", "row", "column")])
    return write_tables(spark, tmp_path_factory.mktemp("edge"), documents=docs, pages=pages, labels=labels,
                        embeddings=vectors)


@pytest.fixture(scope="session")
def empty_dir(spark, edge_dir, tmp_path_factory):
    frames = {t: spark.read.parquet(f"{edge_dir}/{t}.parquet").limit(0) for t in ("documents", "pages", "labels", "embeddings")}
    return write_tables(spark, tmp_path_factory.mktemp("empty"), **frames)


@pytest.fixture(scope="session")
def con():
    return duck(SF)

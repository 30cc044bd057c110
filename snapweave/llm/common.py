"""Expressions and table helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship_package

#: White space of all word rules here: space and the five controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """The maximal runs of characters that are no white space."""
    plain = F.translate(text, SPACES, " " * len(SPACES))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def rows_of(docs: DataFrame, **derived: Column) -> DataFrame:
    """``docs`` as one struct column ``row`` beside derived columns, so that no name of theirs can
    clash; ``select("row.*")`` restores the frame."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *[c.alias(n) for n, c in derived.items()])


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` (Arrow record batch to a dict of columns) over every batch of ``df``."""
    ship_package(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict(fn(b), schema=out)

    return df.mapInArrow(run, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit hashes of 64-bit numbers."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)

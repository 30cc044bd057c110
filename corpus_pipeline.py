"""The corpus pipeline: stages over ``documents``, each of which calls one operator.

Every stage but the last returns the columns of ``documents``. ``run`` applies them in order; each
result is written as a table in the shared folder and read again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapweave.llm import exact_dedup, mixing, packing, quality_rules, simhash
from snapweave.llm.common import table
from snapweave.session import cut_lineage, drop_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the certified cutoffs keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources again by their source's weight."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packing.pack(docs, packing.default_tokenizer()).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash", near), ("temperature_mix", mix),
          ("best_fit_packing", pack)]

#: The linear program and the tokenizer have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            out = cut_lineage(out)
            if i:
                drop_table(docs)
        docs = out
    return docs

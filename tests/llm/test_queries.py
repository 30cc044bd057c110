"""Every registered query: against its DuckDB twin, on edge cases, and on empty tables."""

import pytest
from helpers import SF, duck, edge_rows, same_rows

import corpus_pipeline
from snapweave.llm import queries as Q

SQL = Q.oracle_sql()
OVER_PAGES = {"op2_html_text", "op9_warc_index"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, name):
    same_rows(Q.QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin_on_edge_cases(spark, edge_dir, name):
    same_rows(Q.QUERIES[name](spark, edge_dir), duck(edge_dir), SQL[name])


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert Q.QUERIES[name](spark, empty_dir).collect() == []


#: Queries whose rows are not those of the table.
OTHER_ROWS = {"op1_temperature_mix", "op4_best_fit_packing", "op11_spelling_variants", "op12_collocations",
              "op13_nearest_neighbours"}


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - OTHER_ROWS))
def test_a_row_for_each_row(spark, edge_dir, name):
    ids = "page_id" if name in OVER_PAGES else "doc_id"
    rows = Q.QUERIES[name](spark, edge_dir).collect()
    table = spark.read.parquet(f"{edge_dir}/{'pages' if name in OVER_PAGES else 'documents'}.parquet")
    assert sorted(map(repr, (r[ids] for r in rows))) == sorted(map(repr, (r[ids] for r in table.collect())))


def test_stages_keep_the_columns(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, edge_dir).columns == docs.columns, name


def test_stages_on_edge_cases(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    n = len(edge_rows())
    out = {name: stage(spark, docs, edge_dir).count() for name, stage in corpus_pipeline.STAGES}
    # The empty texts are one group (3 rows and the white space's), the prose another of 5 rows
    # with its white-space variant; "a" and "A" differ exactly and are equal for SimHash.
    assert out["exact_dedup"] == n - 2 - 4
    assert out["simhash"] == n - 3 - 5 - 1
    assert out["temperature_mix"] >= n
    assert out["quality_rules"] < n


def test_stages_on_empty_tables(spark, empty_dir):
    docs = spark.read.parquet(f"{empty_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, empty_dir).count() == 0, name


def test_pipeline_on_edge_cases(spark, edge_dir, empty_dir):
    assert corpus_pipeline.run(spark, edge_dir).count() > 0
    assert corpus_pipeline.run(spark, empty_dir).count() == 0

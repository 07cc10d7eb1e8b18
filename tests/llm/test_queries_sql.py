"""Queries that have SQL, against it, and the shape of all of them on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__
import corpus_pipeline
from quillsift.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) == []


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {"pipeline", *QUERIES} <= set(names) and {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in QUERIES}


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR).persist()
        assert docs.columns == columns and 0 < docs.count() <= n, name
        n = docs.count()
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}

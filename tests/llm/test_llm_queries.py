import pytest
from oracle import agree

import corpus_pipeline
from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    agree(spark, sf, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() >= 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stash(stage(spark, docs, sf), name)
        assert set(corpus_pipeline.COLUMNS) <= set(out.columns) and 0 < out.count() <= before
        docs, before = out, out.count()
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0

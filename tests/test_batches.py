"""Texts reach Python in bounded batches, whatever the size of a file."""

import pandas as pd
import pytest

from lorekeep.operators import chunking, retrieve

RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def unbounded(spark):
    old = spark.conf.get(RECORDS)
    spark.conf.set(RECORDS, "10000")
    yield spark
    spark.conf.set(RECORDS, old)


def _largest(spark) -> int:
    """Rows of the largest batch that Python gets of a table of one partition."""
    sizes = spark.range(1_600).coalesce(1).mapInPandas(lambda it: (pd.DataFrame({"n": [len(b)]}) for b in it), "n long")
    return sizes.agg({"n": "max"}).first()[0]


def test_chunking_holds_few_texts(unbounded):
    docs = unbounded.range(1_600).selectExpr("id doc_id", "concat('Text ', id, '.') text").coalesce(1)
    assert chunking.chunk_documents(docs).select("chunk_id").distinct().count() == 1_600
    assert _largest(unbounded) <= 500


def test_embedding_holds_few_texts(unbounded):
    df = unbounded.range(1_600).selectExpr("id chunk_id", "concat('word', id, ' Other') text").coalesce(1)
    got = {r["chunk_id"]: r["embedding"] for r in retrieve.HashingEmbedder(16, normalise=False).embed(df).collect()}
    assert len(got) == 1_600 and all(sum(abs(x) for x in v) in (0.0, 2.0) for v in got.values())
    assert _largest(unbounded) <= 500

"""Word search stores no vectors."""

from lorekeep.plans import kb_queries


def test_bm25_makes_no_vectors(spark, monkeypatch):
    def never(*_):
        raise AssertionError("embedded")

    monkeypatch.setattr(kb_queries, "_KB", {})
    monkeypatch.setattr(kb_queries.retrieve.HashingEmbedder, "embed", never)
    assert kb_queries.q_bm25(spark, "/root/testdata/sf0.001").columns == ["query_id", "chunk_id", "score", "rank"]

"""The engine's operators as temporary views for Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lorekeep.operators import analytics
from lorekeep.sources.store import TopicStore


def publish_store(store: TopicStore, prefix: str = "kb_") -> list[str]:
    """Views over a store: chunks, embeddings, manifest, witness, entities, claims, relations, stats, listing and topics."""
    frames = {
        "chunks": store.chunks(),
        "embeddings": store.embeddings(),
        "manifest": store.manifest(),
        "witness": store.witness(),
        "entities": store.graph_table("entities"),
        "claims": store.graph_table("claims"),
        "relations": store.graph_table("relations"),
        "stats": store.stats(),
        "listing": analytics.listing(store.chunks(), store.manifest()),
        "topics": analytics.topics_by_update(store.manifest()),
    }
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in frames]


def publish_queries(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> list[str]:
    """A view for each registered query (or the named ones) over the tables in a folder."""
    from lorekeep.plans import registry

    made = registry.queries()
    for name in names or list(made):
        made[name](spark, sf_dir).createOrReplaceTempView(name)
    return list(names or made)

"""Hash chains, stable ids and the ingestion state machine."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GENESIS = "0" * 64
CHAIN = "topic string, seq long, chunk_id string, video_id string, start_seconds double, ingested_at long, previous string, digest string"


def fnv1a64(text: Column) -> Column:
    """FNV-1a, 64 bits, of the UTF-8 bytes, as a decimal string (it does not fit a signed long)."""

    @F.pandas_udf("string")
    def hashed(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            h = 0xCBF29CE484222325
            for b in t.encode():
                h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            return str(h)

        return texts.map(one)

    return hashed(text)


def canonical_entry(seq: Column, chunk_id: Column, video_id: Column, start: Column, at: Column, previous: Column) -> Column:
    """The text an entry's digest is taken of: its fields, parted by line feeds; the start in milliseconds."""
    return F.concat_ws("\n", seq.cast("string"), chunk_id, video_id, F.round(start * 1000).cast("long").cast("string"), at.cast("string"), previous)


def build_chain(rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """rows (topic, seq, chunk_id, video_id, start_seconds, ingested_at) with previous and digest.

    Every digest covers the one before it, so a topic is one sequential fold in
    one task, which holds an Arrow batch at a time; the first entry follows the
    genesis of zeros, or the topic's digest in ``heads`` (topic, head) where a
    chain goes on.
    """
    rows = rows.select("topic", "seq", "chunk_id", "video_id", "start_seconds", "ingested_at")
    rows = rows.withColumn("head", F.lit(None).cast("string")) if heads is None else rows.join(heads.select("topic", "head"), "topic", "left")
    entry = lambda r: [str(r.seq), r.chunk_id, r.video_id, str(int(r.start_seconds * 1000 + 0.5)), str(r.ingested_at)]
    return _chained(rows, entry, "\n", CHAIN)


def _chained(rows: DataFrame, entry: Callable, separator: str, schema: str) -> DataFrame:
    """rows (topic, seq, ..., head) with previous and digest: SHA-256 of the entry's fields and the digest before."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        topic, last, begun = None, GENESIS, False
        for pdf in batches:
            links = []
            for r in pdf.itertuples(index=False):
                if not begun or r.topic != topic:
                    topic, last, begun = r.topic, r.head or GENESIS, True
                digest = hashlib.sha256(separator.join([*entry(r), last]).encode()).hexdigest()
                links.append((last, digest))
                last = digest
            pdf = pdf.drop(columns="head")
            pdf["previous"], pdf["digest"] = [a for a, _ in links], [b for _, b in links]
            yield pdf

    return rows.repartition("topic").sortWithinPartitions("topic", "seq").mapInPandas(fold, schema)


TOOL_CHAIN = "topic string, seq long, tool string, request_hash string, response_hash string, called_at long, previous string, digest string"


def tool_witness(calls: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Chain of tool calls (topic, seq, tool, request, response, called_at): digests of request and response, each entry over the one before."""
    rows = calls.select("topic", "seq", "tool", F.sha2("request", 256).alias("request_hash"), F.sha2("response", 256).alias("response_hash"), "called_at")
    rows = rows.withColumn("head", F.lit(None).cast("string")) if heads is None else rows.join(heads.select("topic", "head"), "topic", "left")
    return _chained(rows, lambda r: [str(r.seq), r.tool, r.request_hash, r.response_hash, str(r.called_at)], "", TOOL_CHAIN)


def verify_chain(chain: DataFrame) -> DataFrame:
    """Per topic: first bad seq and reason (link before digest), nulls where all is well."""
    before = F.coalesce(F.lag("digest").over(W.partitionBy("topic").orderBy("seq")), F.lit(GENESIS))
    digest = F.sha2(canonical_entry(F.col("seq"), F.col("chunk_id"), F.col("video_id"), F.col("start_seconds"), F.col("ingested_at"), F.col("previous")), 256)
    bad = F.when(F.col("previous") != before, "link").when(F.col("digest") != digest, "digest")
    checked = chain.select("topic", "seq", bad.alias("reason"))
    return checked.groupBy("topic").agg(F.count("*").alias("entries"), F.min(F.when(F.col("reason").isNotNull(), F.struct("seq", "reason"))).alias("first")).select("topic", "entries", F.col("first.seq").alias("first_bad_seq"), F.col("first.reason").alias("reason"))


def last_state(events: DataFrame, key: str = "video_id", order: str = "seq") -> DataFrame:
    """Latest event of each video."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), order).alias("s")).select(key, "s.*")


def resume_action(status: Column, force: Column) -> Column:
    """What an ingest does with a video: skip, resume after embedding, or run whole."""
    return F.when(status.isin("indexed", "failed") & ~force, "skip").when((status == "embedded") & ~force, "resume").otherwise("full")


def new_items(candidates: DataFrame, manifest: DataFrame, key: str = "video_id") -> DataFrame:
    """Candidates that the manifest does not hold as indexed or failed: incremental, idempotent ingest."""
    return candidates.join(manifest.where(F.col("status").isin("indexed", "failed")).select(key), key, "left_anti")


def slug_collisions(cached: DataFrame, manifest: DataFrame, key: str = "video_id") -> DataFrame:
    """Cached ids that the topic's manifest does not know."""
    return cached.join(manifest.select(key), key, "left_anti")

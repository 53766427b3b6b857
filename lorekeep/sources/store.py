"""The knowledge base as Parquet tables, partitioned by topic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.functions.order import numbered
from lorekeep.operators.provenance import CHAIN, build_chain
from lorekeep.session import delete_path

MANIFEST = "topic string, video_id string, seq long, status string, title string, published_at string, fetched_at string, indexed_at string, chunk_count long, error string"
CHUNKS = "chunk_id string, video_id string, chunk_idx int, start_seconds double, end_seconds double, text string, token_count int, kind string, seq long, topic string"
GRAPH = {
    "entities": "topic string, entity_id string, kind string, name string, aliases array<string>, seq long",
    "claims": "topic string, claim_id string, claimant string, text string, stance string, video_id string, chunk_id string, ts double, references array<string>, seq long",
    "relations": "topic string, src string, dst string, kind string, source_claim_id string, seq long",
}
STATES = ("pending", "acquired", "transcribed", "chunked", "embedded", "indexed", "failed")


@dataclass
class TopicStore:
    """Append-only tables chunks, embeddings and manifest under root/topic=...; the last write of a key wins when read.

    ``compact`` rewrites a topic to one row per key.  Appends are whole-file
    commits, so a lost executor or a repeated task leaves no partial row.
    """

    spark: SparkSession
    root: str

    def _path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def _exists(self, table: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self._path(table))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _read(self, table: str, topic: str | None, schema: str) -> DataFrame:
        if not self._exists(table):
            return self.spark.createDataFrame([], schema)
        # The schema is given: a table whose last topic was forgotten has no file to infer it from.
        rows = self.spark.read.schema(schema).parquet(self._path(table))
        return rows.where(F.col("topic") == topic) if topic else rows

    def topics(self) -> DataFrame:
        return self._read("chunks", None, CHUNKS).select("topic").distinct()

    def ingest(self, topic: str, chunks: DataFrame, embeddings: DataFrame, seq: int, at: int | None = None) -> int:
        """Appends chunks, their vectors and a witness entry each; vectors of another size than the topic's are an error.

        ``seq`` numbers the write, ``at`` is the time that the witness states.
        """
        sizes = {r[0] for r in embeddings.select(F.size("embedding").alias("d")).distinct().limit(3).collect()}
        known = self.embeddings(topic)
        if self._exists("embeddings"):
            sizes |= {r[0] for r in known.select(F.size("embedding").alias("d")).distinct().limit(3).collect()}
        if len(sizes) > 1:
            raise ValueError(f"embedding sizes differ: {sorted(sizes)}")
        for table, df in (("chunks", chunks), ("embeddings", embeddings)):
            df.withColumn("topic", F.lit(topic)).withColumn("seq", F.lit(seq).cast("long")).write.partitionBy("topic").mode("append").parquet(self._path(table))
        written = self._read("chunks", topic, CHUNKS).where(F.col("seq") == seq)
        self._attest(topic, written, seq if at is None else at)
        return written.count()

    def _attest(self, topic: str, chunks: DataFrame, at: int) -> None:
        """Appends a witness entry for each chunk, after the topic's last one."""
        last = self.witness(topic).agg(F.max("seq").alias("n"), F.max_by("digest", "seq").alias("head")).first()
        base = last["n"] or 0
        rows = numbered(chunks.select("video_id", "chunk_idx", "chunk_id", "start_seconds"), ["video_id", "chunk_idx", "chunk_id"], "place")
        rows = rows.select(F.lit(topic).alias("topic"), (F.col("place") + 1 + base).alias("seq"), "chunk_id", "video_id", "start_seconds", F.lit(at).cast("long").alias("ingested_at"))
        heads = self.spark.createDataFrame([(topic, last["head"])], "topic string, head string")
        build_chain(rows, heads).write.partitionBy("topic").mode("append").parquet(self._path("witness"))

    def witness(self, topic: str | None = None) -> DataFrame:
        """The chain of all chunks ever ingested; see provenance.verify_chain."""
        return self._read("witness", topic, CHAIN)

    def last_seq(self) -> int:
        """The highest write number of any chunk, -1 for none."""
        top = self._read("chunks", None, CHUNKS).agg(F.max("seq")).first()[0]
        return -1 if top is None else top

    def append_graph(self, table: str, topic: str, rows: DataFrame, seq: int) -> None:
        """Adds entities, claims or relations of a topic."""
        kept = [c.split()[0] for c in GRAPH[table].split(", ") if c.split()[0] not in ("topic", "seq")]
        rows.select(*kept, F.lit(topic).alias("topic"), F.lit(seq).cast("long").alias("seq")).write.partitionBy("topic").mode("append").parquet(self._path(table))

    def graph_table(self, table: str, topic: str | None = None) -> DataFrame:
        """Entities and claims as last written by id; all relations, as parallel ones count."""
        rows = self._read(table, topic, GRAPH[table])
        return rows if table == "relations" else self._last(rows, "topic", {"entities": "entity_id", "claims": "claim_id"}[table])

    @staticmethod
    def _last(df: DataFrame, *key: str) -> DataFrame:
        """The last write of each key; of several in one write the greatest by the other columns."""
        rest = [F.col(c).desc_nulls_last() for c in df.columns if c not in (*key, "seq")]
        place = W.partitionBy(*key).orderBy(F.desc("seq"), *rest)
        return df.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")

    def chunks(self, topic: str | None = None) -> DataFrame:
        return self._last(self._read("chunks", topic, CHUNKS), "topic", "chunk_id")

    def embeddings(self, topic: str | None = None) -> DataFrame:
        return self._last(self._read("embeddings", topic, "topic string, chunk_id string, embedding array<float>, seq long"), "topic", "chunk_id")

    def embedded(self, topic: str, video_id: str | None = None) -> DataFrame:
        rows = self.chunks(topic).drop("seq").join(self.embeddings(topic).select("chunk_id", "embedding"), "chunk_id")
        return rows.where(F.col("video_id") == video_id) if video_id else rows

    def upsert_manifest(self, rows: DataFrame) -> None:
        rows.select(*[c.split()[0] for c in MANIFEST.split(", ")]).write.partitionBy("topic").mode("append").parquet(self._path("manifest"))

    def manifest(self, topic: str | None = None) -> DataFrame:
        return self._last(self._read("manifest", topic, MANIFEST), "topic", "video_id")

    def compact(self, topic: str) -> None:
        """Rewrites a topic's partitions without superseded rows; running it again changes nothing."""
        for table, df in (("chunks", self.chunks(topic)), ("embeddings", self.embeddings(topic)), ("manifest", self.manifest(topic))):
            if self._exists(table):
                kept = f"{self._path('_compact')}/{table}"
                df.write.mode("overwrite").parquet(kept)
                self.spark.read.parquet(kept).write.option("partitionOverwriteMode", "dynamic").partitionBy("topic").mode("overwrite").parquet(self._path(table))
                delete_path(self.spark, self._path("_compact"))

    def forget(self, topic: str) -> None:
        """Removes every table's partition of a topic."""
        for table in ("chunks", "embeddings", "manifest", "witness", *GRAPH, "trajectories", "turns", "feedback", "quiz_cards", "quiz_schedule"):
            delete_path(self.spark, f"{self._path(table)}/topic={topic}")

    def stats(self) -> DataFrame:
        """Per topic: vectors, videos, bytes of text."""
        return self.chunks().groupBy("topic").agg(F.count("*").alias("vectors"), F.count_distinct("video_id").alias("videos"), F.sum(F.octet_length("text")).alias("bytes"))

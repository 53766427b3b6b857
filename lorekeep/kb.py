"""A knowledge base in one object: the commands of a user as methods, each over whole tables of questions, videos or cards."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import summary_markdown, topic_slug
from lorekeep.operators import analytics, chunking, coherence, evaluate, memory, provenance, retrieve, synth
from lorekeep.operators.graph import Graph, pagerank
from lorekeep.sources import readers
from lorekeep.sources.reports import write_summaries
from lorekeep.sources.state import StateLog
from lorekeep.sources.store import TopicStore

#: Exit codes of an answered question: answered, error, no such knowledge base, abstained.
ANSWERED, FAILED, UNKNOWN_TOPIC, ABSTAINED = 0, 1, 2, 3


@dataclass
class KnowledgeBase:
    """Topics under a root folder, with the models that stand in unless others are given."""

    spark: SparkSession
    root: str
    embedder: retrieve.Embedder = field(default_factory=retrieve.HashingEmbedder)
    synthesizer: synth.Synthesizer = field(default_factory=synth.ExtractiveSynthesizer)
    reranker: retrieve.Reranker | None = None

    def __post_init__(self):
        self.store, self.logs = TopicStore(self.spark, self.root), StateLog(self.spark, self.root)

    def slug(self, label: str) -> str:
        """The topic's folder name; an error for a label without letters or digits."""
        slug = self.spark.range(1).select(topic_slug(F.lit(label))).first()[0]
        if slug is None:
            raise ValueError(f"no topic name in {label!r}")
        return slug

    # ---- writing

    def ingest(self, topic: str, segments: DataFrame, at: int, force: bool = False, config: chunking.ChunkConfig = chunking.ChunkConfig()) -> int:
        """Chunks, embeds and stores timed segments of videos that the topic does not hold yet (or all, if forced); returns chunks written.

        ``at`` is the time in seconds that the manifest and the witness state.
        """
        videos = segments.select("video_id").distinct()
        new = videos if force else provenance.new_items(videos, self.store.manifest(topic))
        chunks = chunking.chunk(segments.join(new, "video_id", "left_semi"), config)
        # Written twice by the store, so planned once here.
        chunks = chunks.persist()
        vectors = self.embedder.embed(chunks.select("chunk_id", "text"), "text").select("chunk_id", "embedding")
        seq = self.store.last_seq() + 1
        n = self.store.ingest(topic, chunks, vectors, seq, at)
        none = F.lit(None).cast("string")
        counts = chunks.groupBy("video_id").agg(F.count("*").alias("chunk_count"))
        self.store.upsert_manifest(counts.select(F.lit(topic).alias("topic"), "video_id", F.lit(seq).cast("long").alias("seq"), F.lit("indexed").alias("status"), none.alias("title"), none.alias("published_at"), none.alias("fetched_at"), F.timestamp_seconds(F.lit(at)).cast("string").alias("indexed_at"), "chunk_count", none.alias("error")))
        chunks.unpersist()
        return n

    def summarize(self, topic: str, at: str) -> int:
        """Writes a page for the topic out of the first chunks of its videos."""
        own = memory.summary_sample(self.store.chunks(topic), 1).groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("video_id", "text"))), lambda s: F.concat(F.lit("- "), s["text"])), "\n").alias("body"))
        return write_summaries(own.select("topic", summary_markdown(F.col("topic"), F.lit(at), F.col("body")).alias("markdown")), self.root)

    def compact(self, topic: str) -> None:
        self.store.compact(topic)

    def forget(self, topic: str) -> None:
        self.store.forget(topic)

    def chat(self, topic: str, turns: DataFrame) -> None:
        """Appends turns (session_id, turn_no, role, content)."""
        self.logs.append("turns", topic, turns)

    def feedback(self, topic: str, rows: DataFrame) -> None:
        self.logs.record_feedback(topic, rows)

    # ---- asking

    def hits(self, topic: str, questions: DataFrame, k: int = 10) -> DataFrame:
        """Retrieval for questions (query_id, text), with the text and start of each hit."""
        chunks, vectors = self.store.chunks(topic), self.store.embeddings(topic)
        found = retrieve.Retriever(chunks, vectors, self.embedder, self.reranker).search(questions, max(1, k))
        return found.join(chunks.select("chunk_id", "text", "start_seconds"), "chunk_id")

    def ask(self, topic: str, questions: DataFrame, depth: str = "medium", mode: str = "ask") -> DataFrame:
        """(query_id, text, citations, abstained, exit_code) for questions (query_id, text; format too when applying)."""
        if self.store.chunks(topic).isEmpty():
            none = F.array().cast("array<string>")
            return questions.select("query_id", F.lit("no such knowledge base").alias("text"), none.alias("citations"), F.lit(True).alias("abstained"), F.lit(UNKNOWN_TOPIC).alias("exit_code"))
        hits = self.hits(topic, questions, retrieve.depth_to_k(depth))
        asked = questions.withColumnRenamed("text", "question").withColumn("topic", F.lit(topic))
        told = synth.answer(self.synthesizer, asked, hits, mode)
        return told.withColumn("exit_code", F.when(F.col("abstained"), ABSTAINED).otherwise(ANSWERED))

    def apply(self, topic: str, tasks: DataFrame, depth: str = "medium") -> DataFrame:
        return self.ask(topic, tasks, depth, "apply")

    def continue_chat(self, topic: str, questions: DataFrame) -> DataFrame:
        """(session_id, prompt) for questions (session_id, question): the last turns condensed before each."""
        return memory.condense_history(self.logs.read("turns", topic), questions)

    def compare(self, first: str, second: str, questions: DataFrame, k: int = 10) -> DataFrame:
        """Hits of the first topic, then those of the second that it lacks."""
        hits = [self.hits(t, questions, k).withColumn("key", F.concat_ws("|", "query_id", "chunk_id")) for t in (first, second)]
        return memory.compare_union(hits[0], hits[1], "key").drop("key")

    def quiz(self, topic: str, questions: DataFrame, count: int, seed: int = 0) -> DataFrame:
        """``count`` cards from what each question (query_id, text) finds, in an order that the seed fixes."""
        made = synth.quiz_cards(self.synthesizer, questions.select("query_id", F.lit(topic).alias("topic")), self.hits(topic, questions, count), count)
        return memory.quiz_order(made.withColumn("card_id", F.sha2(F.concat_ws("\n", "chunk_id", "question"), 256)), seed, count)

    def evaluate(self, topic: str, items: DataFrame, k: int = 5) -> DataFrame:
        """Scores of golden items (see evaluate.ITEMS): each is asked, or applied as its mode says."""
        asked = items.select(F.col("id").alias("query_id"), F.when(F.col("mode") == "apply", F.coalesce("apply_task", "question")).otherwise(F.col("question")).alias("text"), F.coalesce("apply_format", F.lit("text")).alias("format"), "mode")
        hits = self.hits(topic, asked, k)
        rows = asked.withColumnRenamed("text", "question").withColumn("topic", F.lit(topic))
        told = None
        for mode in ("ask", "apply"):
            own = rows.where(F.col("mode") == mode).drop("mode")
            part = synth.answer(self.synthesizer, own, hits.join(own.select("query_id"), "query_id", "left_semi"), mode)
            told = part if told is None else told.unionByName(part)
        answers = told.select(F.col("query_id").alias("id"), "text", F.size("citations").alias("n_citations"), "abstained")
        return evaluate.score_items(items, answers)

    # ---- looking

    def list_videos(self, topic: str) -> DataFrame:
        return analytics.listing(self.store.chunks(topic), self.store.manifest(topic))

    def status(self) -> DataFrame:
        """Per topic: vectors, bytes, videos, entities, the latest first."""
        counts = analytics.topic_status(self.store.chunks(), self.store.manifest(), self.store.graph_table("entities"))
        return counts.join(analytics.topics_by_update(self.store.manifest()), "topic", "left").orderBy(F.desc_nulls_last("updated_at"), "topic")

    def graph(self, topic: str) -> Graph:
        return Graph(*[self.store.graph_table(t, topic).drop("topic", "seq") for t in ("entities", "claims", "relations")])

    def who_said(self, topic: str, name: str) -> DataFrame:
        """Claims of the entity that best matches a name, in time order."""
        g = self.graph(topic)
        ranks = pagerank(g.entities.select(F.col("entity_id").alias("node")), g.relations)
        return g.timeline(g.find_entity(name, ranks).select("entity_id"))

    def health(self, topic: str) -> dict:
        return coherence.kb_health(self.store.embeddings(topic), "chunk_id")

    def coherence(self, topic: str) -> dict:
        return coherence.coherence_kpi(self.store.embeddings(topic), "chunk_id")

    def push(self, topic: str, dim: int) -> DataFrame:
        """Vectors with the number of the request that carries them."""
        return readers.push_batches(self.store.embeddings(topic), dim, "chunk_id")

    def schedule(self, cadence: Column) -> Column:
        from lorekeep.functions.text import cadence_cron

        return cadence_cron(cadence)

    # ---- tools of an agent

    def kb_query(self, topic: str, question: str, k: int = 10) -> list[dict]:
        """The hits of one question; k is at least 1."""
        asked = self.spark.createDataFrame([(0, question)], "query_id int, text string")
        return [r.asDict() for r in self.hits(topic, asked, k).orderBy("rank").select("chunk_id", "video_id", "text", "start_seconds", "score", "rank").collect()]

    def kb_synthesize(self, topic: str, question: str) -> dict:
        asked = self.spark.createDataFrame([(0, question)], "query_id int, text string")
        return self.ask(topic, asked).first().asDict()

    def kb_list_videos(self, topic: str) -> list[dict]:
        return [r.asDict() for r in self.list_videos(topic).orderBy("video_id").collect()]

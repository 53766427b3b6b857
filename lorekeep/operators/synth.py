"""Answers from retrieved excerpts: a synthesizer protocol, guarded on both sides."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol, TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.guards import scan_inbound, scan_outbound
from lorekeep.functions.text import abstained, citation_url, context_block, parse_cards
from lorekeep.operators.memory import cards_to_hits

T = TypeVar("T")


class Busy(Exception):
    """The model asks to come back later (HTTP 429 or 503)."""


def with_retries(call: Callable[[], T], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> T:
    """Calls again after 1, 2, ... seconds, doubling, while the model is busy; the last failure is raised."""
    for k in range(attempts):
        try:
            return call()
        except Busy:
            if k + 1 == attempts:
                raise
            sleep(float(2**k))
    raise ValueError("attempts must be positive")


class Synthesizer(Protocol):
    """Each takes one row per question with the prompt's parts and adds ``text``, the model's whole answer."""

    def ask(self, rows: DataFrame) -> DataFrame:
        """rows: query_id, topic, question, context, n_hits."""

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows: query_id, topic, question (the task), format, context, n_hits."""

    def cards(self, rows: DataFrame, count: int) -> DataFrame:
        """rows: query_id, topic, context, n_hits; text is a JSON array of question, answer, chunk_id (the excerpt's number)."""


class ExtractiveSynthesizer:
    """Answers with the first excerpt, cited; abstains without one.  A stand-in where no model is at hand."""

    @staticmethod
    def _first(context: Column) -> Column:
        return F.trim(F.regexp_extract(context, r"(?s)^\[1\] (.*?)\n    \(from video=", 1))

    def ask(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("text", F.when(F.col("n_hits") > 0, F.concat(self._first(F.col("context")), F.lit(" [1]"))).otherwise("ABSTAIN"))

    def apply(self, rows: DataFrame) -> DataFrame:
        head = F.concat(F.lit("("), F.col("format"), F.lit(") "))
        return rows.withColumn("text", F.when(F.col("n_hits") > 0, F.concat(head, self._first(F.col("context")), F.lit(" [1]"))).otherwise("ABSTAIN"))

    def cards(self, rows: DataFrame, count: int) -> DataFrame:
        made = F.transform(F.sequence(F.lit(1), F.least(F.col("n_hits").cast("int"), F.lit(count))), lambda i: F.struct(F.concat(F.lit("What does excerpt "), i.cast("string"), F.lit(" say?")).alias("question"), F.lit("see the excerpt").alias("answer"), i.cast("string").alias("chunk_id")))
        return rows.withColumn("text", F.when(F.col("n_hits") > 0, F.to_json(made)).otherwise("[]"))


def contexts(hits: DataFrame) -> DataFrame:
    """(query_id, context, n_hits, citations) of hits (query_id, rank, chunk_id, video_id, text, start_seconds), numbered from 1 by rank."""
    block = context_block(F.col("rank") + 1, F.col("text"), F.col("video_id"), F.col("start_seconds"))
    url = citation_url(F.lit("https://youtu.be"), F.col("video_id"), F.col("start_seconds"))
    own = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b"), url.alias("u")))).alias("h"))
    return own.select("query_id", F.array_join(F.transform("h", lambda x: x["b"]), "\n\n").alias("context"), F.size("h").alias("n_hits"), F.transform("h", lambda x: x["u"]).alias("citations"))


def answer(synthesizer: Synthesizer, questions: DataFrame, hits: DataFrame, mode: str = "ask") -> DataFrame:
    """(query_id, text, citations, abstained) for questions (query_id, topic, question; format too when applying).

    Questions that the inbound scan blocks never reach the model, answers that
    the outbound scan blocks are withheld; both count as abstained, without
    citations.
    """
    asked = questions.join(contexts(hits), "query_id", "left").na.fill({"context": "", "n_hits": 0}).withColumn("inbound", scan_inbound(F.col("question")))
    safe = asked.where("inbound.verdict = 'safe'").drop("inbound")
    made = (synthesizer.ask if mode == "ask" else synthesizer.apply)(safe).withColumn("outbound", scan_outbound(F.col("text"), F.col("n_hits")))
    none = F.array().cast("array<string>")
    quiet = (F.col("outbound.verdict") != "safe") | abstained(F.col("text"))
    text = F.when(F.col("outbound.verdict") != "safe", F.concat(F.lit("blocked output: "), F.array_join("outbound.reasons", "; "))).otherwise(F.col("text"))
    told = made.select("query_id", text.alias("text"), F.when(quiet, none).otherwise(F.coalesce("citations", none)).alias("citations"), quiet.alias("abstained"))
    blocked = asked.where("inbound.verdict <> 'safe'").select("query_id", F.concat(F.lit("blocked input: "), F.array_join("inbound.reasons", "; ")).alias("text"), none.alias("citations"), F.lit(True).alias("abstained"))
    return told.unionByName(blocked)


def quiz_cards(synthesizer: Synthesizer, topics: DataFrame, hits: DataFrame, count: int) -> DataFrame:
    """Cards of each topic (query_id, topic), joined to the hit that their excerpt number names; numbers out of range are dropped."""
    made = synthesizer.cards(topics.join(contexts(hits), "query_id"), count)
    cards = made.select("query_id", "topic", F.explode(parse_cards(F.col("text"))).alias("c")).select("query_id", "topic", "c.question", "c.answer", F.trim("c.chunk_id").try_cast("int").alias("excerpt")).where("excerpt is not null")
    return cards_to_hits(cards, hits, by=["query_id"]).select("query_id", "topic", "question", "answer", "chunk_id", "video_id", "start_seconds")

"""Corpus cleaning in five stages, each a training-data operator over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import decontaminate, line_templates, near_copies, spm, toxicity
from lorekeep.llm.common import settle, small

#: SQL cannot express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row, so that an operator's columns cannot clash with the documents'."""
    return docs.select("doc_id", "text", F.struct("*").alias("__row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.3; the lexicon is learnt from the labelled rows that are not held out.

    Null and empty texts get the lowest score and stay; equal rows fare alike;
    without labels nothing is toxic; other columns pass, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn(docs, labels, ~toxicity.held_out())
    return toxicity.score_texts(_packed(docs), lexicon, keep=True).where("score < 0.3").select("__row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring line templates leave the texts; n_chars follows.

    A null text stays null; a text of recurring lines only becomes empty; no
    row is dropped; other columns pass, whatever their names.
    """
    cleaned = line_templates.drop_recurring_lines(_packed(docs))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return cleaned.select([new.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, 0.8 or more).

    SimHash links of the vantage-point trees, completed by MinHash bands where
    copies are more than three bits apart; every pair verified.

    Rows without an id stay; of texts without words the one with the smallest id
    stays; rows that repeat an id stay or go together.
    """
    groups = near_copies.near_copies(docs)
    gone = groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept")).where("not kept").select("doc_id")
    # Fewer go than stay: their ids are what is joined, so the texts are not shuffled while they are few.
    return docs.join(small(settle(gone, "gone")), "doc_id", "left_anti").select(docs.columns)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, an empty benchmark drops nothing."""
    return decontaminate.drop_leaky(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), part_overlap=0.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of the decoded text; null texts count as empty."""
    encoded = spm.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaked),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""The training-data operators over their whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import chat_tools, decontaminate, lattice, license_scan, line_templates, simhash, spm, substrings, token_shards, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_shards.write_and_read(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), part_overlap=0.0)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels, ~toxicity.held_out())
    scored = toxicity.score_texts(docs, lexicon)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


REPLY_SCHEMA = {"type": "object", "required": ["text"], "properties": {"after": {"type": "object"}, "text": {"type": "string", "minLength": 1}}, "additionalProperties": False}


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_tools.turns_as_calls(_table(spark, sf_dir, "conversations"))
    linked = chat_tools.link_tool_calls(calls, results, {"reply": REPLY_SCHEMA})
    return linked.select("conv_id", "call_id", "turn", "result_turn", "n_results", "level", "valid", F.size("problems").cast("long").alias("n_problems"), F.sha2("record", 256).alias("record_sha256"))


OP6_SQL = """
WITH calls AS (SELECT conv_id, turn, coalesce(text, '') AS text, 'u' || turn AS call_id, 'u' || CASE WHEN coalesce(conv_id % 2 <> 0, false) THEN turn + 2 ELSE turn - 2 END AS need, coalesce(conv_id % 2 <> 0, false) OR turn >= 2 AS needs FROM conversations WHERE role = 'user'),
runs AS (SELECT conv_id, turn, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM (SELECT DISTINCT conv_id, turn FROM calls WHERE conv_id % 2 <> 0)),
levels AS (SELECT conv_id, turn, (max(turn) OVER (PARTITION BY conv_id, turn % 2, run) - turn) // 2 AS level FROM runs),
results AS (SELECT conv_id, 'u' || (turn - 1) AS call_id, min(turn) AS result_turn, arg_min(coalesce(text, ''), turn) AS rtext, count(*) AS n_results
            FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, r.result_turn, coalesce(r.n_results, 0) AS n_results,
             c.text, r.rtext, c.need, c.needs, (SELECT count(*) FROM calls x WHERE x.conv_id = c.conv_id AND x.call_id = c.need) AS found
      FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id),
p AS (SELECT j.*, CASE WHEN j.turn IS NOT NULL THEN coalesce(level, 0) END AS level, CASE WHEN j.turn IS NULL THEN 1 ELSE (text = '')::BIGINT + (needs AND found = 0)::BIGINT END AS n_problems FROM j LEFT JOIN levels l ON l.conv_id = j.conv_id AND l.turn = j.turn)
SELECT conv_id, call_id, turn, result_turn, n_results, level, n_problems = 0 AS valid, n_problems,
       sha256(CASE WHEN turn IS NULL THEN '{"id":"' || call_id || '","result":' || coalesce(to_json(rtext)::VARCHAR, 'null') || '}'
                   ELSE '{"arguments":{' || CASE WHEN needs THEN '"after":{"$ref":"' || need || '"},' ELSE '' END || '"text":' || to_json(text)::VARCHAR || '},"id":"' || call_id || '","name":"reply","result":' || coalesce(to_json(rtext)::VARCHAR, 'null') || '}' END) AS record_sha256
FROM p
"""


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = line_templates.drop_recurring_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return spm.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), payload=False)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return license_scan.digest(license_scan.scan_licenses(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_token_shards": op1_token_shards,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_simhash": op4_simhash,
        "op5_toxicity": op5_toxicity,
        "op6_tool_calls": op6_tool_calls,
        "op7_lattice": op7_lattice,
        "op8_line_dedup": op8_line_dedup,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_license_scan": op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_tool_calls": OP6_SQL}

"""Append-only logs of a topic: chat turns, trajectories, feedback, quiz cards and their schedule, kept as JSON lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.memory import feedback_quality, spaced_schedule

#: Columns of each log; a row lies under its topic.
LOGS = {
    "turns": "session_id string, turn_no long, role string, content string, asked_at long",
    "trajectories": "id string, task string, mode string, query_embedding array<double>, used_chunk_ids array<string>, outcome_score double, ts long",
    "feedback": "query string, chunk_ids array<string>, outcome string, quality double, ts long",
    "quiz_cards": "card_id string, question string, answer string, chunk_id string, video_id string, start_seconds double",
    "quiz_schedule": "card_id string, response string, days int, due date",
}


@dataclass
class StateLog:
    """Logs under root/<log>/topic=<topic>; appends are whole files, so a failed append leaves no partial line."""

    spark: SparkSession
    root: str

    def _path(self, log: str) -> str:
        if log not in LOGS:
            raise ValueError(f"unknown log {log!r}")
        return f"{self.root.rstrip('/')}/{log}"

    def append(self, log: str, topic: str, rows: DataFrame) -> None:
        """Adds rows in the log's columns; a column they lack is null, others are left out."""
        own = self.spark.createDataFrame([], LOGS[log]).unionByName(rows.select([c for c in rows.columns if c in {x.split()[0] for x in LOGS[log].split(", ")}]), allowMissingColumns=True)
        own.withColumn("topic", F.lit(topic)).write.partitionBy("topic").mode("append").json(self._path(log))

    def read(self, log: str, topic: str | None = None) -> DataFrame:
        """The log's rows; an absent log is empty, a broken line is an error."""
        path = self._path(log)
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], f"{LOGS[log]}, topic string")
        rows = self.spark.read.schema(f"{LOGS[log]}, topic string").option("mode", "FAILFAST").json(path)
        return rows.where(F.col("topic") == topic) if topic else rows

    def record_feedback(self, topic: str, rows: DataFrame) -> None:
        """rows: query, chunk_ids, outcome, ts; the outcome's quality is added."""
        self.append("feedback", topic, rows.withColumn("quality", feedback_quality(F.col("outcome"))))

    def answer_cards(self, topic: str, answers: DataFrame, today) -> None:
        """answers (card_id, response): writes when each card returns, in a log of its own."""
        self.append("quiz_schedule", topic, spaced_schedule(answers, today))

    def session(self, topic: str, session_id: str) -> DataFrame:
        return self.read("turns", topic).where(F.col("session_id") == session_id).orderBy("turn_no")

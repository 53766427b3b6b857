"""Golden sets: loading, validation, scoring."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "id string, question string, mode string, apply_task string, apply_format string, expected_substrings array<string>, forbidden_substrings array<string>, min_citations int, abstain_acceptable boolean"
EXCERPT = 200


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """Items with their topic from a JSON or YAML file (YAML needs the yaml module), read through Spark."""
    raw = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ImportError("YAML golden sets need the yaml module; JSON ones do not") from e
        data = yaml.safe_load(raw)
    else:
        data = json.loads(raw)
    names = [c.split()[0] for c in ITEMS.split(", ")]
    empty = {"expected_substrings": [], "forbidden_substrings": [], "min_citations": 1, "abstain_acceptable": False, "mode": "ask"}
    rows = [tuple([data.get("topic")] + [item.get(n, empty.get(n)) for n in names]) for item in data.get("items", [])]
    return spark.createDataFrame(rows, f"topic string, {ITEMS}")


def validate_golden(items: DataFrame) -> DataFrame:
    """(topic, id, problem) of every broken rule; no rows for a good set."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = F.array(
        F.when(blank("topic"), "blank topic"),
        F.when(blank("id"), "blank id"),
        F.when(blank("question"), "blank question"),
        F.when((F.col("mode") == "apply") & F.col("apply_task").isNull(), "apply without a task"),
        F.when((F.col("min_citations") == 0) & ~F.col("abstain_acceptable"), "no citations needed, yet abstaining not accepted"),
    )
    return items.select("topic", "id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("problem"))


def score_items(items: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per item with an answer (id, text, n_citations, abstained): passed, reasons, excerpt."""
    j = items.join(answers, "id")
    low = F.lower("text")
    held = lambda c: F.exists(c, lambda s: F.instr(low, F.lower(s)) > 0)
    expected = (F.size("expected_substrings") == 0) | held("expected_substrings")
    forbidden = held("forbidden_substrings")
    cited = F.col("n_citations") >= F.col("min_citations")
    reasons = F.filter(F.array(F.when(~expected, "missing expected"), F.when(forbidden, "forbidden present"), F.when(~cited, "too few citations")), lambda r: r.isNotNull())
    return j.select(
        "id",
        "abstained",
        F.when(F.col("abstained"), F.col("abstain_acceptable")).otherwise(F.size(reasons) == 0).alias("passed"),
        F.when(F.col("abstained"), F.array(F.when(F.col("abstain_acceptable"), "abstained, accepted").otherwise("abstained"))).otherwise(reasons).alias("reasons"),
        F.substring("text", 1, EXCERPT).alias("excerpt"),
        "n_citations",
    )


def report(results: DataFrame) -> DataFrame:
    """total, passed, failed, abstained, score (0 for no items)."""
    counts = results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if("abstained").alias("abstained"))
    return counts.select("total", "passed", (F.col("total") - F.col("passed")).alias("failed"), "abstained", F.coalesce(F.try_divide(F.col("passed"), F.col("total")), F.lit(0.0)).alias("score"))

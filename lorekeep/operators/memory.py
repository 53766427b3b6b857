"""Chat history, quiz cards, trajectories and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAIRS, TURN_BYTES = 5, 200
#: Days until a card returns, quality of an outcome.
SPACING = {"knew": 14, "unsure": 4, "wrong": 1}
QUALITY = {"helpful": 0.9, "unhelpful": 0.2, "wrong": 0.0}


def cut_bytes(text: Column, most: int = TURN_BYTES) -> Column:
    """At most ``most`` bytes, cut at a character's border, with an ellipsis where cut."""
    # Characters are summed up to the limit only where the text is longer in bytes.
    chars = F.split(F.substring(text, 1, most), "")
    fit = F.aggregate(chars, F.struct(F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, c: F.when(s["go"] & (s["b"] + F.octet_length(c) <= most), F.struct((s["b"] + F.octet_length(c)).alias("b"), (s["n"] + 1).alias("n"), F.lit(True).alias("go"))).otherwise(F.struct(s["b"].alias("b"), s["n"].alias("n"), F.lit(False).alias("go"))))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.substr(text, F.lit(1), fit["n"]), F.lit("…")))


def condense_history(turns: DataFrame, questions: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(session_id, prompt): the last pairs of turns, shortened, and the question; the bare question without history.

    turns: session_id, turn_no, role (user or assistant count; others are left out), content.
    """
    own = turns.where(F.col("role").isin("user", "assistant"))
    place = W.partitionBy("session_id").orderBy("turn_no")
    numbered = own.withColumn("r", F.row_number().over(place)).withColumn("n", F.count("*").over(W.partitionBy("session_id")))
    skip = F.greatest(F.lit(0), F.floor(F.col("n") / 2) - pairs) * 2
    lines = numbered.where(F.col("r") > skip).select("session_id", "r", F.concat(F.initcap("role"), F.lit(": "), cut_bytes(F.col("content"))).alias("line"))
    said = lines.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda s: s["line"]), "\n").alias("said"))
    prompt = F.concat(F.lit("[Prior conversation (condensed)]:\n"), F.col("said"), F.lit("\n\n[Current question]: "), F.col("question"))
    return questions.join(said, "session_id", "left").select("session_id", F.when(F.col("said").isNull(), F.col("question")).otherwise(prompt).alias("prompt"))


def session_footer(turns: DataFrame) -> DataFrame:
    """Per session: questions, answers, citations ([n] in answers), turns."""
    cites = F.when(F.col("role") == "assistant", F.size(F.regexp_extract_all("content", F.lit(r"\[([0-9]+)\]"), 1))).otherwise(0)
    return turns.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("questions"), F.count_if(F.col("role") == "assistant").alias("answers"), F.sum(cites).cast("long").alias("citations"), F.count("*").alias("turns"))


def spaced_schedule(answers: DataFrame, today: Column) -> DataFrame:
    """answers (card_id, response) with the day the card returns; unknown responses count as wrong."""
    days = F.lit(SPACING["wrong"])
    for name, n in SPACING.items():
        days = F.when(F.col("response") == name, F.lit(n)).otherwise(days)
    return answers.withColumn("days", days).withColumn("due", F.date_add(today, F.col("days")))


def quiz_tally(answers: DataFrame) -> DataFrame:
    return answers.groupBy("response").agg(F.count("*").alias("n"))


def weak_areas(answers: DataFrame, by: str = "video_id") -> DataFrame:
    return answers.where(F.col("response") != "knew").groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def quiz_order(cards: DataFrame, seed: int, n: int) -> DataFrame:
    """n cards in an order fixed by the seed."""
    return cards.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("card_id").cast("string")), 256)).limit(n)


def cards_to_hits(cards: DataFrame, hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cards joined to the hit (of their group) that their excerpt number names, from 1; 0 counts as 1, others out of range are dropped."""
    return cards.where("excerpt >= 0").withColumn("rank", F.greatest(F.col("excerpt"), F.lit(1)) - 1).join(hits, [*(by or []), "rank"])


def trajectory_stats(bank: DataFrame) -> DataFrame:
    return bank.agg(F.count("*").alias("n"), F.coalesce(F.avg("outcome_score"), F.lit(0.0)).alias("avg_score"))


def feedback_quality(outcome: Column) -> Column:
    q = F.lit(None).cast("double")
    for name, v in QUALITY.items():
        q = F.when(outcome == name, F.lit(v)).otherwise(q)
    return q


def summary_sample(chunks: DataFrame, n: int = 10, by: str = "video_id", order: str = "chunk_idx") -> DataFrame:
    """The first n chunks of each group."""
    return chunks.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("r") <= n).drop("r")


def compare_union(a: DataFrame, b: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits of a, then those of b that a lacks."""
    return a.withColumn("side", F.lit("a")).unionByName(b.join(a.select(key), key, "left_anti").withColumn("side", F.lit("b")))

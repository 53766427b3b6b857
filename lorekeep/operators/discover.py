"""Curriculum ranking of candidate videos."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of title, authority, recency, duration, captions.
WEIGHTS = {"title": 0.35, "authority": 0.25, "recency": 0.20, "duration": 0.15, "captions": 0.05}


@dataclass(frozen=True)
class Depth:
    max_videos: int
    long_form: bool
    recency_bias: float

    @property
    def pool_size(self) -> int:
        return {5: 30, 10: 60}.get(self.max_videos, 150)

    @property
    def input_cap(self) -> int:
        return {5: 10, 10: 20}.get(self.max_videos, 50)


DEPTHS = {"quick": Depth(5, False, 0.5), "medium": Depth(10, True, 0.4), "deep": Depth(25, True, 0.3)}


def duration_ok(seconds: Column) -> Column:
    """Half a minute to four hours; unknown durations stay."""
    return seconds.isNull() | seconds.between(30, 14_400)


def authority(views: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log10(F.coalesce(views, F.lit(0)) + 1.0) / 8.0))


def recency(upload_date: Column, as_of: str, bias: float) -> Column:
    """Decay by age in years at a bias; a missing or broken date is worth a half."""
    day = F.try_to_timestamp(upload_date, F.lit("yyyyMMdd")).cast("date")
    age = F.greatest(F.datediff(F.lit(as_of).cast("date"), day), F.lit(0))
    return F.when(~F.coalesce(F.regexp_like(upload_date, F.lit("^[0-9]{8}$")), F.lit(False)) | day.isNull(), 0.5).otherwise(F.exp(-age * F.lit(bias) / 365.0))


def duration_score(seconds: Column, long_form: bool) -> Column:
    """Piecewise: rising to two minutes, again from 0.2 to one at ten minutes, one up to an hour, then falling to the limit."""
    limit = 14_400.0 if long_form else 3_600.0
    d = seconds.cast("double")
    fall = (limit - d) / (limit - 3_600.0) if long_form else F.lit(0.0)
    return (
        F.when(d.isNull(), 0.5)
        .when(d <= 0, 0.0)
        .when(d < 120, d / 120.0)
        .when(d <= 600, 0.2 + 0.8 * (d - 120.0) / 480.0)
        .when(d <= 3_600, 1.0)
        .when(d >= limit, 0.0)
        .otherwise(fall)
    )


def captions_score(has_captions: Column) -> Column:
    return F.when(has_captions.isNull(), 0.5).when(has_captions, 1.0).otherwise(0.0)


def score_candidates(candidates: DataFrame, as_of: str, depth: Depth, title_sim: str | None = None) -> DataFrame:
    """candidates plus score; title_sim names a column of title similarities (0.5 without one)."""
    title = F.coalesce(F.col(title_sim).cast("double"), F.lit(0.5)) if title_sim else F.lit(0.5)
    score = (
        WEIGHTS["title"] * title
        + WEIGHTS["authority"] * authority(F.col("view_count"))
        + WEIGHTS["recency"] * recency(F.col("upload_date"), as_of, depth.recency_bias)
        + WEIGHTS["duration"] * duration_score(F.col("duration_seconds"), depth.long_form)
        + WEIGHTS["captions"] * captions_score(F.col("has_captions"))
    )
    return candidates.withColumn("score", score)


def discover(candidates: DataFrame, captions: DataFrame | None, depth: Depth, as_of: str, title_sim: str | None = None) -> DataFrame:
    """Shortlist with rank from 1: filter, score, look up captions for the best 2n, score again, captioned first.

    ``captions`` (video_id, has_captions) stands for the lookup; None skips the
    gate.  Others than captioned ones follow only if the captioned are fewer
    than the videos wanted.  The lists are short: both windows are top-k limits.
    """
    pool = score_candidates(candidates.where(duration_ok(F.col("duration_seconds"))), as_of, depth, title_sim)
    if captions is None:
        best = pool.orderBy(F.desc("score"), "video_id").limit(depth.input_cap)
        return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "video_id")))
    gate = pool.orderBy(F.desc("score"), "video_id").limit(2 * depth.max_videos).select("video_id").join(captions.withColumnRenamed("has_captions", "__seen"), "video_id")
    looked = pool.join(F.broadcast(gate), "video_id", "left").withColumn("has_captions", F.coalesce("__seen", "has_captions")).drop("__seen")
    scored = score_candidates(looked, as_of, depth, title_sim).withColumn("__own", F.coalesce("has_captions", F.lit(False)))
    n_own = scored.agg(F.sum(F.col("__own").cast("long")).alias("n"))
    kept = scored.join(F.broadcast(n_own), how="cross").where(F.col("__own") | (F.coalesce("n", F.lit(0)) < depth.max_videos))
    best = kept.orderBy(F.desc("__own"), F.desc("score"), "video_id").limit(depth.input_cap)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("__own"), F.desc("score"), "video_id"))).drop("__own", "n")


def heuristic_picks(ranked: DataFrame, n: int) -> DataFrame:
    """The first n of a ranked list."""
    return ranked.where(F.col("rank") <= n)


def known_picks(picks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Picks that name a candidate; others are dropped."""
    return picks.join(candidates.select("video_id", "title"), "video_id")

"""Term counts, two-dimensional maps, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.functions.order import numbered
from lorekeep.functions.text import cloud_words


def word_freq(df: DataFrame, text_col: str = "text", by: list[str] | None = None) -> DataFrame:
    by = by or []
    return df.select(*by, F.explode(cloud_words(F.col(text_col))).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("freq"))


def top_words(df: DataFrame, n: int = 100, text_col: str = "text", by: list[str] | None = None) -> DataFrame:
    """The n most frequent words (of each group), ties by word."""
    counts = word_freq(df, text_col, by)
    if not by:
        return counts.orderBy(F.desc("freq"), "word").limit(n)
    place = W.partitionBy(*by).orderBy(F.desc("freq"), "word")
    return counts.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)


def font_size(freq: Column, most: Column) -> Column:
    return F.greatest(F.lit(12.0), F.least(F.lit(72.0), F.round(72.0 * F.sqrt(freq / most))))


def lerp_colour(share: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """#rrggbb between two colours."""
    parts = [F.lpad(F.lower(F.hex(F.round(F.lit(a) + (F.lit(b) - F.lit(a)) * share).cast("long"))), 2, "0") for a, b in zip(low, high)]
    return F.concat(F.lit("#"), *parts)


def listing(chunks: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Per video: chunks, length, and the manifest's title and date, a dash where it has none."""
    own = chunks.groupBy("video_id").agg(F.count("*").alias("n_chunks"), F.max("end_seconds").alias("seconds"))
    if manifest is None:
        return own
    return own.join(manifest.select("video_id", "title", "published_at"), "video_id", "left").na.fill("—", ["title", "published_at"])


def topic_totals(chunks: DataFrame, topic: str, video: str, size: Column) -> DataFrame:
    """Per topic: vectors, videos, bytes; and a total row with a null topic."""
    return chunks.rollup(topic).agg(F.count("*").alias("vectors"), F.count_distinct(video).alias("videos"), F.sum(size).alias("bytes"))


def subsample(df: DataFrame, by: str, key: Column, most: int = 2_000) -> DataFrame:
    """A stratified sample of at most ``most`` rows: each group its share (one at least), chosen by hash of the key.

    Left-over places go one each to the largest groups.
    """
    counts = df.groupBy(by).agg(F.count("*").alias("__n"))
    total = df.count()
    if total <= most:
        return df
    quota = counts.withColumn("__q", F.greatest(F.lit(1), F.floor(F.col("__n") * most / total)))
    spare = quota.agg(F.greatest(F.lit(0), most - F.sum("__q")).alias("__spare"))
    # One row per group, ranked once.
    quota = quota.crossJoin(F.broadcast(spare)).withColumn("__q", F.col("__q") + (F.row_number().over(W.orderBy(F.desc("__n"), by)) <= F.col("__spare")).cast("int")).select(by, "__q")
    place = W.partitionBy(by).orderBy(F.sha2(key.cast("string"), 256))
    return df.withColumn("__r", F.row_number().over(place)).join(F.broadcast(quota), by).where(F.col("__r") <= F.col("__q")).drop("__r", "__q")


def project_2d(df: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, x, y): first two principal components; each axis points so that its largest loading is positive."""
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vectors = df.select(id_col, array_to_vector(F.col(vector_col).cast("array<double>")).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(vectors)
    loads = model.pc.toArray()
    signs = np.sign(loads[np.abs(loads).argmax(axis=0), range(loads.shape[1])])
    mean = df.select(F.posexplode(vector_col).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("pos").collect()
    shift = np.array([r["x"] for r in mean]) @ loads
    p = vector_to_array("p")
    return model.transform(vectors).select(id_col, ((p[0] - float(shift[0])) * float(signs[0])).alias("x"), ((p[1] - float(shift[1])) * float(signs[1])).alias("y"))


def rescaled(df: DataFrame, cols: list[str], low: float, high: float) -> DataFrame:
    """Columns stretched to low..high; a constant column goes to the middle."""
    ends = df.agg(*[f(c).alias(f"__{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))])
    out = df.crossJoin(F.broadcast(ends))
    for c in cols:
        span = F.col(f"__max_{c}") - F.col(f"__min_{c}")
        out = out.withColumn(c, F.when(span == 0, (low + high) / 2).otherwise(low + (F.col(c) - F.col(f"__min_{c}")) / span * (high - low)))
    return out.select(df.columns)


def cluster_count(n: int) -> int:
    return min(n, max(3, min(12, int(n**0.5))))


def cluster_2d(points: DataFrame, k: int | None = None, rounds: int = 50, id_col: str = "id") -> DataFrame:
    """(id, x, y, cluster) by Lloyd's algorithm from centres evenly spaced in x order; centres are all that moves to the driver."""
    n = points.count()
    if not n:
        return points.select(id_col, "x", "y", F.lit(0).alias("cluster"))
    k = min(n, k or cluster_count(n))
    ordered = numbered(points.select("x", "y", id_col), ["x", "y", id_col], "__r")
    centres = [(r["x"], r["y"]) for r in ordered.where(F.col("__r").isin([i * n // k for i in range(k)])).orderBy("__r").select("x", "y").collect()]

    def nearest(cs) -> Column:
        gaps = F.array(*[F.pow(F.col("x") - a, 2) + F.pow(F.col("y") - b, 2) for a, b in cs])
        return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")

    points = points.select(id_col, "x", "y").persist()
    for _ in range(rounds):
        means = {r["c"]: (r["x"], r["y"]) for r in points.groupBy(nearest(centres).alias("c")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).collect()}
        moved = [means.get(i, c) for i, c in enumerate(centres)]
        if all(abs(a - c) + abs(b - d) < 1e-12 for (a, b), (c, d) in zip(moved, centres)):
            break
        centres = moved
    points.unpersist()
    return points.withColumn("cluster", nearest(centres))


def map_legend(points: DataFrame, topic: str) -> DataFrame:
    """Points of each topic, the largest first: a map's legend."""
    return points.groupBy(topic).agg(F.count("*").alias("n")).orderBy(F.desc("n"), topic)


def cluster_centres(points: DataFrame) -> DataFrame:
    """(cluster, n, x, y): the mean of each cluster's points."""
    return points.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def topic_status(chunks: DataFrame, manifest: DataFrame, entities: DataFrame) -> DataFrame:
    """Per topic: vectors and bytes of its chunks, videos of its manifest, entities of its graph; zero where there are none."""
    own = chunks.groupBy("topic").agg(F.count("*").alias("vectors"), F.sum(F.octet_length("text")).alias("bytes"))
    videos = manifest.groupBy("topic").agg(F.count_distinct("video_id").alias("videos"))
    named = entities.groupBy("topic").agg(F.count_distinct("entity_id").alias("entities"))
    return own.join(videos, "topic", "left").join(named, "topic", "left").na.fill(0, ["videos", "entities"])


def topics_by_update(manifest: DataFrame) -> DataFrame:
    """(topic, updated_at), the latest first: when a video of it was last indexed or fetched."""
    return manifest.groupBy("topic").agg(F.max(F.coalesce("indexed_at", "fetched_at")).alias("updated_at")).orderBy(F.desc_nulls_last("updated_at"), "topic")


def map_svg(points: list[tuple[float, float, str]], width: int = 1000, height: int = 1000) -> str:
    """A scatter of (x, y, label) points already on the canvas, drawn on the driver: maps are samples."""
    from html import escape

    dots = "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3"><title>{escape(label)}</title></circle>' for x, y, label in points)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{dots}</svg>'


def word_cloud_svg(words: list[tuple[str, int]], width: int = 800, height: int = 500) -> str:
    """A small cloud drawn row by row on the driver: words that do not fit are left out."""
    from html import escape

    most = max((f for _, f in words), default=1)
    x, y, line, parts = 10.0, 10.0, 0.0, []
    for word, freq in words:
        size = max(12.0, min(72.0, round(72 * (freq / most) ** 0.5)))
        wide = 0.6 * size * len(word)
        if x + wide > width - 10:
            x, y, line = 10.0, y + line * 1.2, 0.0
        if y + size > height - 10:
            break
        parts.append(f'<text x="{x:.0f}" y="{y + size:.0f}" font-size="{size:.0f}">{escape(word)}</text>')
        x, line = x + wide + 8, max(line, size)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">' + "".join(parts) + "</svg>"

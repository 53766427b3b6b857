"""Shared plumbing: tables in the cluster's shared folder, Arrow settings, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import ARROW_ROWS, arrow_rows, checkpoint_folder, delete_path  # noqa: F401


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, in one folder for the application."""
    return f"{checkpoint_folder(spark)}/lorekeep-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_settled", None)
        if path:
            delete_path(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Deletes all that this application has settled; results not yet written elsewhere go with it."""
    delete_path(spark, f"{checkpoint_folder(spark)}/lorekeep-{spark.sparkContext.applicationId}")


def least_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows with the least hashes of the key, a fixed sample of the table.

    Hashes are spread evenly, so all but little more than the sample is left out
    by its hash, before anything is sorted or sent to one task.
    """
    total, h = df.count(), F.xxhash64(key)
    share = (rows + 10 * rows**0.5 + 50) / max(1, total)
    if share < 1:
        df = df.where(h <= int(share * (1 << 64)) - (1 << 63))
    return df.orderBy(h, key).limit(rows)


#: Rows of a hash or id and at most two short columns that are broadcast: some 10 MB.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """Marks a settled table for broadcast if it was counted to be small; else its join stays a shuffle join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the graph of ``edges`` (src, dst: long), as (node, component).

    Alternates large-star and small-star steps, each a min per node (combined
    before the shuffle) and a join, until the edges are one star per component
    whose centre is its smallest node; they get there in a number of rounds
    that grows with the logarithm of the edges.  Every round ends in a table in
    the shared folder and drops the one before.  Nodes without edges are not returned.
    """
    star = settle(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "cc")
    mark = _mark(star)
    while True:
        both = star.unionByName(star.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        lows = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.join(lows, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        lows = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(lows, "src")
        before, old = mark, star
        star = settle(small.where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(lows.withColumnRenamed("low", "dst")).distinct(), "cc")
        mark = _mark(star)
        release(old)
        if before == mark:
            break
    centres = star.select(F.col("dst").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return star.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(centres)


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge set."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]

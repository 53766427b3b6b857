"""Places in an order over a whole table, without bringing its rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.session import checkpoint_folder


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """df with its place (from 0) in the order of the columns, which should tell all rows apart.

    Rows are dealt by ranges of the order and numbered within each range; the
    numbers of rows before a range are a sum over one row per range.  The dealt
    rows are checkpointed: both passes must see the same ranges.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()).checkpoint()
    # At most one row per partition: small enough for one window and a broadcast.
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__size"))
    before = sizes.select("__range", F.coalesce(F.sum("__size").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(W.partitionBy("__range").orderBy(*order)) - 1
    return dealt.withColumn("__place", place).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")

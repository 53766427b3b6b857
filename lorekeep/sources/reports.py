"""Reports as files: evaluation JSON, summary pages, drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One whole text file on any file system Spark knows, replacing an older one."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_report(results: DataFrame, report: DataFrame, path: str) -> None:
    """Scores of the items and the totals, as JSON lines under path/items and path/totals."""
    results.write.mode("overwrite").json(f"{path.rstrip('/')}/items")
    report.write.mode("overwrite").json(f"{path.rstrip('/')}/totals")


def write_summaries(pages: DataFrame, root: str) -> int:
    """Writes (topic, markdown) pages to root/<topic>.summary.md; a row per topic, streamed through the driver."""
    n = 0
    for r in pages.select("topic", "markdown").toLocalIterator():
        write_text(pages.sparkSession, f"{root.rstrip('/')}/{r['topic']}.summary.md", r["markdown"])
        n += 1
    return n

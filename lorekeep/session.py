"""Session settings shared by tests, bench and jobs."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

#: Rows of an Arrow batch: texts can be long, so Spark's default of 10,000 is too many.
ARROW_ROWS = 500
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow_rows(spark: SparkSession) -> None:
    """Bounds Arrow batches at ARROW_ROWS rows: one bound for all operators, since plans run later than they are built.

    A lower setting of the session stays.
    """
    if int(spark.conf.get(_RECORDS)) > ARROW_ROWS or int(spark.conf.get(_RECORDS)) <= 0:
        spark.conf.set(_RECORDS, str(ARROW_ROWS))


def build_session(app: str = "lorekeep", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE and UTC; ``conf`` entries use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, else the one set on the context.

    Only a local master gets a temporary folder where none is set; on a cluster
    that is an error, since no executor could read another's local files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lorekeep-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any file system Spark knows; nothing happens if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

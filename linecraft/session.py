"""Session factory and delivery of this package to the Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "linecraft", **conf: str) -> SparkSession:
    """A session with the settings that the queries assume: UTC, adaptive execution, ANSI mode."""
    builder = SparkSession.builder.appName(app)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once a context.

    Executors then need no installed copy; the zip goes out by Spark's own file server.
    """
    context = spark.sparkContext
    if getattr(context, "_linecraft_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="linecraft-"), "linecraft.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("linecraft", os.path.relpath(full, here)))
    context.addPyFile(path)
    context._linecraft_shipped = True


#: Rows that a task should hold at most when a step buffers, sorts or hashes its partition.
ROWS_A_TASK = 250_000


def tasks(df: DataFrame) -> int:
    """Partitions for the rows of ``df``: ``ROWS_A_TASK`` in each, at least Spark's own number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_A_TASK))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as its rows need, at least Spark's own number.

    A task's memory then stays the same when the input grows; what groups by more columns than ``keys`` needs no further
    shuffle.  The rows are counted first, which for a projection of Parquet reads its metadata only.
    """
    return df.repartition(tasks(df), *keys)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs inside go when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the one that was given to the context.

    Without either a local folder is made once, but only in a session on this machine alone (``local`` masters); on a
    cluster that is an error, since executors could not see it.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or getattr(context, "_linecraft_shared", None)
    if not found:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = context._linecraft_shared = "file://" + tempfile.mkdtemp(prefix="linecraft-")
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read from there, without its lineage; ``drop`` deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linecraft-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

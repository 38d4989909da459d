"""Session helpers shared by the document operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, swept

#: A word is a run of bytes other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a local folder is made once and set, but only if the session runs on
    this machine alone (``local`` masters); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="linecraft-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linecraft-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` whose successors are written, so that nothing reads them again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Frees, at its end, all tables that were stored inside; calling what it yields on a table keeps that one."""
    made, kept = [], []
    _SCRATCH.append(made)
    try:
        yield lambda df: kept.append(df._stored_at) or df
    finally:
        _SCRATCH.pop()
        free(*(df for df in made if df._stored_at not in kept))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores as it takes to differ from the columns ``taken``."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (0 where the id is null)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Ids up to which a list of documents is broadcast (8 bytes each); beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``ids`` (one column, distinct)."""
    gone = fresh("gone", docs.columns)
    ids = stored(ids.toDF(gone))
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, F.col(key) == F.col(gone), "left_anti")


__all__ = ["WORD", "fold", "free", "fresh", "scratch", "shared_dir", "ship", "size_in_words", "stored", "table", "without"]

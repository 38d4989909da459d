"""Stream-shaped behaviour: logs that arrive late and again, snapshots, forward records, chained ledgers.

The functions on plain DataFrames serve batches and, inside ``foreachBatch``, streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def changed_only(snapshots: DataFrame, key: list[str], order: list[str], content: list[str]) -> DataFrame:
    """Snapshots whose content differs from the one before, by hash."""
    w = Window.partitionBy(*key).orderBy(*order)
    h = F.sha2(F.to_json(F.struct(*content)), 256)
    out = snapshots.withColumn("__h", h).withColumn("__was", F.lag("__h").over(w))
    return out.filter(~F.col("__h").eqNullSafe(F.col("__was"))).drop("__h", "__was")


def sliding(ticks: DataFrame, width: str, step: str, watermark: str | None = None) -> DataFrame:
    """Mean line of every series in sliding windows; with a watermark also on a stream."""
    t = ticks.withWatermark("updated_at", watermark) if watermark else ticks
    return t.groupBy("event", "market", F.window("updated_at", width, step)).agg(F.avg("line").alias("mean"), F.count(F.lit(1)).alias("n"))


def latest_state(ticks: DataFrame) -> DataFrame:
    """The last tick of every series; on a stream the state of each key is one row."""
    return ticks.groupBy("event", "market").agg(F.max_by(F.struct("line", "updated_at", "event_id"), F.struct("updated_at", "event_id")).alias("x")).select("event", "market", "x.*")


def enrich(stream: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Stream rows with the columns of a static table; rows without a match stay."""
    return stream.join(static, key, "left")


def upsert(spark: SparkSession, path: str, key: list[str], version: str, by: str):
    """A ``foreachBatch`` function that merges rows by key: the highest ``version`` stays.

    Only the partitions (``by``) that a batch touches are rewritten, from what they hold and the batch, so
    a batch that is delivered again changes nothing.  The merged rows are written aside in full first, as
    ``<path>_merging``; if a writer is lost while it replaces partitions, the next batch finds that folder
    complete and replaces them from it before it does anything else.
    """
    aside = f"{path.rstrip('/')}_merging"

    def there(folder: str, name: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def finish(schema) -> None:
        spark.read.schema(schema).parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(aside)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    def write(batch: DataFrame, _: int) -> None:
        if there(aside, "_SUCCESS"):  # written in full by a writer that did not come to its end
            finish(batch.schema)
        touched = [r[0] for r in batch.select(by).distinct().collect()]  # partitions of one batch
        if not touched:
            return
        old = read(spark, path, batch.schema).filter(F.col(by).isin(touched))
        rows = old.unionByName(batch.select(*old.columns))
        rest = [c for c in rows.columns if c not in key]
        best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, F.xxhash64(*rest))).alias("x")).select(*key, *(F.col(f"x.{c}").alias(c) for c in rest))
        best.select(*batch.columns).write.mode("overwrite").parquet(aside)
        finish(batch.schema)

    return write


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, empty where it was never written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def paired(ticks: DataFrame, key: list[str], side: str, order: Column) -> DataFrame:
    """The last quote of both sides of a key, where both stand at one line."""
    pick = lambda s: F.max_by(F.when(F.col(side) == s, F.struct("line", "price")), F.when(F.col(side) == s, order))
    out = ticks.groupBy(*key).agg(pick("over").alias("o"), pick("under").alias("u"))
    return out.filter("o.line = u.line").select(*key, F.col("o.line").alias("line"), F.col("o.price").alias("over"), F.col("u.price").alias("under"))


def freeze(frozen: DataFrame, offered: DataFrame, key: list[str], made: str, cutoff: str) -> DataFrame:
    """Frozen forecasts with those offered before the cutoff for keys that have none: the first offer stays."""
    first = offered.filter(F.col(made) < F.col(cutoff)).groupBy(*key).agg(F.min_by(F.struct(*[c for c in offered.columns if c not in key]), made).alias("x"))
    first = first.select(*key, *(F.col(f"x.{c}").alias(c) for c in offered.columns if c not in key))
    return frozen.unionByName(first.join(frozen, key, "left_anti"))


def counted(predictions: DataFrame, key: str, made: str, kickoff: str, value: str) -> DataFrame:
    """Each game's last prediction made before its kickoff; later ones do not count."""
    before = F.col(made) < F.col(kickoff)
    return predictions.groupBy(key).agg(F.max_by(F.when(before, F.col(value)), F.when(before, F.col(made))).alias(value), F.count_if(before).alias("in_time"), F.count_if(~before).alias("late"))


def fill_close(log: DataFrame, closes: DataFrame, key: str) -> DataFrame:
    """A forward log with closing lines filled in where they were open; what is there is never overwritten."""
    c = closes.select(key, F.col("close").alias("__c"))
    return log.join(c, key, "left").withColumn("close", F.coalesce("close", "__c")).drop("__c")


def chained(rows: DataFrame, account: str, order: str, payload: list[str]) -> DataFrame:
    """Rows of each account with a hash over their payload and the hash before.

    A task reads its accounts in order and keeps one hash, so an account of any length is a stream.
    """
    body = F.to_json(F.struct(*payload)).alias("body")
    sorted_rows = rows.select(account, order, body).repartition(account).sortWithinPartitions(account, order)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, begun = None, "", False
        for batch in batches:
            out = []
            for who, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or who != now:
                    now, sha, begun = who, "", True
                sha = hashlib.sha256((sha + text).encode()).hexdigest()
                out.append(sha)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[account, order, "body", "sha"])

    return sorted_rows.mapInArrow(run, f"`{account}` {kinds[account]}, `{order}` {kinds[order]}, body string, sha string")


def broken_links(chain: DataFrame, account: str, order: str) -> DataFrame:
    """Rows whose hash does not follow from their body and the hash before."""
    was = F.lag("sha").over(Window.partitionBy(account).orderBy(order))
    return chain.withColumn("__w", F.sha2(F.concat(F.coalesce(was, F.lit("")), "body"), 256)).filter("__w <> sha").drop("__w")

"""Loading folders of vendor files: a plan from their names, a report of what came of each, sidecars.

One writer at a time: a load holds ``<out>/_lock`` and a second one is refused before it touches anything.  A
lock that a crashed writer left stays until ``unlock`` removes it, or until it has not been renewed for
``stale_after`` seconds if a load is told to take such locks over; every job renews the lock.  Tables are
written aside under a name of the run's own and swapped in: the old table is renamed away first and deleted
last, and what a crash left between the two renames is put back by the next load.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``plays_2023_post_wk1``: table, season, season type and week; ``games_2023``: table and season.  Fixed patterns of the vendor's names.
SEASON_WEEK, SEASON = re.compile(r"(.+)_(\d{4})_(post_)?wk(\d+)"), re.compile(r"(.+)_(\d{4})")
#: Seasons that a name can mean.
YEARS = range(1990, 2036)
#: Stems that are no tables; so are those that begin with an underscore.
SKIPPED = frozenset({"user_info"})
REPORT = "name string, kind string, files int, rows long, error string, loaded_at double"


class LoadInProgress(RuntimeError):
    """Another writer holds the lock."""


@dataclass(frozen=True)
class Job:
    """All files of one table and kind; empty files are left out, ``error`` says why nothing can be loaded."""

    name: str
    kind: str
    paths: tuple[str, ...]
    error: str | None = None


def parse_stem(stem: str) -> tuple[str, int | None, int | None, str | None]:
    """(table, season, week, season type) of a file name without its ending; unknown names stay whole.

    A season without a week leaves the season type to the payload.
    """
    found = SEASON_WEEK.fullmatch(stem)
    if found and int(found[2]) in YEARS:
        return found[1], int(found[2]), int(found[4]), "postseason" if found[3] else "regular"
    found = SEASON.fullmatch(stem)
    if found and int(found[2]) in YEARS:
        return found[1], int(found[2]), None, None
    return stem, None, None, None


def list_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of all files under ``folder``, empty ones and such with a leading underscore too."""
    fs, p = _path(spark, folder)
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        status = found.next()
        out.append((status.getPath().toString(), status.getLen()))
    return sorted(out)


def load_plan(files: list[tuple[str, int]], only: set[str] | None = None, kinds: tuple[str, ...] = ("json", "csv")) -> list[Job]:
    """Jobs of all files, by table; every file is in one job, with an error where it cannot be loaded.

    A table whose files are of several kinds becomes one table a kind, ``<name>_<kind>``.
    """
    groups: dict[tuple[str, str], list[tuple[str, int]]] = {}
    refused: list[Job] = []
    for path, size in files:
        base = path.rsplit("/", 1)[-1]
        stem, _, kind = base.rpartition(".")
        name = parse_stem(stem)[0]
        if kind not in kinds or not stem:
            refused.append(Job(base, kind if stem else "", (path,), "skipped: no reader for this kind"))
        elif stem.startswith("_") or stem in SKIPPED:
            refused.append(Job(base, kind, (path,), "skipped: not a table"))
        elif only is not None and name not in only:
            refused.append(Job(base, kind, (path,), "skipped: not asked for"))
        else:
            groups.setdefault((name, kind), []).append((path, size))
    several = {n for n, k in groups if sum(m == n for m, _ in groups) > 1}
    jobs = []
    for (name, kind), found in sorted(groups.items()):
        paths = tuple(sorted(p for p, size in found if size))
        jobs.append(Job(f"{name}_{kind}" if name in several else name, kind, paths or tuple(sorted(p for p, _ in found)), None if paths else "no non-empty files"))
    return jobs + sorted(refused, key=lambda j: j.paths)


def read_csv(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """CSV with pinned types where a schema is given, sniffed ones where not."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(paths)


def load(spark: SparkSession, jobs: list[Job], out: str, readers: dict, stale_after: float | None = None) -> DataFrame:
    """Write every job's table under ``out`` and return the report; a job that fails is a row with its error.

    The report is also appended to ``<out>/_reports``.  While another writer holds the lock, ``LoadInProgress`` is
    raised and nothing is touched.
    """
    lock = Lock(spark, out, stale_after)
    lock.take()
    rows = []
    try:
        recover(spark, out)
        for job in jobs:
            error, n = job.error, None
            building = f"{out}/_building_{job.name}_{uuid.uuid4().hex}"
            if error is None:
                try:
                    readers[job.kind](spark, list(job.paths)).write.parquet(building)
                    n = spark.read.parquet(building).count()
                    replace(spark, building, f"{out}/{job.name}")
                except Exception as problem:  # the report carries it, other jobs go on
                    error, n = f"{type(problem).__name__}: {str(problem).splitlines()[0] if str(problem) else ''}", None
                    delete(spark, building)
            rows.append((job.name, job.kind, len(job.paths), n, error, time.time()))
            lock.renew()
        report = spark.createDataFrame(rows, REPORT)
        report.coalesce(1).write.mode("append").parquet(f"{out}/_reports")
        return report
    finally:
        lock.release()


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Lock:
    """``<out>/_lock``, a file that only one writer can create; it holds the writer's own token."""

    def __init__(self, spark: SparkSession, out: str, stale_after: float | None = None):
        self.spark, self.path, self.stale_after, self.token = spark, f"{out}/_lock", stale_after, uuid.uuid4().hex
        self.held = False

    def take(self) -> None:
        fs, p = _path(self.spark, self.path)
        if self.stale_after is not None and fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > self.stale_after:
            # of several writers that find it stale, one can rename it
            _, aside = _path(self.spark, f"{self.path}_{self.token}")
            if fs.rename(p, aside):
                fs.delete(aside, False)
        if not fs.createNewFile(p):
            raise LoadInProgress(f"another writer holds {self.path}; wait for it, or unlock() if it has crashed")
        self.held = True

    def renew(self) -> None:
        fs, p = _path(self.spark, self.path)
        fs.setTimes(p, int(time.time() * 1000), -1)

    def release(self) -> None:
        """Only the writer that took the lock can let it go."""
        if self.held:
            fs, p = _path(self.spark, self.path)
            fs.delete(p, False)
            self.held = False


def unlock(spark: SparkSession, out: str) -> None:
    """Remove the lock of a writer that is known to have crashed."""
    fs, p = _path(spark, f"{out}/_lock")
    fs.delete(p, False)


def recover(spark: SparkSession, out: str) -> None:
    """Put back tables that a crash left renamed away, and clear what it left half written.  Under the lock only."""
    fs, p = _path(spark, out)
    for status in fs.listStatus(p) if fs.exists(p) else []:
        name = status.getPath().getName()
        if name.startswith("_old_"):
            _, final = _path(spark, f"{out}/{name[5:-33]}")  # without the run's 32 characters and their underscore
            if fs.exists(final) or not fs.rename(status.getPath(), final):
                fs.delete(status.getPath(), True)
        elif name.startswith("_building_"):
            fs.delete(status.getPath(), True)


def replace(spark: SparkSession, source: str, final: str) -> None:
    """Swap ``source`` in for ``final``; a failure leaves the old table where it was."""
    fs, a = _path(spark, source)
    _, b = _path(spark, final)
    folder, name = final.rsplit("/", 1)
    _, aside = _path(spark, f"{folder}/_old_{name}_{uuid.uuid4().hex}")
    had = fs.exists(b) and fs.rename(b, aside)
    try:
        done = fs.rename(a, b)
    except Py4JJavaError:
        done = False
    if had and done:
        fs.delete(aside, True)
    elif had:
        fs.rename(aside, b)
    if not done:
        raise OSError(f"{source} could not be renamed to {final}")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def write_sidecar(df: DataFrame, path: str, version: str) -> None:
    """A wide feature table with its version, number of rows and time of writing beside it."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    spark = df.sparkSession
    meta = {"version": version, "rows": spark.read.parquet(f"{path}/rows").count(), "written_at": time.time()}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_sidecar(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The feature table; a table of another version is refused."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    if meta["version"] != version:
        raise ValueError(f"features of version {meta['version']}, wanted {version}")
    return spark.read.parquet(f"{path}/rows")


def split_bets(df: DataFrame, sport: str) -> dict[str, DataFrame]:
    """Bet history in scope, out of scope and malformed, by the sport column and the kept raw text."""
    bad = F.col("_bad").isNotNull()
    mine = F.coalesce(F.col("sport") == sport, F.lit(False))
    return {"in_scope": df.filter(~bad & mine), "out_of_scope": df.filter(~bad & ~mine), "malformed": df.filter(bad)}


def mirror(tables: dict[str, DataFrame], url: str, driver: str, schema: str = "") -> None:
    """Copy tables to a JDBC database, one table each; the driver's jar is the session's business."""
    for name, df in tables.items():
        df.write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", f"{schema}{name}").mode("overwrite").save()

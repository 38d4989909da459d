"""Joins and window idioms that the SQL of the domain needs and Spark lacks a word for."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (a total order makes reruns agree)."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__r = 1").drop("__r")


def asof_join(left: DataFrame, right: DataFrame, key: list[str], left_ts: str, right_ts: str, values: list[str], strict: bool = False, tie: str | None = None) -> DataFrame:
    """Left rows with the values of the last right row at or before (``strict``: before) their time.

    Union, one shuffle by key, one window: rows of a key stream through in time order, so no pair of
    rows is ever formed and a key's history needs no memory.  ``tie`` orders right rows of one time.
    """
    names = [f"__v_{v}" for v in values]
    packed = F.struct(*(F.col(v).alias(n) for v, n in zip(values, names, strict=True)))
    schema = left.schema
    keep = F.struct(*left.columns)
    a = left.select(*key, F.col(left_ts).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast("long").alias("__tie"), keep.alias("__left"), F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("__right"))
    b = right.select(*key, F.col(right_ts).alias("__t"), F.lit(1 if strict else 0).alias("__side"), (F.col(tie).cast("long") if tie else F.lit(None).cast("long")).alias("__tie"), F.lit(None).cast(schema).alias("__left"), packed.alias("__right"))
    past = Window.partitionBy(*key).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = a.unionByName(b).withColumn("__found", F.last("__right", ignorenulls=True).over(past)).filter("__left IS NOT NULL")
    return out.select("__left.*", *(F.col(f"__found.{n}").alias(v) for v, n in zip(values, names, strict=True)))


def merge_sources(a: DataFrame, b: DataFrame, key: list[str], values: list[str], names: tuple[str, str]) -> DataFrame:
    """Full outer join of two sources; the first one's values win, ``_source`` tells who had the key."""
    left = a.select(*key, *(F.col(v).alias(f"__a_{v}") for v in values), F.lit(True).alias("__a"))
    right = b.select(*key, *(F.col(v).alias(f"__b_{v}") for v in values), F.lit(True).alias("__b"))
    source = F.when(F.col("__a") & F.col("__b"), "both").when(F.col("__a"), names[0]).otherwise(names[1])
    return left.join(right, key, "full_outer").select(*key, *(F.coalesce(f"__a_{v}", f"__b_{v}").alias(v) for v in values), source.alias("_source"))


def pair_key(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("team_low"), F.greatest(a, b).alias("team_high")]


def islands(df: DataFrame, key: list[str], order: list[str], same: str) -> DataFrame:
    """``run_id``: counts the changes of ``same`` along the order within each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    change = F.when(F.col(same).eqNullSafe(F.lag(same).over(w)), 0).otherwise(1)
    return df.withColumn("__c", change).withColumn("run_id", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__c")


def latest_then(left: DataFrame, right: DataFrame, key: list[str], left_ts: str, right_ts: str, values: list[str], check: Column, tie: str | None = None) -> DataFrame:
    """Left rows whose last right row passes ``check``; an earlier row that passes does not stand in for it."""
    return asof_join(left, right, key, left_ts, right_ts, values, tie=tie).filter(F.coalesce(check, F.lit(False)))


def interval_match(left: DataFrame, right: DataFrame, key: list[str], left_day: str, right_day: str, days: int) -> DataFrame:
    """Pairs of one key whose dates differ by ``days`` at most.

    Right rows lie in one bucket of ``days`` + 1 days, left rows ask the three around their own, so the
    join is by equality and its residual is tested on few pairs.
    """
    width = days + 1
    bucket = lambda c: F.floor(F.unix_date(c) / width)
    asked = left.withColumn("__b", F.explode(F.sequence(bucket(F.col(left_day)) - 1, bucket(F.col(left_day)) + 1)))
    known = right.withColumn("__b", bucket(F.col(right_day)))
    return asked.join(known, [*key, "__b"]).filter(F.abs(F.datediff(left_day, right_day)) <= days).drop("__b")


def fallback_lookup(left: DataFrame, right: DataFrame, key: list[str], season: str, value: str, most: int) -> DataFrame:
    """Left rows with the value of their season, else of up to ``most`` seasons before; ``back`` tells which.

    Each right row is sent to the seasons that it may serve and the nearest one that has a value stays.
    """
    sent = right.filter(F.col(value).isNotNull()).select(*key, F.posexplode(F.sequence(F.col(season), F.col(season) + most)).alias("back", season), value)
    best = sent.groupBy(*key, season).agg(F.min_by(F.struct(value, "back"), "back").alias("__x"))
    return left.join(best, [*key, season], "left").select(left["*"], F.col(f"__x.{value}").alias(value), F.col("__x.back").cast("int").alias("back"))


def quality_row(df: DataFrame, name: str, key: list[str], day: str) -> DataFrame:
    """One row: how many rows, how many beyond one a key, null dates, newest date."""
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col(day).isNull()).alias("__null"), F.max(day).alias("__max"))
    out = per.agg(F.sum("__n").alias("n"), F.sum(F.col("__n") - 1).alias("surplus"), F.sum("__null").alias("null_dates"), F.max("__max").alias("newest"))
    return out.select(F.lit(name).alias("name"), F.lit(", ".join(key)).alias("key"), "*")


#: Ids in a block of ``pairs_within``, and pairs that one of its tasks should make.
BLOCK, PAIRS_A_TASK = 256, 20_000_000


def pairs_within(df: DataFrame, keys: list[str], id: str, block: int = BLOCK) -> DataFrame:
    """All pairs (``first`` < ``second``) of ids whose rows agree in ``keys``, with the keys.

    The result grows with the square of a group, so the pairs are dealt, not the groups: the sorted ids of a group are
    cut into blocks, two blocks are one row, and a row makes its pairs one after the other.  A task holds two blocks, however
    large a group is; a block with itself makes only the pairs that it keeps.
    """
    rows = df.select(*keys, F.col(id).alias("__id")).dropna()
    n = F.col("count").cast("double")
    made = rows.groupBy(*keys).count().agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(made / PAIRS_A_TASK))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__id")) - 1
    blocks = rows.withColumn("__i", F.floor(place / block)).groupBy(*keys, "__i").agg(F.array_sort(F.collect_list("__id")).alias("__a"))
    other = blocks.withColumnsRenamed({"__i": "__j", "__a": "__b"})
    both = blocks.join(other, keys).filter("__i <= __j").repartition(tasks, *keys, "__i", "__j")
    firsts = both.select("*", F.posexplode("__a").alias("__p", "first"))
    later = F.when(F.col("__i") == F.col("__j"), F.slice("__b", F.col("__p") + 2, F.size("__b"))).otherwise(F.col("__b"))
    return firsts.select(*keys, "first", F.explode(later).alias("second")).filter("first < second")

"""Readers and writers of the file formats: vendor JSON, games.csv, bet history, Parquet exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .flatten import spine
from .load import SEASON, SEASON_WEEK, YEARS

GAMES_CSV = "game_id long, season int, week int, home_team string, away_team string, home_conference string, away_conference string, home_points int, away_points int, provider string, spread double, total double, season_type string"
#: What upcoming games have besides, in their own file.
UPCOMING_CSV = f"{GAMES_CSV}, start_date string, start_time_tbd boolean"


def read_games_csv(spark: SparkSession, path: str) -> DataFrame:
    """games.csv in its fixed column order; blanks are null and a missing season type is regular."""
    return spark.read.option("header", True).schema(GAMES_CSV).csv(path).fillna("regular", ["season_type"])


def _in_order(df: DataFrame, schema: str) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return df.select(*(F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names))


def write_games_csv(games: DataFrame, path: str) -> None:
    """games.csv in its fixed column order with a header; nulls are blank, columns that are absent too."""
    _in_order(games, GAMES_CSV).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_upcoming(games: DataFrame, path: str) -> None:
    """Upcoming games: the columns of games.csv, the start as text (blank if unknown) and whether its time is open."""
    out = _in_order(games, UPCOMING_CSV).withColumns({"start_date": F.coalesce(F.col("start_date").cast("string"), F.lit("")), "start_time_tbd": F.coalesce(F.col("start_time_tbd").cast("boolean"), F.lit(False))})
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_upcoming(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(UPCOMING_CSV).csv(path).fillna("regular", ["season_type"])


def slug(name: str) -> str:
    """A name that is safe as a file's: other characters than letters, digits, dash and underscore become one dash; lower case."""
    out = re.sub(r"-{2,}", "-", re.sub(r"[^A-Za-z0-9_-]+", "-", name.strip()).strip("-_")).lower()
    if not out or not re.fullmatch(r"[a-z0-9][a-z0-9_-]*", out):
        raise ValueError(f"nothing of {name!r} can name a file")
    return out


def version_of(name: str) -> tuple[str, int]:
    """Family and version: ``x`` is version 1 of x, ``x-v2`` its second; other digits belong to the name."""
    found = re.fullmatch(r"(.+?)-v(\d+)", name)
    return (found[1], int(found[2])) if found else (name, 1)


def next_version(name: str, taken: list[str]) -> str:
    """The name after the highest version of the family among ``taken``; deleted versions are not used again."""
    base = version_of(name)[0]
    return f"{base}-v{max((v for b, v in map(version_of, taken) if b == base), default=0) + 1}"


def write_seasons(games: DataFrame, path: str) -> None:
    """Replace the seasons that ``games`` holds, keep all others."""
    games.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)


def read_vendor_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """payload (variant), source_file, and season, week and season type: the payload's own, else the file name's.

    A file holds one object or an array of them; each object is a row.  A file of a whole season has no week and
    leaves the season type to its payload.
    """
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("root"), F.input_file_name().alias("source_file"))
    items = F.coalesce(F.try_variant_get("root", "$", "array<variant>"), F.array("root"))
    stem = F.regexp_extract("source_file", r"([^/]+)\.[^./]+$", 1)
    part = lambda pattern, g: F.regexp_extract(stem, f"^(?:{pattern})$", g)
    weekly, whole = part(SEASON_WEEK.pattern, 2), part(SEASON.pattern, 2)
    year = F.when(weekly != "", weekly).when(whole != "", whole).cast("int")
    known = year.between(YEARS[0], YEARS[-1])
    week = F.when(known & (weekly != ""), part(SEASON_WEEK.pattern, 4)).cast("int")
    kind = F.when(week.isNotNull(), F.when(part(SEASON_WEEK.pattern, 3) != "", "postseason").otherwise("regular"))
    rows = raw.select(F.explode(items).alias("payload"), "source_file", F.when(known, year).alias("__season"), week.alias("__week"), kind.alias("__kind"))
    own = F.coalesce(F.try_variant_get("payload", "$.season_type", "string"), F.try_variant_get("payload", "$.seasonType", "string"))
    return spine(rows, F.col("__season"), F.col("__week")).withColumn("season_type", F.coalesce(own, "__kind")).select("payload", "source_file", "season", "week", "season_type")


def read_bet_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The bet export; a leading ``data:text/csv`` line goes, malformed lines keep their text in ``_bad``."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("data:text/csv"))
    parsed = F.from_csv("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(parsed.alias("r")).select("r.*")


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns as ``outer_inner`` columns, to any depth; arrays stay."""

    def leaves(schema: StructType, path: str, name: str) -> list:
        out = []
        for field in schema.fields:
            at, to = f"{path}`{field.name}`", f"{name}{field.name}"
            out += leaves(field.dataType, at + ".", to + "_") if isinstance(field.dataType, StructType) else [F.col(at).alias(to)]
        return out

    return df.select(*leaves(df.schema, "", ""))


def child_table(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Rows of the array ``column`` with a 1-based ``<column>_idx`` and the parent's ``keep`` columns."""
    assert isinstance(df.schema[column].dataType, ArrayType)
    out = df.select(*keep, F.posexplode(column).alias("__pos", "__item"))
    out = out.select(*keep, (F.col("__pos") + 1).alias(f"{column}_idx"), F.col("__item").alias(column))
    return flatten(out)


def child_tables(df: DataFrame, key: list[str], name: str = "") -> dict[str, DataFrame]:
    """A flat table for every array path below ``df``, at any depth, and one for ``df`` itself under ``name``.

    The walk follows the schema: structs become prefixed columns, an array becomes a table of its own, named by the path
    of arrays (``plays__stats``), whose rows carry ``key`` and the 1-based places of all arrays above them and their own
    (``plays_idx``, ``stats_idx``; an array of arrays has ``_idx`` once more).  Items that are no structs are the
    column ``value``.  Null and empty arrays have no rows; null items have one.  Names that clash get an underscore.
    """
    flat = flatten(df)
    arrays = [f.name for f in flat.schema.fields if isinstance(f.dataType, ArrayType) and f.name not in key]
    out = {name: flat.drop(*arrays)}
    for column in arrays:
        path = f"{name}__{column}" if name else column
        place = f"{column.rsplit('__', 1)[-1]}_idx"
        while place in key:
            place += "_"
        items = flat.select(*key, F.posexplode(F.col(f"`{column}`")).alias("__pos", "__item"))
        items = items.select(*key, (F.col("__pos") + 1).alias(place), "__item")
        kind = flat.schema[column].dataType.elementType
        if isinstance(kind, StructType):
            taken = [*key, place]
            inner = [(f.name, f.name + "_" * sum(t.lower() == f.name.lower() for t in taken)) for f in kind.fields]
            items = items.select(*taken, *(F.col(f"__item.`{a}`").alias(b) for a, b in inner))
        else:
            items = items.withColumnRenamed("__item", "value")
        out |= child_tables(items, [*key, place], path)
    return out


def child_sizes(df: DataFrame, name: str = "") -> DataFrame:
    """path and n: the rows of every table of ``child_tables``, counted in one pass without making the tables."""
    found = [(name, F.lit(1))]

    def member(items: Column, field: str) -> Column:
        return F.transform(items, lambda x: x.getField(field))

    def below(items: Column, kind, path: str) -> None:
        """The array paths under ``items``, an array of ``kind``."""
        if isinstance(kind, ArrayType):
            inner = F.flatten(F.filter(items, lambda x: x.isNotNull()))
            add(inner, kind.elementType, f"{path}__value")
        elif isinstance(kind, StructType):
            fields(items, kind, f"{path}__")

    def fields(items: Column, kind: StructType, prefix: str) -> None:
        for field in kind.fields:
            each = member(items, field.name)
            if isinstance(field.dataType, ArrayType):
                add(F.flatten(F.filter(each, lambda x: x.isNotNull())), field.dataType.elementType, prefix + field.name)
            elif isinstance(field.dataType, StructType):
                fields(each, field.dataType, f"{prefix}{field.name}_")

    def add(items: Column, kind, path: str) -> None:
        found.append((path, F.coalesce(F.size(items), F.lit(0))))
        below(items, kind, path)

    fields(F.array(F.struct("*")), df.schema, f"{name}__" if name else "")
    sums = df.agg(*(F.coalesce(F.sum(n.cast("long")), F.lit(0)).alias(f"n{i}") for i, (_, n) in enumerate(found)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(path).alias("path"), F.col(f"n{i}").alias("n")) for i, (path, _) in enumerate(found)))).alias("x")).select("x.*")


def promote_timestamps(df: DataFrame) -> DataFrame:
    """String columns named like dates or times become timestamps where every value parses; one pass."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and ("date" in f.name.lower() or "time" in f.name.lower())]
    if not names:
        return df
    bad = df.agg(*(F.count_if(F.col(f"`{n}`").isNotNull() & F.try_to_timestamp(f"`{n}`").isNull()).alias(n) for n in names)).first()
    return df.withColumns({n: F.to_timestamp(f"`{n}`") for n in names if bad[n] == 0})


def drop_dead(df: DataFrame, names: list[str]) -> DataFrame:
    """Without those of ``names`` that hold no value at all."""
    present = [n for n in names if n in df.columns]
    if not present:
        return df
    seen = df.agg(*(F.count(f"`{n}`").alias(n) for n in present)).first()
    return df.drop(*(n for n in present if seen[n] == 0))

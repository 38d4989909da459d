"""Nested vendor payloads to flat tables: ticks, odds snapshots, grades, rankings, forecasts, scoreboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import latest


def objects(v: Column) -> Column:
    """The members of a JSON object as (key, value)."""
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def tick_flatten(raw: DataFrame) -> DataFrame:
    """Ticks of a payload book -> period -> market -> offers -> history; repeated ticks once.

    ``raw``: game_id and ``payload`` (variant).  A tick is known by all that tells where it stands, when
    and at which number; re-scraped files repeat it.
    """
    out = raw.select("game_id", F.explode(objects(F.col("payload"))).alias("b"))
    out = out.select("game_id", F.col("b.key").alias("book"), F.explode(objects(F.col("b.value"))).alias("p"))
    out = out.select("game_id", "book", F.col("p.key").alias("period"), F.explode(objects(F.col("p.value"))).alias("m"))
    out = out.select("game_id", "book", "period", F.col("m.key").alias("market"), F.explode(F.try_variant_get("m.value", "$", "array<variant>")).alias("o"))
    out = out.select("game_id", "book", "period", "market", F.try_variant_get("o", "$.side", "string").alias("side"), F.explode(F.try_variant_get("o", "$.history", "array<variant>")).alias("h"))
    tick = [F.try_variant_get("h", f"$.{f}", t).alias(f) for f, t in (("moment", "bigint"), ("line", "double"))]
    return out.select("game_id", "book", "period", "market", "side", *tick).dropDuplicates()


def snapshot_flatten(raw: DataFrame) -> DataFrame:
    """Outcomes of an odds snapshot (event -> bookmakers -> markets -> outcomes) with the side they are of.

    An outcome that names neither team nor over or under is an error of the feed and raises.
    """
    each = raw.select("game_id", "home", "away", F.explode("books").alias("b")).select("game_id", "home", "away", F.col("b.book").alias("book"), F.explode("b.outcomes").alias("o"))
    name = F.col("o.name")
    side = F.when(name == F.col("home"), "home").when(name == F.col("away"), "away").when(F.lower(name).isin("over", "under"), F.lower(name)).otherwise(F.raise_error(F.concat(F.lit("no side: "), F.coalesce(name, F.lit("null")))))
    return each.select("game_id", "book", side.alias("side"), F.col("o.price").alias("price"), F.col("o.point").alias("point"))


def split_metrics(wide: DataFrame, key: list[str], splits: list[str]) -> DataFrame:
    """Columns ``<split>_<metric>`` as rows (split, metric, value); the longest split name that fits wins."""
    ordered = sorted(splits, key=lambda s: (-len(s), s))
    values = [c for c in wide.columns if c not in key]
    names = {}
    for c in values:
        of = next((s for s in ordered if c.startswith(s + "_")), None)
        names[c] = (of, c[len(of) + 1 :] if of else c)
    each = F.array(*(F.struct(F.lit(names[c][0]).cast("string").alias("split"), F.lit(names[c][1]).alias("metric"), F.col(c).cast("double").alias("value")) for c in values))
    return wide.select(*key, F.explode(each).alias("x")).select(*key, "x.*").filter("value IS NOT NULL")


def system_ranks(raw: DataFrame, key: list[str], systems: str, ranks: str) -> DataFrame:
    """Parallel arrays of system names and ranks as rows; ranks that are no numbers are left out."""
    each = raw.select(*key, F.explode(F.arrays_zip(systems, ranks)).alias("x"))
    return each.select(*key, F.col(f"x.{systems}").alias("system"), F.col(f"x.{ranks}").try_cast("int").alias("rank")).filter("rank IS NOT NULL")


def newest_forecast(snapshots: DataFrame, now: str, max_age_hours: int) -> DataFrame:
    """Each game's forecast of the newest snapshot that has it, with its age; stale ones are marked."""
    each = snapshots.select("taken_at", F.explode("games").alias("g")).select("taken_at", "g.*")
    age = F.expr(f"timestampdiff(HOUR, taken_at, TIMESTAMP_NTZ'{now}')")
    return latest(each.filter(age >= 0), ["game_id"], [F.desc("taken_at")]).withColumn("age_hours", age).withColumn("stale", age > max_age_hours)


def numbers_or_nan(df: DataFrame, names: list[str]) -> DataFrame:
    """Text columns that hold only numbers or NaN become doubles, NaN null; others stay.  One pass decides."""
    as_number = {n: F.col(n).try_cast("double") for n in names}
    bad = df.agg(*(F.count_if(F.col(n).isNotNull() & as_number[n].isNull()).alias(n) for n in names)).first()
    return df.withColumns({n: F.when(~F.isnan(as_number[n]), as_number[n]) for n in names if bad[n] == 0})


def explode_json(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Rows of a JSON column: members of an array, or of an object whose keys are all numbers; else the value itself.

    ``key`` is the place (from 0) or the object's key; a text that is no JSON gives no row.
    """
    v = F.try_parse_json(column)
    as_array = F.try_variant_get(v, "$", "array<variant>")
    entries = objects(v)
    numeric = F.forall(entries, lambda e: e["key"].rlike(r"^\d+$"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))
    rows = F.when(as_array.isNotNull(), F.transform(as_array, lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))).when(entries.isNotNull() & numeric, entries).when(v.isNotNull(), whole)
    return df.select(*keep, F.explode(rows).alias("x")).select(*keep, "x.key", "x.value")


def infer_struct(df: DataFrame, column: str) -> DataFrame:
    """The members of JSON objects as columns, with a structure merged from every row, not from a sample."""
    schema = df.agg(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).first()["s"]
    ddl = schema.replace("OBJECT<", "STRUCT<") if schema else "STRUCT<>"
    return df.select("*", F.from_json(column, ddl).alias("__x")).select(*df.columns, "__x.*")


def scoreboard_children(games: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Markets, teams and line scores (1-based periods) of scoreboard rows with nested arrays."""
    markets = games.select("game_id", F.explode("markets").alias("m")).select("game_id", "m.*")
    teams = games.select("game_id", F.explode("teams").alias("t")).select("game_id", F.col("t.team").alias("team"), F.col("t.score").alias("score"))
    lines = games.select("game_id", F.explode("teams").alias("t")).select("game_id", F.col("t.team").alias("team"), F.posexplode("t.periods").alias("i", "points"))
    return markets, teams, lines.select("game_id", "team", (F.col("i") + 1).cast("long").alias("period"), "points")


def backfill_lines(vendor: DataFrame, scoreboard: DataFrame, history: DataFrame) -> DataFrame:
    """Vendor lines with gaps filled from scoreboard and ticks that are not live; ``line_source`` tells whose the row is."""
    tape = scoreboard.select("game_id", "book", "market", "line").unionByName(history.filter(~F.col("live")).select("game_id", "book", "market", "line"))
    wide = tape.groupBy("game_id", "book").agg(*(F.max(F.when(F.col("market") == m, F.col("line"))).alias(f"__{m}") for m in ("spread", "total")))
    own = vendor.select("game_id", "book", "spread", "total", F.lit(True).alias("__own"))
    out = own.join(wide.withColumn("__tape", F.lit(True)), ["game_id", "book"], "full_outer")
    source = F.when(F.col("__own") & F.col("__tape"), "both").when(F.col("__own"), "vendor").otherwise("tape")
    return out.select("game_id", "book", *(F.coalesce(m, f"__{m}").alias(m) for m in ("spread", "total")), source.alias("line_source"))


def spine(df: DataFrame, file_season: Column, file_week: Column) -> DataFrame:
    """Season and week of the payload; those of the file name only where the payload lacks the key."""
    own = {c: F.try_variant_get("payload", f"$.{c}", "int") for c in ("season", "week")}
    return df.withColumns({"season": F.coalesce(own["season"], file_season), "week": F.coalesce(own["week"], file_week)})


def resolve_names(asked: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Names with the one id that has them, exactly or as an alternate; several ids are ambiguous.

    ``known``: name, id, ``alternate`` (whether the name is an alternate one).
    """
    per = known.groupBy("name").agg(F.collect_set(F.when(~F.col("alternate"), F.col("id"))).alias("e"), F.collect_set(F.when(F.col("alternate"), F.col("id"))).alias("a"))
    out = asked.join(per.withColumnRenamed("name", "__n"), F.col(name) == F.col("__n"), "left")
    n_e, n_a = F.coalesce(F.size("e"), F.lit(0)), F.coalesce(F.size("a"), F.lit(0))
    how = F.when(n_e == 1, "exact").when(n_e > 1, "ambiguous").when(n_a == 1, "alternate").when(n_a > 1, "ambiguous").otherwise("unknown")
    one = F.when(how == "exact", F.get("e", F.lit(0))).when(how == "alternate", F.get("a", F.lit(0)))
    return out.select(*asked.columns, how.alias("how"), one.alias("id"))

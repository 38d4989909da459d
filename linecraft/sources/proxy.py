"""The domain tables, read from the star schema: games, line tape, ticks and purchases.

Each is a projection of one scan, so filters and column selections reach the Parquet reader.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a game; the spread is home-relative, negative when the home side is favoured."""
    day = F.dayofyear("o_orderdate")
    out = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"),
        F.year("o_orderdate").cast("long").alias("season"),
        (F.floor((day - 1) / 7) + 1).cast("long").alias("week"),
        F.col("o_orderdate").alias("kickoff"),
        F.expr("o_custkey % 40").alias("home_team"),
        F.expr("(o_custkey * 7 + o_orderkey) % 40").alias("away_team"),
        F.expr("CASE WHEN o_orderkey % 29 <> 0 THEN o_orderkey * 31 % 57 END").alias("home_points"),
        F.expr("CASE WHEN o_orderkey % 29 <> 0 THEN o_orderkey * 17 % 50 END").alias("away_points"),
        F.expr("CASE WHEN o_orderkey % 23 <> 0 THEN CAST((o_orderkey * 37 % 57) - 28 AS DOUBLE) / 2 END").alias("spread"),
        F.expr("CASE WHEN o_orderkey % 19 <> 0 THEN 40 + CAST(o_orderkey * 13 % 41 AS DOUBLE) / 2 END").alias("total"),
    )
    return (
        out.filter("home_team <> away_team")
        .withColumn("season_type", F.when(F.col("week") >= 51, "postseason").otherwise("regular"))
        .withColumn("home_conference", F.expr("CASE WHEN home_team % 6 < 5 THEN concat('C', home_team % 6) END"))
        .withColumn("away_conference", F.expr("CASE WHEN away_team % 6 < 5 THEN concat('C', away_team % 6) END"))
    )


GAMES_SQL = """games AS (
  SELECT *, CASE WHEN week >= 51 THEN 'postseason' ELSE 'regular' END AS season_type,
         CASE WHEN home_team % 6 < 5 THEN concat('C', home_team % 6) END AS home_conference,
         CASE WHEN away_team % 6 < 5 THEN concat('C', away_team % 6) END AS away_conference
  FROM (SELECT o_orderkey AS game_id, year(o_orderdate) AS season, 1 + (dayofyear(o_orderdate) - 1) // 7 AS week,
               o_orderdate AS kickoff, o_custkey % 40 AS home_team, (o_custkey * 7 + o_orderkey) % 40 AS away_team,
               CASE WHEN o_orderkey % 29 <> 0 THEN o_orderkey * 31 % 57 END AS home_points,
               CASE WHEN o_orderkey % 29 <> 0 THEN o_orderkey * 17 % 50 END AS away_points,
               CASE WHEN o_orderkey % 23 <> 0 THEN ((o_orderkey * 37 % 57) - 28) / 2.0::DOUBLE END AS spread,
               CASE WHEN o_orderkey % 19 <> 0 THEN 40 + (o_orderkey * 13 % 41) / 2.0::DOUBLE END AS total
        FROM orders) WHERE home_team <> away_team)"""


def line_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of a game by provider; provider 0 is the consensus, 6 and 7 are projection sites."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game_id"),
        F.expr("l_suppkey % 8").alias("provider"),
        F.col("l_linenumber").cast("long").alias("pos"),
        F.expr("CASE WHEN l_partkey % 11 <> 0 THEN (l_quantity - 25) / 2 END").alias("spread"),
        F.expr("CASE WHEN l_partkey % 7 <> 0 THEN (l_quantity - 25 + l_linenumber) / 2 END").alias("spread_open"),
        F.expr("CASE WHEN l_partkey % 5 <> 0 THEN 40 + l_quantity / 2 END").alias("total"),
    )


LINES_SQL = """line_tape AS (
  SELECT l_orderkey AS game_id, l_suppkey % 8 AS provider, l_linenumber::BIGINT AS pos,
         CASE WHEN l_partkey % 11 <> 0 THEN (l_quantity - 25) / 2 END AS spread,
         CASE WHEN l_partkey % 7 <> 0 THEN (l_quantity - 25 + l_linenumber) / 2 END AS spread_open,
         CASE WHEN l_partkey % 5 <> 0 THEN 40 + l_quantity / 2 END AS total
  FROM lineitem)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds ticks: one series per event and market."""
    found = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click"))
    return found.select("event_id", F.col("user_id").alias("event"), F.col("event_type").alias("market"), F.col("ts").alias("updated_at"), F.col("value").alias("line"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return found.select(F.col("event_id").alias("bet_id"), F.col("user_id").alias("event"), F.col("ts").alias("decided_at"), F.col("value").alias("stake"))


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A raw table of the domain, made by ``sql`` from the star schema; ``{name}`` stands for a table."""
    own = {"games": games, "line_tape": line_tape}
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    return spark.sql(sql, **{n: own[n](spark, sf_dir) if n in own else table(spark, sf_dir, n) for n in names})


def ctes(**sql: str) -> str:
    """The same raw tables as common table expressions of DuckDB, after the games and lines."""
    return ", ".join([GAMES_SQL, LINES_SQL, *(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', s)})" for n, s in sql.items())])

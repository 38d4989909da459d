"""Queries of the stream-shaped operators, on batches, and of functions registered in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..registry import query, rounded
from ..sources.proxy import ctes, games, made, table, ticks
from ..session import ship
from ..streaming import logs

SNAPS = "SELECT user_id % 200 AS game_id, event_id, ts, floor(value / 100) AS line, event_type IN ('view', 'click') AS open FROM {events}"
PAIRS = "SELECT l_orderkey AS game_id, CASE WHEN l_linenumber % 2 = 0 THEN 'over' ELSE 'under' END AS side, l_linenumber, l_partkey, floor(l_quantity / 10) AS line, l_suppkey AS price FROM {lineitem}"
OFFERED = "SELECT o_custkey % 400 AS game_id, o_orderkey AS forecast, o_orderdate AS made_at, make_timestamp(1996, 1, 1, 0, 0, 0) AS cutoff FROM {orders}"
FROZEN = "SELECT DISTINCT o_custkey % 400 AS game_id, CAST(-1 AS BIGINT) AS forecast, make_timestamp(1990, 1, 1, 0, 0, 0) AS made_at, make_timestamp(1996, 1, 1, 0, 0, 0) AS cutoff FROM {orders} WHERE o_custkey % 400 < 150"


@query(f"WITH {ctes(s=SNAPS)}, c AS (SELECT *, lag(line) OVER w AS l0, lag(open) OVER w AS o0, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY game_id ORDER BY ts, event_id)) SELECT game_id, event_id, line, open FROM c WHERE r = 1 OR line IS DISTINCT FROM l0 OR open IS DISTINCT FROM o0")
def changed_snapshots(spark, sf):
    """Snapshots that differ from the one before."""
    s = made(spark, sf, SNAPS).withColumn("line", F.col("line").cast("double"))
    return logs.changed_only(s, ["game_id"], ["ts", "event_id"], ["line", "open"]).select("game_id", "event_id", "line", "open")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW), 6) AS mean_24h FROM events WHERE event_type IN ('view', 'click')")
def sliding_mean(spark, sf):
    """Mean of the 24 hours up to each tick."""
    t = ticks(spark, sf).selectExpr("event_id", "avg(line) OVER (PARTITION BY event ORDER BY updated_at RANGE BETWEEN INTERVAL '24' HOUR PRECEDING AND CURRENT ROW) AS m")
    return t.select("event_id", rounded("m").alias("mean_24h"))


@query("WITH b AS (SELECT user_id AS event, event_type AS market, value, unnest(generate_series(time_bucket(INTERVAL '6 hours', ts) - INTERVAL 18 HOUR, time_bucket(INTERVAL '6 hours', ts), INTERVAL 6 HOUR)) AS start FROM events WHERE event_type IN ('view', 'click')) SELECT event, market, start, round(avg(value), 6) AS mean, count(*) AS n FROM b GROUP BY ALL")
def sliding_windows(spark, sf):
    """Windows of 24 hours that start every six."""
    out = logs.sliding(ticks(spark, sf), "24 hours", "6 hours")
    return out.select("event", "market", F.col("window.start").alias("start"), rounded("mean").alias("mean"), "n")


@query("SELECT user_id AS event, event_type AS market, arg_max(value, (ts, event_id)) AS line, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL")
def latest_states(spark, sf):
    return logs.latest_state(ticks(spark, sf)).select("event", "market", "line", "event_id")


@query(f"WITH {ctes(p=PAIRS)}, l AS (SELECT game_id, side, line, price FROM (SELECT *, row_number() OVER (PARTITION BY game_id, side ORDER BY l_linenumber DESC, l_partkey DESC) AS r FROM p) WHERE r = 1) SELECT o.game_id, o.line, o.price AS over, u.price AS under FROM l o JOIN l u ON o.game_id = u.game_id AND o.line = u.line WHERE o.side = 'over' AND u.side = 'under'")
def paired_quotes(spark, sf):
    """The last quote of both sides, where both stand at one line."""
    p = made(spark, sf, PAIRS).withColumn("line", F.col("line").cast("double"))
    return logs.paired(p, ["game_id"], "side", F.struct("l_linenumber", "l_partkey"))


@query(f"WITH {ctes(o=OFFERED, f=FROZEN)}, n AS (SELECT game_id, arg_min(forecast, (made_at, forecast)) AS forecast FROM o WHERE made_at < cutoff GROUP BY game_id) SELECT game_id, forecast FROM f UNION ALL SELECT game_id, forecast FROM n WHERE game_id NOT IN (SELECT game_id FROM f)")
def frozen_forecasts(spark, sf):
    """Forecasts frozen before the cutoff: the first offer stays, offers after it are refused; a rerun changes nothing."""
    offered = made(spark, sf, OFFERED).groupBy("game_id", "made_at", "cutoff").agg(F.min("forecast").alias("forecast")).select("game_id", "forecast", "made_at", "cutoff")
    frozen = made(spark, sf, FROZEN)
    once = logs.freeze(frozen, offered, ["game_id"], "made_at", "cutoff")
    return logs.freeze(once, offered, ["game_id"], "made_at", "cutoff").select("game_id", "forecast")


@query(f"WITH {ctes(o=OFFERED)} SELECT game_id, arg_max(forecast, (made_at, forecast)) FILTER (made_at < cutoff) AS forecast, count(*) FILTER (made_at < cutoff) AS in_time, count(*) FILTER (made_at >= cutoff) AS late FROM o GROUP BY game_id")
def counted_predictions(spark, sf):
    """The last prediction before the kickoff; later ones are counted as late."""
    o = made(spark, sf, OFFERED).withColumns({"made": F.struct("made_at", "forecast"), "kick": F.struct(F.col("cutoff").cast("timestamp_ntz").alias("made_at"), F.lit(-1).cast("long").alias("forecast"))})
    return logs.counted(o, "game_id", "made", "kick", "forecast")


@query(f"WITH {ctes()}, c AS (SELECT game_id, median(total) AS close FROM line_tape GROUP BY game_id) SELECT g.game_id, coalesce(CASE WHEN g.game_id % 2 = 0 THEN g.total END, c.close) AS close FROM games g LEFT JOIN c USING (game_id)")
def forward_log(spark, sf):
    """Closing lines are filled in once; those that stand are kept."""
    log = games(spark, sf).select("game_id", F.when(F.col("game_id") % 2 == 0, F.col("total")).alias("close"))
    from ..sources.proxy import line_tape

    closes = line_tape(spark, sf).groupBy("game_id").agg(F.median("total").alias("close"))
    return logs.fill_close(log, closes, "game_id")


@query("WITH RECURSIVE e AS (SELECT user_id AS account, event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type = 'purchase'), c AS (SELECT account, event_id, i, sha256(body) AS sha FROM e WHERE i = 1 UNION ALL SELECT e.account, e.event_id, e.i, sha256(c.sha || e.body) FROM c JOIN e ON e.account = c.account AND e.i = c.i + 1) SELECT account, event_id, sha, 0 AS broken FROM c")
def ledger_chain(spark, sf):
    """A chain of hashes over every account's entries, and how many of its links do not hold."""
    e = table(spark, sf, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("account"), "event_id", "event_type")
    chain = logs.chained(e, "account", "event_id", ["event_id", "event_type"])
    bad = logs.broken_links(chain, "account", "event_id").select("account", "event_id", F.lit(1).alias("broken"))
    return chain.join(bad, ["account", "event_id"], "left").select("account", "event_id", "sha", F.coalesce("broken", F.lit(0)).alias("broken"))


@query(f"WITH {ctes()} SELECT g.game_id, g.season, round(CASE WHEN g.game_id % 7 = 0 THEN NULL WHEN g.game_id % 2 = 0 THEN (100 + g.game_id % 50) / (200.0::DOUBLE + g.game_id % 50) ELSE 100 / (200.0::DOUBLE + g.game_id % 50) END, 6) AS p FROM games g WHERE season = 1996")
def sql_functions(spark, sf):
    """A scalar and a table function of SQL; the price 0 has no probability."""
    games(spark, sf).createOrReplaceTempView("linecraft_games")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION american_to_prob(a DOUBLE) RETURNS DOUBLE RETURN CASE WHEN a < 0 THEN -a / (-a + 100) WHEN a > 0 THEN 100 / (a + 100) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION season_games(yr INT) RETURNS TABLE (game_id BIGINT, season BIGINT) RETURN SELECT game_id, season FROM linecraft_games WHERE season = yr")
    out = spark.sql("SELECT game_id, season, american_to_prob(CASE WHEN game_id % 7 = 0 THEN 0D WHEN game_id % 2 = 0 THEN CAST(-100 - game_id % 50 AS DOUBLE) ELSE CAST(100 + game_id % 50 AS DOUBLE) END) AS p FROM season_games(1996)")
    return out.select("game_id", "season", rounded("p").alias("p"))


def longest_streak(x: pd.Series) -> int:
    """Longest run of true values, in the order of the rows."""
    best = now = 0
    for v in x:
        now = now + 1 if v else 0
        best = max(best, now)
    return best


@query(f"WITH {ctes()}, b AS (SELECT home_team AS team, season, home_points > away_points AS won, kickoff, game_id FROM games WHERE home_points IS NOT NULL), i AS (SELECT *, row_number() OVER w - row_number() OVER v AS isle FROM b WINDOW w AS (PARTITION BY team, season ORDER BY kickoff, game_id), v AS (PARTITION BY team, season, won ORDER BY kickoff, game_id)), r AS (SELECT team, season, count(*) AS n FROM i WHERE won GROUP BY team, season, isle) SELECT team, season, max(n)::BIGINT AS longest FROM r GROUP BY ALL")
def fold_aggregate(spark, sf):
    """An aggregate that depends on the order, as a pandas fold over a team's few games of a season."""
    ship(spark)
    b = games(spark, sf).filter("home_points IS NOT NULL").select(F.col("home_team").alias("team"), "season", (F.col("home_points") > F.col("away_points")).alias("won"), "kickoff", "game_id")

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"team": [key[0]], "season": [key[1]], "longest": [longest_streak(pdf.sort_values(["kickoff", "game_id"])["won"])]})

    return b.groupBy("team", "season").applyInPandas(fold, "team long, season long, longest long").filter("longest > 0")


@query("SELECT 'games' AS name, 13::BIGINT AS columns UNION ALL SELECT 'line_tape', 6::BIGINT")
def catalog_views(spark, sf):
    """Registered tables and their number of columns, from the catalog."""
    from ..sources.proxy import line_tape

    for name, df in (("games", games(spark, sf)), ("line_tape", line_tape(spark, sf))):
        df.createOrReplaceTempView(f"linecraft_{name}")
    found = [(t.name.removeprefix("linecraft_"), len(spark.catalog.listColumns(t.name))) for t in spark.catalog.listTables() if t.name in ("linecraft_games", "linecraft_line_tape")]
    return spark.createDataFrame(found, "name string, columns long")

"""Queries of the join kinds, window functions, scalar functions and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.stats import norm_quantile, norm_quantile_sql
from ..operators.relational import fallback_lookup, interval_match, latest, latest_then, pairs_within
from ..registry import query, rounded
from ..sources.proxy import GAMES_SQL, LINES_SQL, games, line_tape, table, ticks

TEAM_GAMES_SQL = """tg AS (SELECT game_id, season, week, kickoff, 1 AS is_home, home_team AS team, away_team AS opponent,
   home_points AS points, away_points AS allowed, spread AS line FROM games
 UNION ALL SELECT game_id, season, week, kickoff, 0, away_team, home_team, away_points, home_points, -spread FROM games)"""


@query(f"""WITH {GAMES_SQL}, {LINES_SQL}, a AS (SELECT DISTINCT game_id FROM line_tape WHERE provider <= 3 AND spread IS NOT NULL), b AS (SELECT game_id FROM games WHERE total IS NOT NULL)
 SELECT coalesce(a.game_id, b.game_id) AS game_id, CASE WHEN b.game_id IS NULL THEN 'lines' ELSE 'games' END AS only_in FROM a FULL JOIN b ON a.game_id = b.game_id WHERE a.game_id IS NULL OR b.game_id IS NULL""")
def symmetric_difference(spark, sf):
    """Games that only one of two sources has."""
    a = line_tape(spark, sf).filter("provider <= 3 AND spread IS NOT NULL").select(F.col("game_id").alias("a")).distinct()
    b = games(spark, sf).filter("total IS NOT NULL").select(F.col("game_id").alias("b"))
    out = a.join(b, F.col("a") == F.col("b"), "full_outer").filter("a IS NULL OR b IS NULL")
    return out.select(F.coalesce("a", "b").alias("game_id"), F.when(F.col("b").isNull(), "lines").otherwise("games").alias("only_in"))


@query(f"""WITH {GAMES_SQL}, {LINES_SQL} SELECT season, count(*) AS games, count(*) FILTER (game_id IN (SELECT game_id FROM line_tape WHERE spread IS NOT NULL)) AS with_line,
 count(*) FILTER (NOT EXISTS (SELECT 1 FROM line_tape t WHERE t.game_id = games.game_id AND t.spread IS NOT NULL)) AS without_line FROM games GROUP BY season""")
def semi_and_anti(spark, sf):
    """Games with and without a line by season: a left semi and a left anti join."""
    g, known = games(spark, sf).select("game_id", "season"), line_tape(spark, sf).filter("spread IS NOT NULL").select("game_id")
    sides = g.join(known, "game_id", "left_semi").withColumn("has", F.lit(1)).unionByName(g.join(known, "game_id", "left_anti").withColumn("has", F.lit(0)))
    return sides.groupBy("season").agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("has") == 1).alias("with_line"), F.count_if(F.col("has") == 0).alias("without_line"))


@query(f"""WITH {GAMES_SQL} SELECT a.game_id AS first_game, b.game_id AS second_game, a.kickoff FROM games a JOIN games b ON a.kickoff = b.kickoff AND a.home_conference = b.home_conference AND a.game_id < b.game_id""")
def simultaneous_games(spark, sf):
    """Pairs of one conference with one kickoff: blocks of ids meet, and each two blocks make their pairs."""
    found = pairs_within(games(spark, sf), ["kickoff", "home_conference"], "game_id")
    return found.select(F.col("first").alias("first_game"), F.col("second").alias("second_game"), "kickoff")


@query(f"""WITH {GAMES_SQL}, s AS (SELECT home_team AS team, season, count(home_points) AS n, sum(CASE WHEN home_points > away_points THEN 1 ELSE 0 END) AS w FROM games GROUP BY ALL)
 SELECT a.team, a.season, sum(b.w)::BIGINT AS wins, sum(b.n)::BIGINT AS n, round(sum(b.w) / sum(b.n)::DOUBLE, 6) AS rate FROM s a JOIN s b ON a.team = b.team AND b.season IN (a.season - 1, a.season - 2) GROUP BY a.team, a.season""")
def trailing_rates(spark, sf):
    """Home win rate over the two seasons before: each season is sent to the two it counts for."""
    s = games(spark, sf).groupBy(F.col("home_team").alias("team"), "season").agg(F.count("home_points").alias("n"), F.count_if(F.col("home_points") > F.col("away_points")).alias("w"))
    sent = s.select("team", F.explode(F.array(F.col("season") + 1, F.col("season") + 2)).alias("season"), "n", "w").groupBy("team", "season").agg(F.sum("w").alias("wins"), F.sum("n").alias("n"))
    return sent.join(s.select("team", "season"), ["team", "season"], "left_semi").withColumn("rate", rounded(F.col("wins") / F.col("n")))


@query("""WITH t AS (SELECT user_id AS event, event_id, ts, value FROM events WHERE event_type IN ('view', 'click')), p AS (SELECT event_id AS bet_id, user_id AS event, ts FROM events WHERE event_type = 'purchase'),
 l AS (SELECT p.bet_id, max_by(t.event_id, (t.ts, t.event_id)) AS tick_id FROM p JOIN t ON t.event = p.event AND t.ts <= p.ts GROUP BY p.bet_id)
 SELECT bet_id, tick_id, value AS line FROM l JOIN events ON event_id = tick_id WHERE event_type = 'view'""")
def asof_then_status(spark, sf):
    """The last tick before a decision, kept only if it is of the open market: the check comes after the choice."""
    bets = table(spark, sf, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("bet_id"), F.col("user_id").alias("event"), F.col("ts").alias("decided_at"))
    found = latest_then(bets, ticks(spark, sf).withColumn("at", F.col("updated_at")), ["event"], "decided_at", "at", ["event_id", "market", "line"], F.col("market") == "view", tie="event_id")
    return found.select("bet_id", F.col("event_id").alias("tick_id"), "line")


@query(f"""WITH {GAMES_SQL}, m AS (SELECT q.event_id, g.game_id FROM (SELECT event_id, user_id % 40 AS team, ts FROM events WHERE event_type = 'signup') q JOIN games g ON g.home_team = q.team
  AND abs(date_diff('day', make_date(2024, month(g.kickoff), least(day(g.kickoff), 28)), q.ts::DATE)) <= 3)
 SELECT event_id, count(*) AS hits, min(game_id) AS first_game FROM m GROUP BY event_id""")
def interval_matches(spark, sf):
    """Events matched to games of a team within three days: buckets of days make it an equi join."""
    asked = table(spark, sf, "events").filter("event_type = 'signup'").select("event_id", F.expr("user_id % 40").alias("team"), F.to_date("ts").alias("day"))
    known = games(spark, sf).select("game_id", F.col("home_team").alias("team"), F.expr("make_date(2024, month(kickoff), least(day(kickoff), 28))").alias("on"))
    hits = interval_match(asked, known, ["team"], "day", "on", 3)
    return hits.groupBy("event_id").agg(F.count(F.lit(1)).alias("hits"), F.min("game_id").alias("first_game"))


@query(f"""WITH {GAMES_SQL}, s AS (SELECT season, avg(total) AS mean_total FROM games GROUP BY season), o AS (SELECT avg(total) AS overall FROM games)
 SELECT season, round(mean_total - overall, 6) AS above FROM s CROSS JOIN o""")
def against_average(spark, sf):
    """Each season's mean total against that of all: a cross join with one row."""
    s = games(spark, sf).groupBy("season").agg(F.sum("total").alias("s"), F.count("total").alias("n"))
    all_ = s.agg((F.sum("s") / F.sum("n")).alias("overall"))
    return s.crossJoin(F.broadcast(all_)).select("season", rounded(F.col("s") / F.col("n") - F.col("overall")).alias("above"))


@query(f"""WITH {GAMES_SQL} SELECT game_id, (SELECT count(*) FROM games p WHERE p.home_team = g.home_team AND p.season = g.season AND (p.kickoff, p.game_id) < (g.kickoff, g.game_id)) AS prior_home_games FROM games g""")
def prior_home_games(spark, sf):
    """A correlated count as a running one."""
    w = Window.partitionBy("home_team", "season").orderBy("kickoff", "game_id")
    return games(spark, sf).select("game_id", (F.row_number().over(w) - 1).cast("long").alias("prior_home_games"))


@query(f"""WITH {GAMES_SQL}, r AS (SELECT home_team AS team, season, sum(home_points) AS points FROM games GROUP BY ALL)
 SELECT a.team, a.season, coalesce(b.points, c.points) AS points, CASE WHEN b.points IS NOT NULL THEN 0 WHEN c.points IS NOT NULL THEN 1 END AS back
 FROM (SELECT DISTINCT team, season + 1 AS season FROM r UNION SELECT team, season FROM r) a LEFT JOIN r b ON a.team = b.team AND a.season = b.season LEFT JOIN r c ON a.team = c.team AND a.season = c.season + 1""")
def season_fallback(spark, sf):
    """A team's value of the season, else of the one before."""
    r = games(spark, sf).groupBy(F.col("home_team").alias("team"), "season").agg(F.sum("home_points").alias("points"))
    asked = r.select("team", F.explode(F.array(F.col("season"), F.col("season") + 1)).alias("season")).distinct()
    return fallback_lookup(asked, r, ["team"], "season", "points", 1)


@query(f"""WITH {GAMES_SQL}, n AS (SELECT game_id, list_distinct(['t' || home_team % 10, 't' || away_team % 10, 'u' || home_team // 10, 'u' || away_team // 10]) AS tokens, kickoff::DATE AS day FROM games),
 a AS (SELECT user_id, min(event_id) AS event_id, list_distinct(['t' || user_id % 10, 'u' || user_id // 10 % 4]) AS tokens, DATE '1996-01-01' + (user_id % 700)::INT AS day FROM events GROUP BY user_id),
 h AS (SELECT a.event_id, n.game_id FROM a JOIN n ON a.day = n.day AND len(list_intersect(a.tokens, n.tokens)) = len(a.tokens))
 SELECT event_id, count(*) AS hits, CASE WHEN count(*) = 1 THEN 'matched' ELSE 'ambiguous' END AS verdict, CASE WHEN count(*) = 1 THEN min(game_id) END AS game_id FROM h GROUP BY event_id""")
def name_token_match(spark, sf):
    """Names matched by shared tokens on one day; more than one hit is ambiguous."""
    n = games(spark, sf).select("game_id", F.expr("array_distinct(array(concat('t', home_team % 10), concat('t', away_team % 10), concat('u', home_team div 10), concat('u', away_team div 10)))").alias("known"), F.to_date("kickoff").alias("day"))
    a = table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    a = a.select("event_id", F.expr("array_distinct(array(concat('t', user_id % 10), concat('u', user_id div 10 % 4)))").alias("asked"), F.expr("date_add(DATE'1996-01-01', CAST(user_id % 700 AS INT))").alias("day"))
    # equal questions are asked once and games of one day with the same tokens answer as one row; by day and token, so
    # these meet only where they share one; a game matches if it has all tokens asked for
    n = n.groupBy("day", F.array_sort("known").alias("known")).agg(F.count(F.lit(1)).alias("games"), F.min("game_id").alias("g"))
    a = a.withColumn("asked", F.array_sort("asked"))
    ask = a.select("day", "asked").distinct().select("day", "asked", F.size("asked").alias("need"), F.explode("asked").alias("token"))
    met = ask.join(n.select("day", "known", "games", "g", F.explode("known").alias("token")), ["day", "token"]).groupBy("day", "asked", "known").agg(F.count(F.lit(1)).alias("m"), F.first("need").alias("need"), F.first("games").alias("games"), F.first("g").alias("g")).filter("m = need")
    hits = a.join(met.groupBy("day", "asked").agg(F.sum("games").alias("hits"), F.min("g").alias("g")), ["day", "asked"])
    one = F.col("hits") == 1
    return hits.select("event_id", "hits", F.when(one, "matched").otherwise("ambiguous").alias("verdict"), F.when(one, F.col("g")).alias("game_id"))


@query(f"""WITH {GAMES_SQL}, d AS (SELECT season, game_id, dense_rank() OVER (PARTITION BY season ORDER BY home_points + away_points DESC) AS level, ntile(4) OVER (PARTITION BY season ORDER BY total, game_id) AS quarter,
  row_number() OVER (PARTITION BY season ORDER BY (home_points > away_points) DESC NULLS LAST, week DESC, game_id) AS recency FROM games WHERE home_points IS NOT NULL AND total IS NOT NULL) SELECT * FROM d""")
def rank_kinds(spark, sf):
    """Dense rank, quartile by rank, and a rank whose first key is a truth value."""
    w = Window.partitionBy("season")
    g = games(spark, sf).filter("home_points IS NOT NULL AND total IS NOT NULL")
    return g.select("season", "game_id", F.dense_rank().over(w.orderBy(F.desc(F.col("home_points") + F.col("away_points")))).cast("long").alias("level"), F.ntile(4).over(w.orderBy("total", "game_id")).cast("long").alias("quarter"), F.row_number().over(w.orderBy(F.desc_nulls_last(F.col("home_points") > F.col("away_points")), F.desc("week"), "game_id")).cast("long").alias("recency"))


@query(f"""WITH {GAMES_SQL}, {TEAM_GAMES_SQL}, v AS (SELECT team, season, game_id, kickoff, is_home, CASE WHEN is_home = 1 THEN team ELSE opponent END AS site FROM tg),
 p AS (SELECT *, radians(25 + site % 24) AS lat, radians(-120 + site * 1.5) AS lon FROM v), q AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM p WINDOW w AS (PARTITION BY team, season ORDER BY kickoff, game_id))
 SELECT team, season, round(sum(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((lat - lat0) / 2), 2) + cos(lat0) * cos(lat) * pow(sin((lon - lon0) / 2), 2))))), 4) AS km FROM q GROUP BY team, season""")
def travel(spark, sf):
    """Kilometres between the venues of neighbouring games."""
    from ..operators.running import team_games

    site = F.when(F.col("is_home") == 1, F.col("team")).otherwise(F.col("opponent"))
    p = team_games(games(spark, sf)).select("team", "season", "game_id", "kickoff", F.radians(25 + site % 24).alias("lat"), F.radians(-120 + site * 1.5).alias("lon"))
    w = Window.partitionBy("team", "season").orderBy("kickoff", "game_id")
    p = p.withColumns({"lat0": F.lag("lat").over(w), "lon0": F.lag("lon").over(w)})
    h = F.sin((F.col("lat") - F.col("lat0")) / 2) ** 2 + F.cos("lat0") * F.cos("lat") * F.sin((F.col("lon") - F.col("lon0")) / 2) ** 2
    return p.groupBy("team", "season").agg(rounded(F.sum(2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))), 4).alias("km"))


@query(f"""WITH {LINES_SQL}, v AS (SELECT game_id, provider, sum(total) AS volume FROM line_tape GROUP BY ALL) SELECT * FROM (SELECT *, max(volume) OVER (PARTITION BY game_id) AS top FROM v) WHERE volume >= 0.4 * top""")
def main_books(spark, sf):
    """Books with at least 40 % of the largest volume of their game."""
    v = line_tape(spark, sf).groupBy("game_id", "provider").agg(F.sum("total").alias("volume"))
    return v.withColumn("top", F.max("volume").over(Window.partitionBy("game_id"))).filter("volume >= 0.4 * top")


@query("""WITH t AS (SELECT user_id AS event, event_id, ts, value AS line, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT event, event_id, ts AS updated_at, line FROM t WHERE (i - 1) % 3 = 0 OR i = n""")
def strided(spark, sf):
    """Every third point of a series and always its last."""
    w = Window.partitionBy("event")
    t = ticks(spark, sf).filter("market = 'view'").withColumns({"i": F.row_number().over(w.orderBy("updated_at", "event_id")), "n": F.count(F.lit(1)).over(w)})
    return t.filter("(i - 1) % 3 = 0 OR i = n").select("event", "event_id", "updated_at", "line")


@query(f"""WITH {GAMES_SQL}, d AS (SELECT game_id, kickoff + INTERVAL 1 HOUR * (game_id % 24) AS utc FROM games), e AS (SELECT *, timezone('America/New_York', utc::TIMESTAMP AT TIME ZONE 'UTC') AS et FROM d)
 SELECT game_id, year(et) - (month(et) < 7)::INT AS season, hour(et) AS kickoff_hour, et::DATE::VARCHAR AS day, date_trunc('day', et)::TIMESTAMP + INTERVAL 12 HOUR - INTERVAL 1 DAY * (CASE WHEN dayofweek(et) = 0 THEN 7 ELSE dayofweek(et) END) AS decided_at,
  date_trunc('week', et)::DATE::VARCHAR AS week_of FROM e""")
def calendar(spark, sf):
    """Season, east-coast kickoff hour and day, decision time and week of every kickoff."""
    at = names.eastern(F.col("kickoff") + F.expr("make_dt_interval(0, CAST(game_id % 24 AS INT))"))
    d = games(spark, sf).select("game_id", at.alias("et"))
    return d.select("game_id", names.season_of(F.col("et")).cast("long").alias("season"), F.hour("et").cast("long").alias("kickoff_hour"), F.to_date("et").cast("string").alias("day"), names.decision_time(F.col("et")).alias("decided_at"), F.to_date(F.date_trunc("week", "et")).cast("string").alias("week_of"))


_COMPASS = ", ".join(f"'{c}'" for c in names.CARDINALS)


@query(f"""WITH {GAMES_SQL}, w AS (SELECT game_id, (game_id % 40) / 2.0::DOUBLE AS speed, (game_id * 7 % 360)::DOUBLE AS blows, (home_team * 9 % 180)::DOUBLE AS axis FROM games),
 a AS (SELECT *, least((blows - axis + 360) % 180, 180 - (blows - axis + 360) % 180) AS angle FROM w)
 SELECT game_id, [{_COMPASS}][(floor((blows + 22.5) / 45)::INT % 8) + 1] AS point, round(angle, 6) AS angle, round(abs(speed * cos(radians(angle))), 6) AS along, round(abs(speed * sin(radians(angle))), 6) AS across,
  CASE WHEN speed < 5 THEN 'Calm' WHEN angle <= 30 THEN 'Head-Tail' WHEN angle >= 60 THEN 'Crosswind' ELSE 'Quartering' END AS kind FROM a""")
def wind_geometry(spark, sf):
    w = games(spark, sf).selectExpr("game_id", "(game_id % 40) / 2 AS speed", "CAST(game_id * 7 % 360 AS DOUBLE) AS blows", "CAST(home_team * 9 % 180 AS DOUBLE) AS axis")
    parts = names.wind(F.col("speed"), F.col("blows"), F.col("axis"))
    return w.select("game_id", names.compass(F.col("blows")).alias("point"), *(rounded(parts[c]).alias(c) for c in ("angle", "along", "across")), parts["kind"].alias("kind"))


@query(f"""WITH p AS (SELECT o_orderkey AS quote_id, (1 + o_orderkey % 998) / 999.0::DOUBLE AS p FROM orders) SELECT quote_id, round(p, 6) AS p, round({norm_quantile_sql("p")}, 6) AS z FROM p""")
def normal_quantile(spark, sf):
    """The normal quantile of a probability."""
    p = table(spark, sf, "orders").select(F.col("o_orderkey").alias("quote_id"), ((1 + F.col("o_orderkey") % 998) / F.lit(999.0)).alias("p"))
    return p.select("quote_id", rounded("p").alias("p"), rounded(norm_quantile(F.col("p"))).alias("z"))


@query("""SELECT p_partkey AS part, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS title, split_part(p_name, ' ', 1) AS head, string_split(p_brand, '#')[2]::INT AS brand_no, regexp_replace(p_name, '[aeiou]+', '*', 'g') AS masked,
 starts_with(p_brand, 'Brand#1') AS first_brand, try_cast(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS number, trim('  ' || p_name || ' ') AS bare, TRY_CAST(p_name AS INTEGER) IS NULL AS not_a_number FROM part""")
def string_functions(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("part"), F.concat(F.upper(F.substring("p_name", 1, 1)), F.lower(F.expr("substr(p_name, 2)"))).alias("title"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("head"),
        F.element_at(F.split("p_brand", "#"), 2).cast("int").alias("brand_no"), F.regexp_replace("p_name", "[aeiou]+", "*").alias("masked"), F.col("p_brand").startswith("Brand#1").alias("first_brand"),
        F.regexp_extract("p_brand", "([0-9]+)$", 1).try_cast("bigint").alias("number"), F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("bare"), F.col("p_name").try_cast("int").isNull().alias("not_a_number"),
    )


@query(f"""WITH {GAMES_SQL} SELECT * EXCLUDE (home_conference, away_conference, season_type) REPLACE (coalesce(total, -1.0::DOUBLE) AS total, nullif(home_points, 0) AS home_points), isnan(coalesce(spread, 'NaN'::DOUBLE)) AS no_spread, round(home_points / nullif(away_points, 0)::DOUBLE, 6) AS ratio FROM games""")
def star_modifiers(spark, sf):
    """All columns but some, others replaced, with a test for NaN and a guarded ratio."""
    g = games(spark, sf)
    ratio = rounded(F.col("home_points") / F.nullif(F.col("away_points"), F.lit(0)))
    out = g.select("*", F.isnan(F.coalesce("spread", F.lit(float("nan")))).alias("no_spread"), ratio.alias("ratio")).drop("home_conference", "away_conference", "season_type")
    return out.withColumns({"total": F.coalesce("total", F.lit(-1.0)), "home_points": F.nullif(F.col("home_points"), F.lit(0))})


@query(f"""WITH {GAMES_SQL} SELECT game_id, m.margin, m.size FROM games, LATERAL (SELECT home_points - away_points AS margin, abs(home_points - away_points) AS size) m WHERE m.size > 20""")
def lateral_projection(spark, sf):
    """A derived column that a later one and the filter use."""
    games(spark, sf).createOrReplaceTempView("linecraft_games")
    return spark.sql("SELECT game_id, m.margin, n.size FROM linecraft_games, LATERAL (SELECT home_points - away_points AS margin) m, LATERAL (SELECT abs(m.margin) AS size) n WHERE n.size > 20")


@query(f"""WITH {GAMES_SQL} SELECT game_id, season, 'home' AS side, home_team AS team, NULL::DOUBLE AS total FROM games WHERE spread < -10 UNION ALL BY NAME SELECT game_id, season, total, 'away' AS side, away_team AS team FROM games WHERE spread > 10""")
def union_by_name(spark, sf):
    g = games(spark, sf)
    a = g.filter("spread < -10").select("game_id", "season", F.lit("home").alias("side"), F.col("home_team").alias("team"))
    b = g.filter("spread > 10").select("game_id", "season", "total", F.lit("away").alias("side"), F.col("away_team").alias("team"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""WITH c AS (SELECT 'orders' AS name, 'o_orderkey' AS key, count(*) AS n, count(DISTINCT o_orderkey) AS keys, count(*) FILTER (o_orderdate IS NULL) AS null_dates, max(o_orderdate) AS newest FROM orders
 UNION ALL SELECT 'lineitem', 'l_orderkey, l_linenumber', count(*), count(DISTINCT (l_orderkey, l_linenumber)), count(*) FILTER (l_shipdate IS NULL), max(l_shipdate) FROM lineitem) SELECT name, key, n, n - keys AS surplus, null_dates, newest FROM c""")
def table_quality(spark, sf):
    """Rows beyond one a key, null dates and newest row of each table."""
    from ..operators.relational import quality_row

    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return quality_row(o, "orders", ["o_orderkey"], "o_orderdate").unionByName(quality_row(li, "lineitem", ["l_orderkey", "l_linenumber"], "l_shipdate"))


@query(f"""WITH {LINES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY game_id, provider ORDER BY pos DESC, total, spread) AS r FROM line_tape) SELECT game_id, provider, pos, spread FROM k WHERE r = 1""")
def newest_quote(spark, sf):
    return latest(line_tape(spark, sf), ["game_id", "provider"], [F.desc("pos"), F.asc_nulls_last("total"), F.asc_nulls_last("spread")]).select("game_id", "provider", "pos", "spread")


@query()
def sampled(spark, sf):
    """A tenth of the games by hash: the same rows at every run, whatever the partitioning."""
    return games(spark, sf).filter(F.pmod(F.xxhash64("game_id", F.lit(42)), F.lit(10)) == 0)


@query()
def resampled(spark, sf):
    """A bootstrap resample of the games: each draw names a place among all of them, places are joined with the games.

    Places are counted by part (64 of them, by hash) and from the parts' sizes, so no window runs over all rows.
    """
    g = games(spark, sf).select("game_id", "total").withColumn("part", F.pmod(F.xxhash64("game_id"), F.lit(64)))
    placed = g.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy("game_id")))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("part")))  # 64 rows
    table_ = sizes.agg(F.array_sort(F.collect_list(F.struct((F.col("upto") - F.col("n")).alias("from"), "part"))).alias("parts"), F.sum("n").alias("all"))
    drawn = g.crossJoin(F.broadcast(table_)).select(F.pmod(F.xxhash64("game_id", F.lit(7)), F.col("all")).alias("at"), "parts")
    of = F.element_at(F.filter("parts", lambda x: x["from"] <= F.col("at")), -1)
    draws = drawn.select(of["part"].alias("part"), (F.col("at") - of["from"] + 1).cast("int").alias("rn"))
    return draws.join(placed, ["part", "rn"]).select("game_id", "total")


@query("""SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def distinct_users(spark, sf):
    """The exact count of distinct values; ``approx_count_distinct`` stays within its stated error of it (tested)."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


GRADES_SQL = "gr AS (SELECT l_suppkey % 30 AS team, year(l_shipdate) AS season, 1 + (dayofyear(l_shipdate) - 1) // 7 AS week, avg(l_quantity) AS grade FROM lineitem GROUP BY ALL)"


@query(f"""WITH {GAMES_SQL}, {GRADES_SQL}, b AS (SELECT g.game_id, (SELECT arg_max(grade, week) FROM gr WHERE gr.team = g.home_team AND gr.season = g.season AND gr.week < g.week) AS now, (SELECT arg_max(grade, week) FROM gr WHERE gr.team = g.home_team AND gr.season = g.season - 1) AS was FROM games g) SELECT game_id, round(coalesce(now, was), 6) AS grade, now IS NOT NULL AS current FROM b""")
def grade_before(spark, sf):
    """The last grade of the season before the game's week, else the last one of the season before."""
    from ..operators.relational import asof_join

    li = table(spark, sf, "lineitem")
    gr = li.groupBy(F.expr("l_suppkey % 30").alias("team"), F.year("l_shipdate").cast("long").alias("season"), F.expr("CAST(1 + (dayofyear(l_shipdate) - 1) div 7 AS BIGINT)").alias("at_week")).agg(F.avg("l_quantity").alias("grade"))
    last = gr.groupBy("team", (F.col("season") + 1).alias("season")).agg(F.max_by("grade", "at_week").alias("was"))
    g = games(spark, sf).select("game_id", F.col("home_team").alias("team"), "season", "week")
    out = asof_join(g, gr, ["team", "season"], "week", "at_week", ["grade"], strict=True).join(last, ["team", "season"], "left")
    return out.select("game_id", rounded(F.coalesce("grade", "was")).alias("grade"), F.col("grade").isNotNull().alias("current"))

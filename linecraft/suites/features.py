"""Queries of the feature assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.running import entering, team_games
from ..plans import features as f
from ..registry import query, rounded
from ..sources.proxy import ctes, games, line_tape, made
from .joins import TEAM_GAMES_SQL

STADIUMS = "SELECT l_orderkey % 500 AS id, l_linenumber * 100000 + l_orderkey AS pos, l_suppkey AS capacity, l_partkey AS surface FROM {lineitem}"
TEAM_FILE = "SELECT home_team AS team, season, game_id AS pos, total AS talent, week AS returning_week FROM {games}"
PLAYERS = "SELECT o_custkey % 40 AS team, year(o_orderdate) AS season, CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN 'NaN' ELSE CAST((o_orderkey % 64) / 4.0 AS STRING) END AS wepa FROM {orders} WHERE o_custkey % 13 <> 0"
RATINGS = "SELECT home_team AS team, season, CAST(count(*) AS DOUBLE) AS sp, CAST(sum(week) AS DOUBLE) AS fpi FROM {games} GROUP BY home_team, season"
MEMBERS = "SELECT DISTINCT home_team AS team, season, concat('C', (home_team + season // 2) % 6) AS conference FROM {games} WHERE season <> 1995"
FORECAST = "SELECT game_id, CAST(game_id % 70 AS DOUBLE) AS temperature, CASE WHEN game_id % 4 <> 0 THEN CAST(game_id % 25 AS DOUBLE) END AS wind FROM {games} WHERE game_id % 3 <> 0"
OBSERVED = "SELECT game_id, season, CAST(game_id % 61 AS DOUBLE) AS temperature, CAST(game_id % 23 AS DOUBLE) AS wind FROM {games}"
NOW = "1996-05-17 12:00:00"


def _members(spark, sf):
    return made(spark, sf, MEMBERS.replace("//", "DIV"))


@query(f"WITH {ctes(s=STADIUMS)} SELECT id, capacity, surface FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC, capacity DESC, surface DESC) AS r FROM s) WHERE r = 1")
def rows_by_id(spark, sf):
    """A file by id: the last row wins."""
    s = made(spark, sf, STADIUMS)
    return f.last_row(s.withColumn("pos", F.struct("pos", "capacity", "surface")), ["id"])


@query(f"WITH {ctes(t=TEAM_FILE)} SELECT team, season, arg_max_null(talent, pos) AS talent, arg_max(returning_week, pos) AS returning_week FROM t GROUP BY team, season")
def team_season_rows(spark, sf):
    return f.last_row(made(spark, sf, TEAM_FILE), ["team", "season"])


@query("""SELECT l_orderkey AS game_id, arg_min(l_suppkey % 8, (l_linenumber, l_suppkey, l_quantity)) AS provider, arg_min((l_quantity - 25) / 2, (l_linenumber, l_suppkey, l_quantity)) AS spread FROM lineitem GROUP BY l_orderkey""")
def feed_line(spark, sf):
    """The first line of each game's feed, graded or not."""
    line = F.struct("l_linenumber", "l_suppkey", "l_quantity", (F.col("l_suppkey") % 8).alias("provider"), ((F.col("l_quantity") - 25) / 2).alias("spread"))
    feed = made(spark, sf, "SELECT * FROM {lineitem}").groupBy(F.col("l_orderkey").alias("game_id")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return f.first_element(feed, "lines", ["provider", "spread"])


@query(f"""WITH {ctes()}, c AS (SELECT DISTINCT home_team, season, (home_team * 3 + season) % 60 AS pos FROM games), e AS (SELECT pos, concat('Coach ', pos) AS coach, concat('T', home_team) AS team, season FROM c UNION ALL SELECT pos + 100, concat('Coach ', pos + 100), concat('T', home_team), season FROM c WHERE home_team % 4 = 0)
 SELECT team, season, max_by(coach, pos) AS coach FROM e GROUP BY team, season""")
def head_coach(spark, sf):
    """The last coach of a file for each team and season; teams come as texts or as objects."""
    c = made(spark, sf, "SELECT DISTINCT home_team, season, (home_team * 3 + season) % 60 AS pos FROM {games}")
    both = c.unionByName(c.filter("home_team % 4 = 0").withColumn("pos", F.col("pos") + 100))
    item = F.expr("CASE WHEN home_team % 2 = 0 THEN concat('{\"team\": {\"name\": \"T', home_team, '\"}, \"year\": ', season, '}') ELSE concat('{\"team\": \"T', home_team, '\", \"year\": ', season, '}') END")
    files = both.groupBy("pos").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(item)), ", "), F.lit("]")).alias("seasons"))
    return f.head_coach(files.select("pos", F.concat(F.lit("Coach "), "pos").alias("coach"), "seasons"))


@query(f"""WITH {ctes(p=PLAYERS)} SELECT team, season + 1 AS season, sum(v) AS wepa FROM (SELECT team, season, try_cast(wepa AS DOUBLE) AS v FROM p) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY team, season""")
def prior_player_sum(spark, sf):
    return f.prior_season_sum(made(spark, sf, PLAYERS), "wepa", "wepa").select("team", F.col("season").cast("long").alias("season"), "wepa")


@query(f"""WITH {ctes(r=RATINGS)} SELECT g.game_id, h.sp AS home_prior_sp, a.sp AS away_prior_sp, h.fpi - a.fpi AS fpi_gap FROM games g LEFT JOIN r h ON h.team = g.home_team AND h.season = g.season - 1 LEFT JOIN r a ON a.team = g.away_team AND a.season = g.season - 1""")
def prior_ratings(spark, sf):
    """Ratings of the season before on both sides of every game."""
    r = f.prior_season(made(spark, sf, RATINGS), {"sp": "prior_sp", "fpi": "prior_fpi"})
    out = f.assemble(games(spark, sf).select("game_id", "season", "home_team", "away_team"), [], [r])
    return out.select("game_id", "home_prior_sp", "away_prior_sp", (F.col("home_prior_fpi") - F.col("away_prior_fpi")).alias("fpi_gap"))


@query(f"""WITH {ctes(m=MEMBERS)} SELECT m.team, m.season, CASE WHEN m.season - 1 IN (SELECT season FROM m) THEN m.conference IS DISTINCT FROM w.conference END AS conference_changed FROM m LEFT JOIN m w ON w.team = m.team AND w.season = m.season - 1""")
def conference_change(spark, sf):
    return f.conference_change(_members(spark, sf))


@query(f"""WITH {ctes()} SELECT game_id, CASE WHEN p BETWEEN 0 AND 1 THEN p END AS home_win, CASE WHEN p BETWEEN 0 AND 1 THEN 1 - p END AS away_win FROM (SELECT game_id, (game_id % 80 - 8) / 64.0::DOUBLE AS p FROM games)""")
def win_probability(spark, sf):
    p = games(spark, sf).select("game_id", ((F.col("game_id") % 80 - 8) / F.lit(64.0)).alias("p"))
    home, away = f.probability_pair(F.col("p"))
    return p.select("game_id", home.alias("home_win"), away.alias("away_win"))


@query(f"""WITH {ctes()} SELECT game_id, median(spread) - median(spread_open) AS line_move FROM line_tape WHERE provider BETWEEN 1 AND 5 GROUP BY game_id""")
def line_moves(spark, sf):
    return f.line_moves(line_tape(spark, sf).filter("provider BETWEEN 1 AND 5"), "spread", "spread_open")


@query(f"""WITH {ctes(b=OBSERVED, w=FORECAST)} SELECT b.game_id, season, CASE WHEN season >= 1997 THEN coalesce(w.temperature, b.temperature) ELSE b.temperature END AS temperature, CASE WHEN season >= 1997 THEN coalesce(w.wind, b.wind) ELSE b.wind END AS wind FROM b LEFT JOIN w USING (game_id)""")
def weather_overlay(spark, sf):
    return f.overlay(made(spark, sf, OBSERVED), made(spark, sf, FORECAST), ["temperature", "wind"], F.col("season") >= 1997)


@query(f"""WITH {ctes()}, s AS (SELECT season, week, min(kickoff) AS a, max(kickoff) AS b, max(kickoff) FILTER (home_points IS NOT NULL) AS done FROM games GROUP BY ALL)
 SELECT season, week FROM s WHERE a <= TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' <= b""")
def target_week(spark, sf):
    return f.target_week(games(spark, sf), NOW)


_ROWS = f"""{ctes()}, t AS (SELECT season, week FROM games GROUP BY ALL HAVING min(kickoff) <= TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' <= max(kickoff)),
 base AS (SELECT g.*, g.week = t.week AS is_target FROM games g JOIN t USING (season) WHERE g.week = t.week OR (g.home_points IS NOT NULL AND g.week < t.week))"""


@query(f"""WITH {_ROWS}, {TEAM_GAMES_SQL.replace("FROM games", "FROM base")}, p AS (SELECT game_id, team, count(points - allowed) OVER w AS games_played, round(avg(points) OVER (PARTITION BY team, season ORDER BY kickoff, game_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS last3_points FROM tg
  WINDOW w AS (PARTITION BY team, season ORDER BY kickoff, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT p.* FROM p JOIN base USING (game_id) WHERE is_target""")
def upcoming_stats(spark, sf):
    """Running statistics of a target week, over the season's completed games and the week itself."""
    base = f.upcoming_base(games(spark, sf), f.target_week(games(spark, sf), NOW))
    stats = entering(team_games(base)).select("game_id", "team", "games_played", "last3_points")
    return stats.join(base.filter("is_target").select("game_id"), "game_id", "left_semi")


@query(f"""WITH {ctes(r=RATINGS, t=TEAM_FILE, m=MEMBERS)}, tl AS (SELECT team, season, arg_max_null(talent, pos) AS talent FROM t GROUP BY team, season), mv AS (SELECT game_id, median(spread) - median(spread_open) AS line_move FROM line_tape WHERE provider BETWEEN 1 AND 5 GROUP BY game_id),
 cc AS (SELECT m.team, m.season, CASE WHEN m.season - 1 IN (SELECT season FROM m) THEN m.conference IS DISTINCT FROM w.conference END AS changed FROM m LEFT JOIN m w ON w.team = m.team AND w.season = m.season - 1),
 {TEAM_GAMES_SQL}, e AS (SELECT game_id, team, count(points - allowed) OVER w AS games_played FROM tg WINDOW w AS (PARTITION BY team, season ORDER BY kickoff, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT g.game_id, mv.line_move, h.talent AS home_talent, a.talent AS away_talent, hr.sp AS home_prior_sp, ar.sp AS away_prior_sp, hc.changed AS home_changed, ac.changed AS away_changed, he.games_played AS home_games_played, ae.games_played AS away_games_played
 FROM games g LEFT JOIN mv USING (game_id) LEFT JOIN tl h ON h.team = home_team AND h.season = g.season LEFT JOIN tl a ON a.team = away_team AND a.season = g.season LEFT JOIN r hr ON hr.team = home_team AND hr.season = g.season - 1 LEFT JOIN r ar ON ar.team = away_team AND ar.season = g.season - 1
 LEFT JOIN cc hc ON hc.team = home_team AND hc.season = g.season LEFT JOIN cc ac ON ac.team = away_team AND ac.season = g.season LEFT JOIN e he ON he.game_id = g.game_id AND he.team = home_team LEFT JOIN e ae ON ae.game_id = g.game_id AND ae.team = away_team""")
def wide_game_row(spark, sf):
    """Every feature of a game in one row: game indexes, and team indexes for both sides."""
    g = games(spark, sf).select("game_id", "season", "home_team", "away_team")
    moves = f.line_moves(line_tape(spark, sf).filter("provider BETWEEN 1 AND 5"), "spread", "spread_open")
    talent = f.last_row(made(spark, sf, TEAM_FILE), ["team", "season"]).select("team", "season", "talent")
    prior = f.prior_season(made(spark, sf, RATINGS), {"sp": "prior_sp"})
    changed = f.conference_change(_members(spark, sf)).withColumnRenamed("conference_changed", "changed")
    known = entering(team_games(games(spark, sf))).select("game_id", "team", "games_played")
    return f.assemble(g, [moves], [talent, prior, changed, known]).drop("season", "home_team", "away_team")


@query(f"""WITH {ctes()} SELECT game_id, season, round(total, 2) AS total FROM games WHERE home_points IS NOT NULL ORDER BY abs(home_points - away_points) DESC, game_id LIMIT 25""")
def closest_to_blowouts(spark, sf):
    """The 25 widest margins: a top-k report with a deterministic order."""
    return games(spark, sf).filter("home_points IS NOT NULL").orderBy(F.desc(F.abs(F.col("home_points") - F.col("away_points"))), "game_id").limit(25).select("game_id", "season", rounded("total", 2).alias("total"))

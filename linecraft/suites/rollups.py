"""Queries of rollups, the matchup reports and the research operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import NORM_CDF_SQL, norm_cdf, norm_quantile_sql
from ..operators import rollups as r
from ..operators.market import fair_line
from ..operators.running import team_games
from ..registry import query, rounded
from ..sources.proxy import ctes, games, line_tape, made, table, ticks
from .joins import TEAM_GAMES_SQL
from .market import QUOTES

PLAYERS = "SELECT l_orderkey AS game_id, l_linenumber AS week, l_suppkey % 32 AS team, l_partkey % 50 AS player, concat('P', l_partkey % 4) AS position, l_quantity AS snaps, CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_partkey % 64 AS DOUBLE) / 64 END AS rate, l_quantity * (l_partkey % 5) AS yards FROM {lineitem}"


_POSTED = f"{ctes(quotes=QUOTES)}, posted AS (SELECT game_id, book, line, price FROM quotes QUALIFY row_number() OVER (PARTITION BY game_id, book ORDER BY quoted_at DESC, quote_id DESC, line DESC) = 1)"


def posted(spark, sf):
    """Every book's last quote of every game."""
    last = F.max_by(F.struct("line", "price"), F.struct("quoted_at", "quote_id", "line"))
    return made(spark, sf, QUOTES).groupBy("game_id", "book").agg(last.alias("x")).select("game_id", "book", "x.*")


@query(f"""WITH {_POSTED}, m AS (SELECT *, count(*) OVER w AS n, median(line) OVER w AS med FROM posted WINDOW w AS (PARTITION BY game_id)), g AS (SELECT *, n < 3 OR abs(line - med) <= 2.5 AS near FROM m WHERE n >= 2), k AS (SELECT * FROM (SELECT *, count(*) FILTER (near) OVER (PARTITION BY game_id) AS n_near FROM g) WHERE near OR n_near < 2),
 f AS (SELECT *, (list_sort(list(line) OVER w))[(count(*) OVER w // 2 + 1)::INT] AS fair, count(*) OVER w AS books, max(line) OVER w - min(line) OVER w AS "range", bool_or(price >= -120) OVER w AS playable FROM k WINDOW w AS (PARTITION BY game_id)),
 b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY playable AND price < -120, line, CASE WHEN playable THEN -price END, book) = 1)
 SELECT game_id, fair, books, "range", line, price, book, playable, (line < 44 AND 44 < fair) OR (line < 51 AND 51 < fair) AS crosses FROM b""")
def best_number(spark, sf):
    """Fair total and the best playable over of every game that two books quote, with the key numbers between."""
    return r.shop(posted(spark, sf), "game_id", 2.5, (44.0, 51.0))


@query(f"WITH {ctes(quotes=QUOTES)} SELECT game_id, list_sort(list(line))[((count(*) - 1) // 2 + 1)::INT] AS low, list_sort(list(line))[(count(*) // 2 + 1)::INT] AS high FROM quotes GROUP BY game_id")
def conservative_median(spark, sf):
    return made(spark, sf, QUOTES).groupBy("game_id").agg(r.conservative_median("line", True).alias("low"), r.conservative_median("line", False).alias("high"))


@query(f"WITH {ctes(p=PLAYERS)} SELECT team, round(sum(rate * snaps) / nullif(sum(snaps) FILTER (rate IS NOT NULL), 0), 6) AS pooled, round(avg(rate), 6) AS mean, count(*) FILTER (rate IS NULL) AS missing, count(*) FILTER (snaps > 40) AS heavy, round(avg(rate) FILTER (snaps > 40), 6) AS heavy_rate, mode(position) IS NOT NULL AS has_position, len(list_distinct(list(position))) AS positions FROM p GROUP BY team")
def weighted_rollup(spark, sf):
    """Pooled rate, mean of rates, and filtered counts and means by team."""
    heavy = F.col("snaps") > 40
    return made(spark, sf, PLAYERS).groupBy("team").agg(rounded(r.pooled("rate", "snaps")).alias("pooled"), rounded(F.avg("rate")).alias("mean"), F.count_if(F.col("rate").isNull()).alias("missing"), F.count_if(heavy).alias("heavy"), rounded(F.avg(F.when(heavy, F.col("rate")))).alias("heavy_rate"), F.mode("position").isNotNull().alias("has_position"), F.size(F.collect_set("position")).cast("long").alias("positions"))


@query(f"WITH {ctes(p=PLAYERS)}, g AS (SELECT team, game_id, sum(yards) AS yards, sum(snaps) AS snaps FROM p GROUP BY ALL) SELECT team, count(*) AS games, round(sum(yards) / sum(snaps), 6) AS per_snap, round(avg(yards / snaps), 6) AS mean_ratio, max(yards) AS best FROM g GROUP BY team")
def two_stage_rollup(spark, sf):
    """Players to team games, team games to teams."""
    g = made(spark, sf, PLAYERS).groupBy("team", "game_id").agg(F.sum("yards").alias("yards"), F.sum("snaps").alias("snaps"))
    return g.groupBy("team").agg(F.count(F.lit(1)).alias("games"), rounded(F.sum("yards") / F.sum("snaps")).alias("per_snap"), rounded(F.avg(F.col("yards") / F.col("snaps"))).alias("mean_ratio"), F.max("yards").alias("best"))


@query("WITH d AS (SELECT l_orderkey AS game_id, l_suppkey % 32 AS team, l_partkey % 32 AS opponent, l_quantity AS yards, l_linenumber AS plays FROM lineitem WHERE l_suppkey % 32 <> l_partkey % 32), o AS (SELECT team, sum(yards) AS y, sum(plays) AS p FROM d GROUP BY team), e AS (SELECT opponent AS team, sum(yards) AS y, sum(plays) AS p FROM d GROUP BY opponent) SELECT team, round(o.y / o.p, 6) AS offense, round(e.y / e.p, 6) AS defense, round(o.y / o.p - e.y / e.p, 6) AS net FROM o JOIN e USING (team)")
def drive_rollup(spark, sf):
    """Yards a play of both units of a team: both sides from one scan, one shuffle."""
    d = table(spark, sf, "lineitem").selectExpr("l_suppkey % 32 AS team", "l_partkey % 32 AS opponent", "l_quantity AS yards", "l_linenumber AS plays").filter("team <> opponent")
    sides = d.select(F.explode(F.array(F.struct(F.col("team"), F.lit(1).alias("own")), F.struct(F.col("opponent").alias("team"), F.lit(0).alias("own")))).alias("s"), "yards", "plays")
    sums = sides.groupBy("s.team").agg(*(F.sum(F.when(F.col("s.own") == own, F.col(c))).alias(f"{c}{own}") for own in (0, 1) for c in ("yards", "plays")))
    off, dfn = F.col("yards1") / F.col("plays1"), F.col("yards0") / F.col("plays0")
    return sums.filter("plays1 IS NOT NULL AND plays0 IS NOT NULL").select("team", rounded(off).alias("offense"), rounded(dfn).alias("defense"), rounded(off - dfn).alias("net"))


@query(f"WITH {ctes()}, c AS (SELECT season, quantile_cont(total, [0.25, 0.5, 0.75]) AS q FROM games GROUP BY season) SELECT season, 1::BIGINT + (total > q[1])::INT + (total > q[2])::INT + (total > q[3])::INT::BIGINT AS bucket, count(*) AS n, round(avg(home_points + away_points), 6) AS points FROM games JOIN c USING (season) WHERE total IS NOT NULL GROUP BY ALL")
def quartile_buckets(spark, sf):
    """Points by the season's own quartiles of the total."""
    b = r.quartile_buckets(games(spark, sf).filter("total IS NOT NULL"), "total", ["season"])
    return b.groupBy("season", "bucket").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.col("home_points") + F.col("away_points"))).alias("points"))


_MINUTES = "m AS (SELECT user_id AS game, hour(ts) % 4 + 1 AS quarter, minute(ts) // 4 AS minute, ts, event_id, floor(value / 8) AS total FROM events WHERE event_type = 'view'), d AS (SELECT *, total - lag(total) OVER (PARTITION BY game ORDER BY ts, event_id) AS delta FROM m)"


@query(f"WITH {_MINUTES} SELECT quarter, minute, count(*) AS plays, sum(least(greatest(delta, 0), 8))::BIGINT AS points, round(sum(least(greatest(delta, 0), 8)) / count(DISTINCT game)::DOUBLE, 6) AS per_game FROM d WHERE delta IS NOT NULL GROUP BY ALL")
def points_by_minute(spark, sf):
    """Points of every quarter and minute, from steps of a running total that are clipped to one score."""
    t = ticks(spark, sf).filter("market = 'view'").select("event", "updated_at", "event_id", F.floor(F.col("line") / 8).alias("total"), (F.hour("updated_at") % 4 + 1).cast("long").alias("quarter"), F.expr("minute(updated_at) div 4").alias("minute"))
    d = t.withColumn("delta", F.col("total") - F.lag("total").over(Window.partitionBy("event").orderBy("updated_at", "event_id"))).filter("delta IS NOT NULL")
    points = F.sum(F.least(F.greatest("delta", F.lit(0)), F.lit(8)))
    return d.groupBy("quarter", "minute").agg(F.count(F.lit(1)).alias("plays"), points.alias("points"), rounded(points / F.count_distinct("event")).alias("per_game"))


@query(f"WITH {ctes()}, {TEAM_GAMES_SQL} SELECT season, week // 13 AS part, round(sum(points) FILTER (line < 0) / nullif(sum(points), 0)::DOUBLE, 6) AS favourites_share FROM tg WHERE points IS NOT NULL GROUP BY ALL")
def points_share(spark, sf):
    """The share of the points that favourites score, pooled by part of the season."""
    t = team_games(games(spark, sf)).filter("points IS NOT NULL")
    return t.groupBy("season", F.expr("week div 13").alias("part")).agg(rounded(F.sum(F.when(F.col("line") < 0, F.col("points"))) / F.nullif(F.sum("points"), F.lit(0))).alias("favourites_share"))


DRIVE_STARTS = """SELECT 1 + l_linenumber % 6 AS period, l_partkey % 17 AS clock_min, l_suppkey % 61 AS clock_sec, CAST(l_quantity AS BIGINT) AS points, 20 + o_orderkey * 31 % 57 AS final_total, 40 + CAST(o_orderkey * 13 % 41 AS DOUBLE) / 2 AS pregame_total FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey"""
_TB = "CASE " + " ".join(f"WHEN mins >= {a} AND mins < {b} THEN {i}" for i, (a, b) in enumerate(zip(r.MINUTES, r.MINUTES[1:]))) + " END"


@query(f"""WITH {ctes(starts=DRIVE_STARTS)}, t AS (SELECT *, final_total - points AS rem, CASE WHEN period >= 5 THEN 0.0 WHEN period BETWEEN 1 AND 4 AND clock_min BETWEEN 0 AND 15 AND clock_sec BETWEEN 0 AND 59 THEN (4 - period) * 15.0::DOUBLE + clock_min + clock_sec / 60.0::DOUBLE END AS mins FROM starts),
 h AS (SELECT ({_TB})::BIGINT AS tb, floor(pregame_total * mins / 60.0::DOUBLE / 10)::BIGINT AS eb, rem::BIGINT AS rem, count(*) AS n FROM t WHERE mins BETWEEN 0 AND 60 AND rem BETWEEN 0 AND 120 GROUP BY ALL),
 c AS (SELECT *, sum(n) OVER w AS cell, sum(rem * n) OVER w / sum(n) OVER w AS mean FROM h WHERE tb IS NOT NULL WINDOW w AS (PARTITION BY tb, eb)), e AS (SELECT *, min(rem) FILTER (n / cell >= 0.01) OVER w AS lo, max(rem) FILTER (n / cell >= 0.01) OVER w AS hi FROM c WHERE cell >= 100 WINDOW w AS (PARTITION BY tb, eb)),
 k AS (SELECT * FROM e WHERE rem BETWEEN lo AND hi) SELECT tb, eb, rem, n, round(n / sum(n) OVER (PARTITION BY tb, eb), 6) AS p, round(mean, 3) AS mean FROM k""")
def middle_table(spark, sf):
    """Points still to come by minutes left and expected rest: thin cells go, thin tails end, the rest adds up to one."""
    out = r.remaining_points(made(spark, sf, DRIVE_STARTS), tail=0.01)
    return out.select("tb", "eb", "rem", "n", rounded("p").alias("p"), rounded("mean", 3).alias("mean"))


@query(f"WITH {ctes()}, x AS (SELECT season, corr(y, a) AS ya, corr(y, w) AS yw, corr(a, w) AS aw FROM (SELECT season, home_points + away_points AS y, total AS a, week AS w FROM games WHERE home_points IS NOT NULL AND total IS NOT NULL) GROUP BY season) SELECT season, round((ya - yw * aw) / sqrt((1 - yw * yw) * (1 - aw * aw)), 6) AS partial FROM x")
def partial_correlation(spark, sf):
    """Correlation of points and total with the week held fixed."""
    g = games(spark, sf).filter("home_points IS NOT NULL AND total IS NOT NULL").withColumn("y", F.col("home_points") + F.col("away_points"))
    x = g.groupBy("season").agg(F.corr("y", "total").alias("ya"), F.corr("y", "week").alias("yw"), F.corr("total", "week").alias("aw"))
    return x.select("season", rounded((F.col("ya") - F.col("yw") * F.col("aw")) / F.sqrt((1 - F.col("yw") * F.col("yw")) * (1 - F.col("aw") * F.col("aw")))).alias("partial"))


@query(f"""WITH {ctes()}, a AS (SELECT home_team AS team, season, count(*)::DOUBLE AS n, count(*) FILTER (home_points > away_points)::DOUBLE / count(*) AS r FROM games WHERE home_points IS NOT NULL GROUP BY ALL), m AS (SELECT season, sum(n * r) / sum(n) AS mu, avg(n) AS nbar FROM a GROUP BY season),
 v AS (SELECT season, any_value(mu) AS mu, sum(n * pow(r - mu, 2)) / sum(n) AS spread, sum(n * n * pow(r - mu, 2)) / sum(n) AS s2, any_value(nbar) AS nbar FROM a JOIN m USING (season) GROUP BY season)
 SELECT team, season, round(mu, 6) AS group_rate, round(n / (n + s2 / greatest(spread - s2 / nbar, 1e-9)), 6) AS weight, round(mu + n / (n + s2 / greatest(spread - s2 / nbar, 1e-9)) * (r - mu), 6) AS shrunk FROM a JOIN v USING (season)""")
def shrunk_rates(spark, sf):
    """Teams' win rates pulled to the season's, as far as noise explains how they differ."""
    a = games(spark, sf).filter("home_points IS NOT NULL").groupBy(F.col("home_team").alias("team"), "season").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("home_points") > F.col("away_points")).alias("k"))
    return r.shrink(a, "k", "n", ["season"]).select("team", "season", rounded("group_rate").alias("group_rate"), rounded("shrink_weight").alias("weight"), rounded("shrunk").alias("shrunk"))


@query(f"WITH {ctes()}, d AS (SELECT season, home_team AS team, home_points % 5 AS k, 5 AS n FROM games WHERE home_points IS NOT NULL), p AS (SELECT season, team, least(0.98, greatest(0.02, sum(k) / sum(n)::DOUBLE)) AS p, count(*) AS games FROM d GROUP BY ALL), x AS (SELECT season, team, sum(pow(k - n * p, 2) / (n * p * (1 - p))) AS x, max(games) AS games FROM d JOIN p USING (season, team) GROUP BY ALL HAVING max(games) > 1) SELECT season, round(sum(x) / sum(games - 1), 6) AS phi FROM x GROUP BY season")
def overdispersion(spark, sf):
    d = games(spark, sf).filter("home_points IS NOT NULL").select("season", F.col("home_team").alias("team"), (F.col("home_points") % 5).alias("k"), F.lit(5).alias("n"))
    return r.overdispersion(d, "k", "n", ["team"], ["season"]).select("season", rounded("phi").alias("phi"))


@query(f"WITH {ctes()}, t AS (SELECT home_team AS team, season, avg(home_points) AS off, avg(away_points) AS def, avg(total) AS q FROM games WHERE home_points IS NOT NULL GROUP BY ALL), z AS (SELECT *, (off - avg(off) OVER w) / stddev_pop(off) OVER w AS z_off FROM t WINDOW w AS (PARTITION BY season)), l AS (SELECT season, regr_slope(z_off, q) AS s, regr_intercept(z_off, q) AS i FROM z GROUP BY season) SELECT team, season, round(z_off, 6) AS z_off, round(z_off - i - s * q, 6) AS residual FROM z JOIN l USING (season)")
def style_residual(spark, sf):
    """Season z-scores of the offence, less what the quality of the schedule explains."""
    t = games(spark, sf).filter("home_points IS NOT NULL").groupBy(F.col("home_team").alias("team"), "season").agg(F.avg("home_points").alias("off"), F.avg("total").alias("q"))
    out = r.residual(r.z_by(t, ["off"], ["season"]), "z_off", "q", ["season"])
    return out.select("team", "season", rounded("z_off").alias("z_off"), rounded("residual").alias("residual"))


@query(f"WITH {ctes()}, g AS (SELECT season, total AS x, home_points + away_points AS y FROM games WHERE home_points IS NOT NULL AND total IS NOT NULL) SELECT s.season, count(*) AS n, round(regr_slope(y, x), 6) AS slope FROM (SELECT DISTINCT season FROM g) s JOIN g ON g.season <> s.season GROUP BY s.season")
def leave_one_season(spark, sf):
    g = games(spark, sf).withColumn("y", F.col("home_points") + F.col("away_points"))
    return r.leave_one_out_slopes(g, "total", "y", "season").select("season", "n", rounded("slope").alias("slope"))


@query(f"WITH {ctes()}, g AS (SELECT season, total AS x, (home_points + away_points)::DOUBLE AS y FROM games WHERE home_points IS NOT NULL AND total IS NOT NULL), m AS (SELECT season, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, avg(y) AS my FROM g GROUP BY season) SELECT g.season, round(1 - sum(pow(y - i - s * x, 2)) / sum(pow(y - my, 2)), 6) AS r2 FROM g JOIN m ON m.season = g.season - 1 GROUP BY g.season")
def out_of_sample_r2(spark, sf):
    """How well the line of one season explains the next, against that season's mean."""
    g = games(spark, sf).filter("home_points IS NOT NULL AND total IS NOT NULL").select("season", F.col("total").alias("x"), (F.col("home_points") + F.col("away_points")).cast("double").alias("y"))
    m = g.groupBy((F.col("season") + 1).alias("season")).agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"), F.avg("y").alias("my"))
    e, d = F.col("y") - F.col("i") - F.col("s") * F.col("x"), F.col("y") - F.col("my")
    return g.join(F.broadcast(m), "season").groupBy("season").agg(rounded(1 - F.sum(e * e) / F.sum(d * d)).alias("r2"))


@query(f"WITH {ctes(p=PLAYERS)}, w AS (SELECT team, player, week, sum(rate * snaps) AS g, sum(snaps) FILTER (rate IS NOT NULL) AS s FROM p GROUP BY ALL) SELECT team, player, week, round(sum(g) OVER o / nullif(sum(s) OVER o, 0), 6) AS grade FROM w WINDOW o AS (PARTITION BY team, player ORDER BY week ROWS UNBOUNDED PRECEDING)")
def cumulative_grade(spark, sf):
    """Snap-weighted grade of every player through each week."""
    w = made(spark, sf, PLAYERS).groupBy("team", "player", "week").agg(F.sum(F.col("rate") * F.col("snaps")).alias("g"), F.sum(F.when(F.col("rate").isNotNull(), F.col("snaps"))).alias("s"))
    o = Window.partitionBy("team", "player").orderBy("week").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return w.select("team", "player", "week", rounded(F.sum("g").over(o) / F.nullif(F.sum("s").over(o), F.lit(0.0))).alias("grade"))


@query(f"WITH {ctes()}, b AS (SELECT season, CASE WHEN home_points - away_points >= -60 AND home_points - away_points < 60 THEN CASE WHEN home_points - away_points < -14 THEN 1 WHEN home_points - away_points < -3 THEN 2 WHEN home_points - away_points < 3 THEN 3 WHEN home_points - away_points < 14 THEN 4 ELSE 5 END END::BIGINT AS bin FROM games WHERE home_points IS NOT NULL) SELECT season, bin, count(*) AS n FROM b GROUP BY ALL")
def margin_bins(spark, sf):
    return games(spark, sf).filter("home_points IS NOT NULL").groupBy("season", r.fixed_bins(F.col("home_points") - F.col("away_points"), (-60, -14, -3, 3, 14, 60)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ctes(quotes=QUOTES)}, t AS (SELECT q.*, date_diff('microsecond', quoted_at::TIMESTAMP, o_orderdate::TIMESTAMP + INTERVAL 121 DAY) / 3.6e9 AS h FROM quotes q JOIN orders ON o_orderkey = game_id), b AS (SELECT * FROM t WHERE h > 0),
 e AS (SELECT game_id, arg_min(line, (quoted_at, quote_id)) AS a, arg_max(line, (quoted_at, quote_id)) AS z FROM b GROUP BY game_id HAVING abs(a - z) >= 1), m AS (SELECT unnest({list(r.MARKS)}) AS hours), l AS (SELECT game_id, hours, arg_max(line, (quoted_at, quote_id)) AS line FROM b JOIN m ON h >= hours GROUP BY ALL)
 SELECT hours::BIGINT AS hours, count(*) AS games, round(median((line - a) / (z - a)), 6) AS done FROM l JOIN e USING (game_id) GROUP BY hours""")
def move_decay(spark, sf):
    """The middle share of games' moves that was done so many hours before kickoff."""
    kick = table(spark, sf, "orders").select(F.col("o_orderkey").alias("game_id"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL '121' DAY")).alias("kickoff"))
    ticks = made(spark, sf, QUOTES).join(kick, "game_id")
    return r.move_decay(ticks, "game_id", "line", "quoted_at", "quote_id", "kickoff").groupBy("hours").agg(F.count(F.lit(1)).alias("games"), rounded(F.median("done")).alias("done"))


@query(f"WITH {ctes()}, a AS (SELECT o_orderkey AS ask_id, o_custkey % 40 AS home_team, o_orderdate + INTERVAL 1 HOUR * (CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 40 END) AS asked_at FROM orders WHERE o_orderkey % 2 = 0), h AS (SELECT ask_id, count(*) AS n, min(game_id) AS one, min(game_id) FILTER (asked_at = kickoff) AS exact FROM a JOIN games USING (home_team) WHERE abs(epoch(asked_at) - epoch(kickoff)) <= 30 * 3600 GROUP BY ask_id), s AS (SELECT a.ask_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'window' WHEN n > 1 THEN 'ambiguous' ELSE 'missed' END AS how, one, exact FROM a LEFT JOIN h USING (ask_id)) SELECT ask_id, how, CASE how WHEN 'exact' THEN exact WHEN 'window' THEN one END AS game_id FROM s")
def kickoff_ladder(spark, sf):
    """Exact kickoff, else the only game within 30 hours, else the reason."""
    a = made(spark, sf, "SELECT o_orderkey AS ask_id, o_custkey % 40 AS home_team, o_orderdate + make_dt_interval(0, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 40 END AS INT)) AS at FROM {orders} WHERE o_orderkey % 2 = 0")
    return r.match_ladder(a, games(spark, sf).select("game_id", "home_team", "kickoff"), ["home_team"], "at", 30)


@query(f"WITH {ctes()}, a AS (SELECT game_id AS ask_id, season, least(home_points, away_points) AS low, greatest(home_points, away_points) AS high, week, home_team FROM games WHERE home_points IS NOT NULL), k AS (SELECT game_id, season, least(home_points, away_points) AS low, greatest(home_points, away_points) AS high, week, home_team FROM games WHERE home_points IS NOT NULL), c AS (SELECT ask_id, game_id, a.week = k.week AS same_week, a.home_team = k.home_team AS same_home FROM a JOIN k USING (season, low, high)), h AS (SELECT ask_id, count(*) AS n, min(game_id) AS any_game, count(*) FILTER (same_week) AS nw, min(game_id) FILTER (same_week) AS gw, count(*) FILTER (same_week AND same_home) AS nh, min(game_id) FILTER (same_week AND same_home) AS gh FROM c GROUP BY ask_id) SELECT ask_id, CASE WHEN n = 1 THEN 'score' WHEN nw = 1 THEN 'week' WHEN nh = 1 THEN 'name' ELSE 'ambiguous' END AS how, CASE WHEN n = 1 THEN any_game WHEN nw = 1 THEN gw WHEN nh = 1 THEN gh END AS game_id FROM h")
def score_index(spark, sf):
    """Results matched by season and unordered score, then week, then name; what stays open is ambiguous."""
    scores = [F.least("home_points", "away_points").alias("low"), F.greatest("home_points", "away_points").alias("high")]
    g = games(spark, sf).filter("home_points IS NOT NULL")
    # counts and least ids of each level, so equal scores never pair up row by row
    ask = g.select(F.col("game_id").alias("ask_id"), "season", *scores, "week", "home_team")
    known = g.select("game_id", "season", *scores, "week", "home_team")
    pair = ["season", "low", "high"]
    for level, (n, least) in ((pair, ("n", "g")), ([*pair, "week"], ("nw", "gw")), ([*pair, "week", "home_team"], ("nh", "gh"))):
        ask = ask.join(known.groupBy(*level).agg(F.count(F.lit(1)).alias(n), F.min("game_id").alias(least)), level, "left")
    how = F.when(F.col("n") == 1, "score").when(F.col("nw") == 1, "week").when(F.col("nh") == 1, "name").otherwise("ambiguous")
    found = F.when(F.col("n") == 1, F.col("g")).when(F.col("nw") == 1, F.col("gw")).when(F.col("nh") == 1, F.col("gh"))
    return ask.filter("n IS NOT NULL").select("ask_id", how.alias("how"), found.alias("game_id"))


@query(f"WITH {ctes(quotes=QUOTES)}, f AS (SELECT quote_id, game_id, line, 0.4 + (quote_id % 20) / 100.0::DOUBLE AS p FROM quotes) SELECT quote_id, game_id, line, round(p, 6) AS p_over, round(line - 10 * ({norm_quantile_sql('(1 - p)')}), 5) AS fair FROM f")
def fair_lines(spark, sf):
    """The fair line of a quote: there the model gives both sides a half."""
    q = made(spark, sf, QUOTES).withColumn("p", 0.4 + (F.col("quote_id") % 20) / 100.0)
    return q.select("quote_id", "game_id", "line", rounded("p").alias("p_over"), rounded(fair_line(F.col("line"), F.col("p"), F.lit(10.0)), 5).alias("fair"))


# ---- the matchup reports

AS_OF = 30  # the report's week: nothing later is known


@query(f"WITH {ctes()}, {TEAM_GAMES_SQL} SELECT team, season, week, game_id, opponent, is_home, CASE WHEN week < {AS_OF} THEN points END AS points, CASE WHEN week < {AS_OF} THEN allowed END AS allowed, CASE WHEN week < {AS_OF} THEN CASE WHEN points - allowed + line > 0 THEN 'W' WHEN points - allowed + line < 0 THEN 'L' WHEN points - allowed + line = 0 THEN 'P' END END AS ats FROM tg")
def schedule(spark, sf):
    """Every season's schedule as of a week: results of later games are blank."""
    known = F.col("week") < AS_OF
    cover = F.col("points") - F.col("allowed") + F.col("line")
    ats = F.when(cover > 0, "W").when(cover < 0, "L").when(cover == 0, "P")
    return team_games(games(spark, sf)).select("team", "season", "week", "game_id", "opponent", "is_home", F.when(known, F.col("points")).alias("points"), F.when(known, F.col("allowed")).alias("allowed"), F.when(known, ats).alias("ats"))


@query(f"WITH {ctes()}, {TEAM_GAMES_SQL} SELECT team, season, count(*) FILTER (points > allowed) AS wins, count(*) FILTER (points < allowed) AS losses, count(*) FILTER (is_home = 1 AND points > allowed) AS home_wins, count(*) FILTER (line < 0 AND points - allowed + line > 0) AS favourite_covers, round(avg(points) FILTER (is_home = 0), 6) AS road_points FROM tg WHERE week < {AS_OF} GROUP BY team, season")
def team_profile(spark, sf):
    """Record and splits of every season up to a week."""
    t = team_games(games(spark, sf)).filter(f"week < {AS_OF}")
    won = F.col("points") > F.col("allowed")
    return t.groupBy("team", "season").agg(F.count_if(won).alias("wins"), F.count_if(F.col("points") < F.col("allowed")).alias("losses"), F.count_if(won & (F.col("is_home") == 1)).alias("home_wins"), F.count_if((F.col("line") < 0) & (F.col("points") - F.col("allowed") + F.col("line") > 0)).alias("favourite_covers"), rounded(F.avg(F.when(F.col("is_home") == 0, F.col("points")))).alias("road_points"))


@query(f"WITH {ctes()}, {TEAM_GAMES_SQL}, a AS (SELECT season, team, opponent, count(*) AS games, count(*) FILTER (points > allowed) AS wins FROM tg WHERE points IS NOT NULL GROUP BY ALL) SELECT x.season, x.team AS team_a, y.team AS team_b, count(*) AS opponents, sum(x.wins)::BIGINT AS wins_a, sum(y.wins)::BIGINT AS wins_b FROM a x JOIN a y ON x.season = y.season AND x.opponent = y.opponent AND x.team < y.team GROUP BY ALL")
def common_opponents(spark, sf):
    """Records of two teams against the opponents that both met: the pairs come from shared opponents only."""
    a = team_games(games(spark, sf)).filter("points IS NOT NULL").groupBy("season", "team", "opponent").agg(F.count_if(F.col("points") > F.col("allowed")).alias("wins"))
    b = a.select("season", "opponent", F.col("team").alias("other"), F.col("wins").alias("their"))
    return a.join(b, ["season", "opponent"]).filter("team < other").groupBy("season", F.col("team").alias("team_a"), F.col("other").alias("team_b")).agg(F.count(F.lit(1)).alias("opponents"), F.sum("wins").alias("wins_a"), F.sum("their").alias("wins_b"))


@query(f"WITH {ctes()}, t AS (SELECT season, home_team AS team, avg(home_points) AS off, avg(away_points) AS def FROM games WHERE home_points IS NOT NULL GROUP BY ALL), k AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY off DESC) AS off_rank, rank() OVER (PARTITION BY season ORDER BY def) AS def_rank, count(*) OVER (PARTITION BY season) AS n FROM t) SELECT g.game_id, h.off_rank AS home_offence_rank, a.def_rank AS away_defence_rank, round((a.def_rank - h.off_rank) / h.n::DOUBLE, 6) AS edge, CASE WHEN abs(h.off - a.def) <= greatest(0.01 * greatest(abs(h.off), abs(a.def)), 0.001) THEN 'even' WHEN h.off > a.def THEN 'offence' ELSE 'defence' END AS side FROM games g JOIN k h ON h.team = g.home_team AND h.season = g.season JOIN k a ON a.team = g.away_team AND a.season = g.season")
def unit_matchups(spark, sf):
    """Offence against the opposing defence: ranks, edge and who has it beyond a band of 1 %."""
    t = games(spark, sf).filter("home_points IS NOT NULL").groupBy("season", F.col("home_team").alias("team")).agg(F.avg("home_points").alias("off"), F.avg("away_points").alias("def"))
    one = Window.partitionBy("season")
    k = t.select("season", "team", "off", "def", F.rank().over(one.orderBy(F.desc("off"))).cast("long").alias("off_rank"), F.rank().over(one.orderBy("def")).cast("long").alias("def_rank"), F.count(F.lit(1)).over(one).alias("n"))
    h = k.select("season", F.col("team").alias("home_team"), F.col("off").alias("o"), F.col("off_rank").alias("home_offence_rank"), "n")
    a = k.select("season", F.col("team").alias("away_team"), F.col("def").alias("d"), F.col("def_rank").alias("away_defence_rank"))
    g = games(spark, sf).select("game_id", "season", "home_team", "away_team").join(h, ["season", "home_team"]).join(a, ["season", "away_team"])
    band = F.greatest(0.01 * F.greatest(F.abs("o"), F.abs("d")), F.lit(0.001))
    side = F.when(F.abs(F.col("o") - F.col("d")) <= band, "even").when(F.col("o") > F.col("d"), "offence").otherwise("defence")
    return g.select("game_id", "home_offence_rank", "away_defence_rank", rounded((F.col("away_defence_rank") - F.col("home_offence_rank")) / F.col("n")).alias("edge"), side.alias("side"))


@query(f"WITH {ctes()}, t AS (SELECT game_id, provider, pos, total, count(*) OVER (PARTITION BY game_id, provider) AS n FROM line_tape WHERE provider BETWEEN 1 AND 5), b AS (SELECT *, dense_rank() OVER (PARTITION BY game_id ORDER BY n DESC, provider) AS r FROM t), m AS (SELECT *, lag(total) OVER (PARTITION BY game_id ORDER BY pos, total NULLS LAST) AS was FROM b WHERE r = 1) SELECT game_id, provider, pos, total FROM m WHERE total IS DISTINCT FROM was")
def main_book_movement(spark, sf):
    """Changes of the total at the book that quotes a game most."""
    w = Window.partitionBy("game_id")
    t = line_tape(spark, sf).filter("provider BETWEEN 1 AND 5").select("game_id", "provider", "pos", "total", F.count(F.lit(1)).over(Window.partitionBy("game_id", "provider")).alias("n"))
    b = t.withColumn("r", F.dense_rank().over(w.orderBy(F.desc("n"), "provider"))).filter("r = 1")
    m = b.withColumn("was", F.lag("total").over(w.orderBy("pos", F.asc_nulls_last("total"))))
    return m.filter(~F.col("total").eqNullSafe(F.col("was"))).select("game_id", "provider", "pos", "total")


@query(f"WITH {ctes()}, p AS (SELECT concat('P', game_id % 2) AS poll, home_team AS team, season, week, game_id % 25 + 1 AS rank, game_id FROM games), l AS (SELECT poll, team, season, arg_max(rank, (week, game_id)) AS rank, max(week) AS of_week FROM p WHERE week < {AS_OF} GROUP BY ALL) SELECT team, season, max(rank) FILTER (poll = 'P0') AS first_poll, max(rank) FILTER (poll = 'P1') AS second_poll, max(of_week) AS of_week FROM l GROUP BY ALL")
def polls_as_of(spark, sf):
    """The last rank before a week in each poll, poll by poll in columns."""
    p = games(spark, sf).filter(f"week < {AS_OF}").select(F.concat(F.lit("P"), F.col("game_id") % 2).alias("poll"), F.col("home_team").alias("team"), "season", "week", (F.col("game_id") % 25 + 1).alias("rank"), "game_id")
    last = p.groupBy("poll", "team", "season").agg(F.max_by("rank", F.struct("week", "game_id")).alias("rank"), F.max("week").alias("of_week"))
    pick = lambda x: F.max(F.when(F.col("poll") == x, F.col("rank")))
    return last.groupBy("team", "season").agg(pick("P0").alias("first_poll"), pick("P1").alias("second_poll"), F.max("of_week").alias("of_week"))


@query(f"WITH {ctes()}, s AS (SELECT DISTINCT home_team AS team, season, (home_team + season // 3) % 9 AS coach FROM games) SELECT team, season, coach, (SELECT count(*) FROM s b WHERE b.team = a.team AND b.coach = a.coach AND b.season <= a.season) AS tenure FROM s a")
def coach_tenure(spark, sf):
    """Seasons of a coach with a team so far: a correlated count as a running one."""
    s = games(spark, sf).select(F.col("home_team").alias("team"), "season").distinct().withColumn("coach", F.expr("(team + season div 3) % 9"))
    return s.withColumn("tenure", F.row_number().over(Window.partitionBy("team", "coach").orderBy("season")).cast("long"))


_Z = NORM_CDF_SQL.replace("{z}", "(-spread / 13.5)")


@query(f"WITH {ctes()} SELECT game_id, season, week, home_team, away_team, spread, round({_Z}, 6) AS home_win FROM games WHERE season = 1996 AND week = {AS_OF}")
def slate(spark, sf):
    """The games of the report's week with the win probability of their spread."""
    g = games(spark, sf).filter(f"season = 1996 AND week = {AS_OF}")
    return g.select("game_id", "season", "week", "home_team", "away_team", "spread", rounded(norm_cdf(-F.col("spread") / 13.5)).alias("home_win"))


@query(f"WITH {ctes()}, g AS (SELECT season, CASE WHEN spread < -13 THEN 'Yes' WHEN spread IS NOT NULL THEN 'No' END AS v, home_points > away_points AS won FROM games WHERE season_type = 'postseason'), d AS (SELECT season, unnest(['Yes', 'No']) AS v FROM (SELECT DISTINCT season FROM games)) SELECT d.season, d.v AS value, count(g.v) AS games, count(*) FILTER (won) AS wins FROM d LEFT JOIN g USING (season, v) GROUP BY ALL")
def flag_breakdown(spark, sf):
    """Records by a yes-or-no value: both values are always there, also without a game."""
    every = games(spark, sf)
    v = F.when(F.col("spread") < -13, "Yes").when(F.col("spread").isNotNull(), "No")
    g = every.filter("season_type = 'postseason'").select("season", v.alias("value"), (F.col("home_points") > F.col("away_points")).alias("won")).groupBy("season", "value").agg(F.count(F.lit(1)).alias("games"), F.count_if("won").alias("wins"))
    domain = every.select("season").distinct().select("season", F.explode(F.array(F.lit("Yes"), F.lit("No"))).alias("value"))
    return domain.join(g, ["season", "value"], "left").fillna(0, ["games", "wins"])


@query(f"WITH {ctes()}, r AS (SELECT home_team AS team, season, 'sp' AS system, avg(home_points) AS rating FROM games GROUP BY ALL UNION ALL SELECT home_team, season, 'fpi', avg(total) FROM games WHERE home_team % 3 <> 0 GROUP BY ALL) SELECT team, season + 1 AS season, round(max(rating) FILTER (system = 'sp'), 6) AS sp, round(max(rating) FILTER (system = 'fpi'), 6) AS fpi FROM r GROUP BY team, season")
def prior_season_ratings(spark, sf):
    """Ratings as of each season: the one before's, one column a system."""
    g = games(spark, sf)
    r = g.groupBy(F.col("home_team").alias("team"), "season").agg(F.avg("home_points").alias("rating")).withColumn("system", F.lit("sp"))
    r = r.unionByName(g.filter("home_team % 3 <> 0").groupBy(F.col("home_team").alias("team"), "season").agg(F.avg("total").alias("rating")).withColumn("system", F.lit("fpi")))
    pick = lambda s: rounded(F.max(F.when(F.col("system") == s, F.col("rating"))))
    return r.groupBy("team", (F.col("season") + 1).alias("season")).agg(pick("sp").alias("sp"), pick("fpi").alias("fpi"))

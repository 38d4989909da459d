"""All queries of the library and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.odds import clv_points, fair_pair, implied_probability, kelly, snap_half
from .functions.stats import NORM_CDF_SQL, adjusted, clustered_mean, norm_cdf, sample_moments, wilson
from .operators import models
from .operators.relational import asof_join, islands, latest, merge_sources, pair_key
from .operators.running import entering, prior_mean, team_games
from .operators.systems import FeatureFilter, SystemFilter, evaluate, grade, record
from .plans import search
from .registry import ORACLE_SQL, QUERIES, query, rounded
from .session import dealt, tasks
from .sources.proxy import GAMES_SQL, LINES_SQL, games, line_tape, purchases, table, ticks

HOME_FAVOURITE = SystemFilter(side="home", favorite=True)

_GRADED = (
    GAMES_SQL
    + """, g AS (SELECT *, home_points - away_points + spread AS margin FROM games
      WHERE home_points IS NOT NULL AND away_points IS NOT NULL AND spread IS NOT NULL),
 graded AS (SELECT *, CASE WHEN margin > 0 THEN 'W' WHEN margin < 0 THEN 'L' ELSE 'P' END AS result,
            CASE WHEN margin > 0 THEN 90.9091 WHEN margin < 0 THEN -100.0 ELSE 0.0 END::DECIMAL(18,4) AS profit FROM g)"""
)
_RECORD = """count(*) AS bets, count(*) FILTER (result = 'W') AS wins, count(*) FILTER (result = 'L') AS losses,
 count(*) FILTER (result = 'P') AS pushes,
 round(count(*) FILTER (result = 'W') / nullif(count(*) FILTER (result <> 'P'), 0)::DOUBLE, 4) AS hit_rate,
 sum(profit)::DOUBLE AS profit, round(sum(profit)::DOUBLE / (count(*) * 100.0::DOUBLE), 4) AS roi"""
_TEAM_GAMES = """tg AS (SELECT game_id, season, week, kickoff, 1 AS is_home, home_team AS team, away_team AS opponent,
   home_points AS points, away_points AS allowed, spread AS line FROM games
 UNION ALL SELECT game_id, season, week, kickoff, 0, away_team, home_team, away_points, home_points, -spread FROM games)"""


@query(f"WITH {_GRADED} SELECT season, {_RECORD} FROM graded WHERE spread < 0 GROUP BY season")
def season_record(spark, sf):
    """Record, profit and return by season of home favourites."""
    return grade(games(spark, sf), HOME_FAVOURITE).groupBy("season").agg(*record())


@query(f"""WITH {_GRADED} SELECT home_conference, {_RECORD} FROM (SELECT * REPLACE (CASE result WHEN 'W' THEN 'L' WHEN 'L' THEN 'W' ELSE 'P' END AS result,
  CASE WHEN margin < 0 THEN 90.9091 WHEN margin > 0 THEN -100.0 ELSE 0.0 END::DECIMAL(18,4) AS profit) FROM graded
  WHERE season_type = 'regular' AND -spread BETWEEN -10 AND 7 AND away_conference IS NOT NULL AND away_conference <> 'C1' AND home_team IN (1,2,3,4,5,6,7,8,9)) GROUP BY home_conference""")
def away_system(spark, sf):
    """Away bets with set, range and feature clauses; an unknown conference fails the exclusion."""
    s = SystemFilter(side="away", season_types=frozenset({"regular"}), exclude_conferences=frozenset({"C1"}), spread_min=-10.0, spread_max=7.0, features=(FeatureFilter("team", "in", tuple(range(1, 10)), "opponent"),))
    return grade(games(spark, sf), s).groupBy("home_conference").agg(*record())


@query(f"""WITH {GAMES_SQL}, g AS (SELECT *, -(home_points + away_points - total) AS margin FROM games
  WHERE home_points IS NOT NULL AND total IS NOT NULL AND total >= 45 AND coalesce(home_conference = 'C2' OR away_conference = 'C2', false)),
 graded AS (SELECT *, CASE WHEN margin > 0 THEN 'W' WHEN margin < 0 THEN 'L' ELSE 'P' END AS result,
   CASE WHEN margin > 0 THEN 90.9091 WHEN margin < 0 THEN -100.0 ELSE 0.0 END::DECIMAL(18,4) AS profit FROM g)
 SELECT season, {_RECORD} FROM graded GROUP BY season""")
def under_system(spark, sf):
    """Totals: a conference filter means that either side belongs to it."""
    s = SystemFilter(side="under", market="total", conferences=frozenset({"C2"}), total_min=45.0)
    return grade(games(spark, sf), s).groupBy("season").agg(*record())


@query(f"""WITH {_GRADED}, b AS (SELECT unnest(list_distinct([home_team, away_team])) AS team, result, profit FROM graded) SELECT team, {_RECORD} FROM b GROUP BY team""")
def value_breakdown(spark, sf):
    """Record by filter value; a game feeds the buckets of both of its teams."""
    bets = grade(games(spark, sf), SystemFilter())
    return bets.select("result", "profit", F.explode(F.array_distinct(F.array("home_team", "away_team"))).alias("team")).groupBy("team").agg(*record())


@query(f"WITH {_GRADED} SELECT season, home_conference, {_RECORD}, grouping(season)::BIGINT AS all_seasons, grouping(home_conference)::BIGINT AS all_conferences FROM graded GROUP BY ROLLUP (season, home_conference)")
def conference_rollup(spark, sf):
    bets = grade(games(spark, sf), SystemFilter())
    return bets.rollup("season", "home_conference").agg(*record(), F.grouping("season").cast("long").alias("all_seasons"), F.grouping("home_conference").cast("long").alias("all_conferences"))


#: Per-game efficiency of the two sides, made from the scores: what a vendor's advanced box score holds.
ADVANCED = {"ppa_off": "(points * 13 % 41 - 20) / 16.0", "ppa_def": "(allowed * 11 % 37 - 18) / 16.0", "success_off": "(points * 3 % 20) / 32.0", "success_def": "(allowed * 5 % 20) / 32.0", "explosive_off": "(points * 7 % 9) / 8.0", "explosive_def": "(allowed * 2 % 9) / 8.0"}


def _streak_sql(name: str, x: str) -> str:
    w = "OVER (PARTITION BY team, season ORDER BY kickoff, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""s_{name} AS (SELECT *, sign({x}) AS sg, last_value(sign({x}) IGNORE NULLS) {w} AS was FROM d),
 r_{name} AS (SELECT *, sum(CASE WHEN sg IS NOT NULL AND sg IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY team, season ORDER BY kickoff, game_id ROWS UNBOUNDED PRECEDING) AS run FROM s_{name}),
 a_{name} AS (SELECT *, sg * count(sg) OVER (PARTITION BY team, season, run ORDER BY kickoff, game_id ROWS UNBOUNDED PRECEDING) AS now FROM r_{name}),
 {name} AS (SELECT game_id, team, coalesce(last_value(now IGNORE NULLS) {w}, 0)::BIGINT AS {name} FROM a_{name})"""


_ENTERING_CTE = f"""{GAMES_SQL}, {_TEAM_GAMES}, d AS (SELECT *, points - allowed AS diff, points - allowed + line AS cover, {", ".join(f"({x})::DOUBLE AS {c}" for c, x in ADVANCED.items())} FROM tg),
 {_streak_sql("streak", "diff")}, {_streak_sql("ats_streak", "cover")},
 entering AS (SELECT d.game_id, d.team, season, count(diff) OVER p AS games_played,
  round(count(*) FILTER (diff > 0) OVER p / nullif(count(*) FILTER (diff <> 0) OVER p, 0)::DOUBLE, 4) AS win_pct,
  round(count(*) FILTER (cover > 0) OVER p / nullif(count(*) FILTER (cover <> 0) OVER p, 0)::DOUBLE, 4) AS ats_pct,
  CASE WHEN date_diff('day', lag(kickoff) OVER w, kickoff) > 0 THEN date_diff('day', lag(kickoff) OVER w, kickoff) END AS rest_days,
  round(avg(points) OVER (PARTITION BY d.team, season ORDER BY kickoff, d.game_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS last3_points,
  streak, ats_streak, {", ".join(f"round(avg({c}) OVER p, 4) AS avg_{c}" for c in ADVANCED)}
  FROM d JOIN streak USING (game_id, team) JOIN ats_streak USING (game_id, team)
  WINDOW w AS (PARTITION BY d.team, season ORDER BY kickoff, d.game_id),
   p AS (PARTITION BY d.team, season ORDER BY kickoff, d.game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def advanced_team_games(spark, sf):
    return team_games(games(spark, sf)).selectExpr("*", *(f"CAST({x} AS DOUBLE) AS {c}" for c, x in ADVANCED.items()))


@query(f"WITH {_ENTERING_CTE} SELECT * FROM entering")
def entering_stats(spark, sf):
    """Everything that a team brings into a game: rates, streaks, rest and mean efficiency."""
    return entering(advanced_team_games(spark, sf), tuple(ADVANCED))


@query(f"""WITH {GAMES_SQL}, {_TEAM_GAMES} SELECT game_id, team, count(points) OVER w AS n_prior, round(avg(points) OVER w, 6) AS prior_points FROM tg
 WINDOW w AS (PARTITION BY team ORDER BY epoch(kickoff) RANGE BETWEEN UNBOUNDED PRECEDING AND 86400 PRECEDING)""")
def prior_game_mean(spark, sf):
    return prior_mean(games(spark, sf))


@query(f"""WITH {_GRADED}, d AS (SELECT *, row_number() OVER (PARTITION BY home_team ORDER BY kickoff, game_id) - row_number() OVER (PARTITION BY home_team, result ORDER BY kickoff, game_id) AS island FROM graded WHERE result <> 'P')
 SELECT home_team AS team, max(n)::BIGINT AS longest_losing_run FROM (SELECT home_team, count(*) FILTER (result = 'L') AS n FROM d GROUP BY home_team, result, island) GROUP BY home_team""")
def losing_run(spark, sf):
    """Longest losing run of bets on each home team; pushes are transparent."""
    bets = grade(games(spark, sf), SystemFilter()).filter("result <> 'P'")
    runs = islands(bets, ["home_team"], ["kickoff", "game_id"], "result").groupBy("home_team", "run_id").agg(F.count_if(F.col("result") == "L").alias("n"))
    return runs.groupBy(F.col("home_team").alias("team")).agg(F.max("n").alias("longest_losing_run"))


@query(f"""WITH {_GRADED}, c AS (SELECT season, sum(profit) OVER (PARTITION BY season ORDER BY kickoff, game_id ROWS UNBOUNDED PRECEDING) AS bank, kickoff, game_id FROM graded),
 m AS (SELECT season, bank, max(bank) OVER (PARTITION BY season ORDER BY kickoff, game_id ROWS UNBOUNDED PRECEDING) AS peak FROM c)
 SELECT season, max(greatest(peak, 0) - bank)::DOUBLE AS drawdown FROM m GROUP BY season""")
def drawdown(spark, sf):
    w = Window.partitionBy("season").orderBy("kickoff", "game_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bank = grade(games(spark, sf), SystemFilter()).select("season", "kickoff", "game_id", F.sum("profit").over(w).alias("bank"))
    peak = bank.withColumn("peak", F.greatest(F.max("bank").over(w), F.lit(0).cast("decimal(28,4)")))
    return peak.groupBy("season").agg(F.max(F.col("peak") - F.col("bank")).cast("double").alias("drawdown"))


def _one_vote(lines: DataFrame) -> DataFrame:
    """One row per game and book: the fullest, the first of equals."""
    filled = sum(F.col(c).isNotNull().cast("int") for c in ("spread", "spread_open", "total"))
    return latest(dealt(lines.withColumn("__n", filled), "game_id"), ["game_id", "provider"], [F.desc("__n"), F.asc("pos"), F.asc_nulls_last("spread"), F.asc_nulls_last("spread_open"), F.asc_nulls_last("total")]).drop("__n")


_VOTE = f"""{LINES_SQL}, vote AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY game_id, provider ORDER BY
   (spread IS NOT NULL)::INT + (spread_open IS NOT NULL)::INT + (total IS NOT NULL)::INT DESC, pos, spread NULLS LAST, spread_open NULLS LAST, total NULLS LAST) AS rn FROM line_tape) WHERE rn = 1)"""


@query(f"""WITH {_VOTE}, m AS (SELECT game_id, median(spread) FILTER (provider BETWEEN 1 AND 5) AS s, median(total) FILTER (provider BETWEEN 1 AND 5) AS t,
   count(spread) FILTER (provider BETWEEN 1 AND 5) AS n_books, min(spread) FILTER (provider = 0) AS cs FROM vote GROUP BY game_id)
 SELECT game_id, n_books, sign(x) * floor(abs(x) * 2 + 0.5) / 2 AS median_spread, sign(t) * floor(abs(t) * 2 + 0.5) / 2 AS median_total FROM (SELECT *, coalesce(s, cs) AS x FROM m)""")
def book_median(spark, sf):
    """Median per number over the books (no consensus, no projection site), consensus as fallback, half points."""
    book = F.col("provider").between(1, 5)
    out = _one_vote(line_tape(spark, sf)).groupBy("game_id").agg(
        F.median(F.when(book, F.col("spread"))).alias("s"),
        F.median(F.when(book, F.col("total"))).alias("t"),
        F.count(F.when(book, F.col("spread"))).alias("n_books"),
        F.min(F.when(F.col("provider") == 0, F.col("spread"))).alias("cs"),
    )
    return out.select("game_id", "n_books", snap_half(F.coalesce("s", "cs")).alias("median_spread"), snap_half(F.col("t")).alias("median_total"))


@query(f"""WITH {_VOTE}, a AS (SELECT * FROM vote WHERE pos <= 4), b AS (SELECT * FROM vote WHERE pos >= 3)
 SELECT game_id, provider, coalesce(a.spread, b.spread) AS spread, coalesce(a.total, b.total) AS total,
   CASE WHEN a.pos IS NOT NULL AND b.pos IS NOT NULL THEN 'both' WHEN a.pos IS NOT NULL THEN 'rest' ELSE 'gql' END AS _source
 FROM a FULL JOIN b USING (game_id, provider)""")
def line_merge(spark, sf):
    """Two overlapping sources of lines, the first one's values win."""
    votes = _one_vote(line_tape(spark, sf))
    return merge_sources(votes.filter("pos <= 4"), votes.filter("pos >= 3"), ["game_id", "provider"], ["spread", "total"], ("rest", "gql"))


@query(f"""WITH {LINES_SQL} SELECT game_id, provider, unnest(['spread','spread_open','total']) AS number, unnest([spread, spread_open, total]) AS line, pos FROM line_tape""")
def line_unpivot(spark, sf):
    return line_tape(spark, sf).unpivot(["game_id", "provider", "pos"], ["spread", "spread_open", "total"], "number", "line")


@query(f"""WITH {_VOTE} SELECT game_id, {", ".join(f"max(spread) FILTER (provider = {p}) AS book_{p}" for p in range(1, 6))} FROM vote GROUP BY game_id""")
def book_pivot(spark, sf):
    out = _one_vote(line_tape(spark, sf)).groupBy("game_id").pivot("provider", list(range(1, 6))).agg(F.max("spread"))
    return out.select("game_id", *(F.col(str(p)).alias(f"book_{p}") for p in range(1, 6)))


@query(f"""WITH {_VOTE}, r AS (SELECT game_id, spread, provider, row_number() OVER (PARTITION BY game_id ORDER BY CASE provider WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 0 THEN 2 END) AS rn
   FROM vote WHERE provider IN (0, 1, 3) AND spread IS NOT NULL) SELECT game_id, provider, spread FROM r WHERE rn = 1""")
def provider_cascade(spark, sf):
    """The first provider of a list that has a number."""
    rank = F.when(F.col("provider") == 3, 0).when(F.col("provider") == 1, 1).otherwise(2)
    lines = _one_vote(line_tape(spark, sf)).filter(F.col("provider").isin(0, 1, 3) & F.col("spread").isNotNull())
    return lines.groupBy("game_id").agg(F.min_by(F.struct("provider", "spread"), rank).alias("x")).select("game_id", "x.*")


@query(f"""WITH {_VOTE}, o AS (SELECT game_id, provider, total, (SELECT 1) AS one FROM vote WHERE provider BETWEEN 1 AND 5 AND total IS NOT NULL)
 SELECT a.game_id, a.provider, a.total, median(b.total) AS fair_total, count(b.total) AS n_other, a.total - median(b.total) AS gap
 FROM o a LEFT JOIN o b ON a.game_id = b.game_id AND a.provider <> b.provider GROUP BY a.game_id, a.provider, a.total""")
def leave_one_out(spark, sf):
    """Each book's total against the median of the other books, from one list per game (five books at most)."""
    votes = _one_vote(line_tape(spark, sf)).filter(F.col("provider").between(1, 5) & F.col("total").isNotNull())
    per = votes.groupBy("game_id").agg(F.sort_array(F.collect_list(F.struct("total", "provider"))).alias("books"))
    each = per.select("game_id", "books", F.explode("books").alias("own"))
    rest = F.transform(F.filter("books", lambda b: b["provider"] != F.col("own.provider")), lambda b: b["total"])
    n, half = F.size("rest"), F.floor(F.size("rest") / 2).cast("int")
    median = F.when(n == 0, None).when(n % 2 == 1, F.get("rest", half)).otherwise((F.get("rest", half - 1) + F.get("rest", half)) / 2)
    out = each.withColumn("rest", rest).withColumn("fair_total", median)
    return out.select("game_id", "own.provider", "own.total", "fair_total", F.size("rest").cast("long").alias("n_other"), (F.col("own.total") - F.col("fair_total")).alias("gap"))


@query("""SELECT p.event_id AS bet_id, p.user_id AS event, p.ts AS decided_at, p.value AS stake, t.value AS line, t.ts AS quoted_at
 FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max_by(value, event_id) AS value FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id, ts) t
 ON p.user_id = t.user_id AND p.ts >= t.ts""")
def asof_tick(spark, sf):
    """The last tick at or before each decision."""
    found = ticks(spark, sf).withColumnRenamed("updated_at", "quoted_at")
    return asof_join(purchases(spark, sf), found.withColumn("__at", F.col("quoted_at")), ["event"], "decided_at", "__at", ["line", "quoted_at"], tie="event_id")


@query("""WITH t AS (SELECT user_id AS event, event_type AS market, ts, value AS line, event_id, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS was FROM events WHERE event_type IN ('view','click'))
 SELECT event, market, ts AS updated_at, line, event_id FROM t WHERE line IS DISTINCT FROM was""")
def tick_changes(spark, sf):
    """Ticks that changed the number."""
    w = Window.partitionBy("event", "market").orderBy("updated_at", "event_id")
    return ticks(spark, sf).withColumn("was", F.lag("line").over(w)).filter(~F.col("line").eqNullSafe(F.col("was"))).drop("was")


@query("""SELECT user_id AS event, time_bucket(INTERVAL '6 hours', ts) AS bucket, count(*) AS n, max_by(value, (ts, event_id)) AS last_line, round(max(value) - min(value), 6) AS spread
 FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2""")
def tick_buckets(spark, sf):
    got = ticks(spark, sf).groupBy("event", F.window("updated_at", "6 hours").alias("w"))
    out = got.agg(F.count(F.lit(1)).alias("n"), F.max_by("line", F.struct("updated_at", "event_id")).alias("last_line"), rounded(F.max("line") - F.min("line"), 6).alias("spread"))
    return out.select("event", F.col("w.start").alias("bucket"), "n", "last_line", "spread")


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, user_id AS event, event_type AS market, max_by(value, (ts, event_id)) AS line FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL),
 span AS (SELECT event, market, min(hour) AS a, max(hour) AS b FROM h GROUP BY ALL), grid AS (SELECT event, market, unnest(generate_series(a, b, INTERVAL '1 hour')) AS hour FROM span)
 SELECT event, market, hour, h.line IS NOT NULL AS quoted, last_value(h.line IGNORE NULLS) OVER (PARTITION BY event, market ORDER BY hour ROWS UNBOUNDED PRECEDING) AS line FROM grid LEFT JOIN h USING (event, market, hour)""")
def hour_grid(spark, sf):
    """A complete hourly grid of every series, the last line carried forward: each tick's hour is exploded up to the next one's."""
    hour = F.date_trunc("hour", "updated_at").cast("timestamp_ntz")
    per = ticks(spark, sf).groupBy("event", "market", hour.alias("h")).agg(F.max_by("line", F.struct("updated_at", "event_id")).alias("line"))
    held = F.coalesce(F.expr("timestampdiff(HOUR, h, lead(h) OVER (PARTITION BY event, market ORDER BY h))"), F.lit(1)).cast("int")
    rows = per.withColumn("held", held).select("event", "market", "h", "line", F.explode(F.sequence(F.lit(0), F.col("held") - 1)).alias("ahead"))
    return rows.select("event", "market", F.expr("h + make_dt_interval(0, ahead, 0, 0)").alias("hour"), (F.col("ahead") == 0).alias("quoted"), "line")


@query("""SELECT event_type, (props->>'k')::BIGINT % 10 AS k, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def json_props(spark, sf):
    """Schema-on-read of a JSON column."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf, "events").groupBy("event_type", (k % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 4).alias("value"))


@query(f"""WITH {GAMES_SQL}, {_VOTE}, j AS (SELECT season, provider, game_id, CASE WHEN game_id % 2 = 0 THEN v.spread_open - v.spread ELSE v.spread - v.spread_open END AS clv FROM games JOIN vote v USING (game_id) WHERE v.spread IS NOT NULL AND v.spread_open IS NOT NULL)
 SELECT season, provider, count(*) AS n, round(avg(clv), 6) AS mean_clv, round(var_pop(clv), 6) AS var_clv, round(count(*) FILTER (clv > 0) / count(*)::DOUBLE, 6) AS beat_close FROM j GROUP BY season, provider""")
def clv_by_season(spark, sf):
    """Closing-line value of opening bets (home on even games, against it on odd ones)."""
    lines = _one_vote(line_tape(spark, sf)).filter("spread IS NOT NULL AND spread_open IS NOT NULL").select("game_id", "provider", F.col("spread").alias("close"), F.col("spread_open").alias("taken"))
    side = F.when(F.col("game_id") % 2 == 0, "home").otherwise("over")
    bets = games(spark, sf).select("game_id", "season").join(lines, "game_id").withColumn("clv", clv_points(side, F.col("taken"), F.col("close")))
    return bets.groupBy("season", "provider").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("clv"), 6).alias("mean_clv"), rounded(F.var_pop("clv"), 6).alias("var_clv"), rounded(F.count_if(F.col("clv") > 0) / F.count(F.lit(1)), 6).alias("beat_close"))


@query(f"""WITH {_GRADED}, r AS (SELECT home_team AS team, season, count(*) FILTER (result = 'W') AS w, count(*) FILTER (result <> 'P') AS n FROM graded GROUP BY ALL)
 , z AS (SELECT *, round(w / n::DOUBLE, 4) AS hit, (round(w / n::DOUBLE, 4) - 110.0/210) / sqrt(110.0/210 * 100/210 / n) AS z FROM r WHERE n > 0),
 p AS (SELECT *, 1 - {NORM_CDF_SQL.replace("{z}", "z")} AS p FROM z), k AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY p, team) AS i, count(*) OVER (PARTITION BY season) AS m FROM p)
 SELECT season, team, w AS wins, n, round(p, 6) AS p_value,
  round(least(1.0, min(p * m / i) OVER (PARTITION BY season ORDER BY p, team ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh,
  round(least(1.0, max(p * (m - i + 1)) OVER (PARTITION BY season ORDER BY p, team ROWS UNBOUNDED PRECEDING)), 6) AS holm,
  round(greatest(0.0, (w/n::DOUBLE + 1.96*1.96/(2*n) - 1.96 * sqrt((w/n::DOUBLE*(1-w/n::DOUBLE) + 1.96*1.96/(4*n))/n)) / (1 + 1.96*1.96/n)), 4) AS wilson_low,
  round(least(1.0, (w/n::DOUBLE + 1.96*1.96/(2*n) + 1.96 * sqrt((w/n::DOUBLE*(1-w/n::DOUBLE) + 1.96*1.96/(4*n))/n)) / (1 + 1.96*1.96/n)), 4) AS wilson_high FROM k""")
def significance(spark, sf):
    """Hit rate of each team against break-even, with Wilson bounds and p-values adjusted within the season."""
    bets = grade(games(spark, sf), SystemFilter())
    rows = bets.groupBy(F.col("home_team").alias("team"), "season").agg(F.count_if(F.col("result") == "W").alias("wins"), F.count_if(F.col("result") != "P").alias("n")).filter("n > 0")
    even = implied_probability(F.lit(-110.0))
    z = (rounded(F.col("wins") / F.col("n"), 4) - even) / F.sqrt(even * (1 - even) / F.col("n"))
    rows = adjusted(rows.withColumn("p", 1 - norm_cdf(z)), "p", "team", ["season"])
    low, high = wilson(F.col("wins"), F.col("n"))
    return rows.select("season", "team", "wins", "n", rounded("p", 6).alias("p_value"), rounded("bh", 6).alias("bh"), rounded("holm", 6).alias("holm"), low.alias("wilson_low"), high.alias("wilson_high"))


@query(f"""WITH {_GRADED}, c AS (SELECT season, week, sum(margin) AS s, sum(margin * margin) AS ss, count(*) AS n FROM graded GROUP BY season, week),
 a AS (SELECT season, count(*) AS g, sum(n)::DOUBLE AS n, sum(s) AS s, sum(ss) AS ss, sum(n * n)::DOUBLE AS nn, sum(s * s) AS s2, sum(s * n) AS sn, sum(s * s / n) AS b FROM c GROUP BY season),
 i AS (SELECT *, s / n AS mean, sqrt(g / (g - 1.0::DOUBLE) * greatest(0, s2 - 2 * s / n * sn + s / n * s / n * nn)) / n AS se, (b - s * s / n) / nullif(g - 1, 0) AS msb, (ss - b) / nullif(n - g, 0) AS msw, (n - nn / n) / nullif(g - 1, 0) AS m0 FROM a WHERE g > 1),
 j AS (SELECT *, greatest(0.0, least(1.0, coalesce((msb - msw) / nullif(msb + (m0 - 1) * msw, 0), 0))) AS icc FROM i)
 SELECT season, g AS clusters, n::BIGINT AS n, round(mean, 6) AS mean, round(se, 6) AS se, round(icc, 6) AS icc, round(1 + (n / g - 1) * icc, 6) AS deff FROM j""")
def clustered_margin(spark, sf):
    """Mean margin with week-clustered standard error, intra-class correlation and design effect."""
    out = clustered_mean(grade(games(spark, sf), SystemFilter()), "margin", ["week"], ["season"]).filter("clusters > 1")
    return out.select("season", "clusters", "n", *(rounded(c, 6).alias(c) for c in ("mean", "se", "icc", "deff")))


@query(f"""WITH {GAMES_SQL} SELECT season, count(home_points) AS n, round(skewness(home_points + away_points), 6) AS skewness, round(kurtosis(home_points + away_points), 6) AS kurtosis,
 round(stddev_samp(home_points + away_points), 6) AS sd, round(corr(total, home_points + away_points), 6) AS corr, round(regr_slope(home_points + away_points, total), 6) AS slope, round(regr_r2(home_points + away_points, total), 6) AS r2,
 round(quantile_cont(home_points + away_points, 0.25), 6) AS q25, round(median(home_points + away_points), 6) AS q50 FROM games GROUP BY season""")
def moments(spark, sf):
    rows = games(spark, sf).withColumn("points", (F.col("home_points") + F.col("away_points")).cast("double"))
    skew, kurt = sample_moments("points")
    out = rows.groupBy("season").agg(F.count("points").alias("n"), skew, kurt, F.stddev_samp("points").alias("sd"), F.corr("total", "points").alias("corr"), F.regr_slope("points", "total").alias("slope"), F.regr_r2("points", "total").alias("r2"), F.percentile("points", 0.25).alias("q25"), F.median("points").alias("q50"))
    return out.select("season", "n", *(rounded(c, 6).alias(c) for c in ("skewness", "kurtosis", "sd", "corr", "slope", "r2", "q25", "q50")))


@query(f"""WITH {GAMES_SQL}, h AS (SELECT home_points + away_points AS points, count(*) AS n FROM games WHERE home_points IS NOT NULL GROUP BY 1),
 d AS (SELECT unnest(generate_series(0, (SELECT max(points) FROM h))) AS points), f AS (SELECT d.points::BIGINT AS points, coalesce(h.n, 0) AS n FROM d LEFT JOIN h USING (points))
 SELECT points, n, round(n / sum(n) OVER ()::DOUBLE, 8) AS share, round(sum(n) OVER (ORDER BY points DESC ROWS UNBOUNDED PRECEDING) / sum(n) OVER ()::DOUBLE, 8) AS at_least,
  round(4.0::DOUBLE * n / nullif(lag(n, 2) OVER (ORDER BY points) + lead(n, 2) OVER (ORDER BY points) + lag(n, 4) OVER (ORDER BY points) + lead(n, 4) OVER (ORDER BY points), 0), 6) AS lift FROM f""")
def points_distribution(spark, sf):
    """Histogram of the points with exceedance and lift over the neighbours of equal parity.

    The windows run over the integers up to the highest score, after the aggregation.
    """
    counts = games(spark, sf).filter("home_points IS NOT NULL").groupBy((F.col("home_points") + F.col("away_points")).alias("points")).agg(F.count(F.lit(1)).alias("n"))
    domain = counts.agg(F.max("points").alias("top")).select(F.explode(F.sequence(F.lit(0), "top")).alias("points"))
    dense = domain.join(counts, "points", "left").select(F.col("points").cast("long").alias("points"), F.coalesce("n", F.lit(0)).alias("n"))
    up = Window.partitionBy(F.lit(0)).orderBy("points")
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("points")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_n = F.sum("n").over(Window.partitionBy(F.lit(0)))
    near = F.lag("n", 2).over(up) + F.lead("n", 2).over(up) + F.lag("n", 4).over(up) + F.lead("n", 4).over(up)
    return dense.select("points", "n", rounded(F.col("n") / all_n, 8).alias("share"), rounded(F.sum("n").over(down) / all_n, 8).alias("at_least"), rounded(F.lit(4.0) * F.col("n") / F.nullif(near, F.lit(0)), 6).alias("lift"))


@query(f"""WITH {GAMES_SQL}, {_TEAM_GAMES}, a AS (SELECT team, season, avg(points) AS off, avg(allowed) AS def, any_value(CASE WHEN team % 6 < 5 THEN concat('C', team % 6) END) AS conference FROM tg WHERE points IS NOT NULL GROUP BY team, season)
 SELECT team, season, conference, round(off, 6) AS offence, round(def, 6) AS defence, rank() OVER (PARTITION BY season ORDER BY off DESC) AS offence_rank, rank() OVER (PARTITION BY season ORDER BY def) AS defence_rank,
 rank() OVER (PARTITION BY season, conference ORDER BY off DESC) AS conference_rank, count(*) OVER (PARTITION BY season) AS ranked FROM a""")
def team_ranks(spark, sf):
    """Ranks in the season and in the conference, by direction; ties share the best rank."""
    conference = F.expr("CASE WHEN team % 6 < 5 THEN concat('C', team % 6) END")
    a = team_games(games(spark, sf)).filter("points IS NOT NULL").groupBy("team", "season").agg(F.avg("points").alias("off"), F.avg("allowed").alias("def")).withColumn("conference", conference)
    s = Window.partitionBy("season")
    return a.select("team", "season", "conference", rounded("off", 6).alias("offence"), rounded("def", 6).alias("defence"), F.rank().over(s.orderBy(F.desc("off"))).cast("long").alias("offence_rank"), F.rank().over(s.orderBy("def")).cast("long").alias("defence_rank"), F.rank().over(Window.partitionBy("season", "conference").orderBy(F.desc("off"))).cast("long").alias("conference_rank"), F.count(F.lit(1)).over(s).alias("ranked"))


@query(f"""WITH {GAMES_SQL} SELECT least(home_team, away_team) AS team_low, greatest(home_team, away_team) AS team_high, count(*) AS meetings,
 count(*) FILTER ((home_points > away_points) = (home_team < away_team) AND home_points <> away_points) AS low_wins, max_by(game_id, (kickoff, game_id)) AS last_game FROM games GROUP BY 1, 2""")
def head_to_head(spark, sf):
    rows = games(spark, sf)
    won = (F.col("home_points") != F.col("away_points")) & ((F.col("home_points") > F.col("away_points")) == (F.col("home_team") < F.col("away_team")))
    return rows.groupBy(*pair_key("home_team", "away_team")).agg(F.count(F.lit(1)).alias("meetings"), F.count_if(won).alias("low_wins"), F.max_by("game_id", F.struct("kickoff", "game_id")).alias("last_game"))


@query(f"""WITH {GAMES_SQL}, o AS (SELECT least(home_team, away_team) AS a, greatest(home_team, away_team) AS b, kickoff, min(game_id) AS game_id FROM games GROUP BY ALL),
 l AS (SELECT l_orderkey, l_linenumber, l_shipdate, least(home_team, away_team) AS a, greatest(home_team, away_team) AS b FROM lineitem JOIN games ON game_id = l_orderkey),
 p AS (SELECT l.*, o.game_id AS g1, o.kickoff AS k1 FROM l ASOF LEFT JOIN o ON l.a = o.a AND l.b = o.b AND l.l_shipdate >= o.kickoff),
 q AS (SELECT p.*, o.game_id AS g2, o.kickoff AS k2 FROM p ASOF LEFT JOIN o ON p.a = o.a AND p.b = o.b AND p.l_shipdate <= o.kickoff)
 SELECT l_orderkey AS quote_id, l_linenumber::BIGINT AS quote_no, l_shipdate AS quoted_at,
  CASE WHEN g2 IS NULL OR epoch(l_shipdate) - epoch(k1) < epoch(k2) - epoch(l_shipdate) THEN g1 WHEN g1 IS NULL OR epoch(k2) - epoch(l_shipdate) < epoch(l_shipdate) - epoch(k1) THEN g2 ELSE least(g1, g2) END AS game_id FROM q""")
def nearest_game(spark, sf):
    """Quotes that name only the two teams, matched to the pair's game of nearest kickoff.

    The pair's games are merged into one time line with the quotes; each quote looks back in two
    orders, so no quote is paired with every game of its pair and both frames grow at one end only.
    """
    every = games(spark, sf)
    first = every.groupBy(*pair_key("home_team", "away_team"), F.col("kickoff").alias("t")).agg(F.min("game_id").alias("game_id"))
    quotes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("quote_id"), F.col("l_linenumber").cast("long").alias("quote_no"), F.col("l_shipdate").alias("t"))
    quotes = quotes.join(every.select(F.col("game_id").alias("quote_id"), *pair_key("home_team", "away_team")), "quote_id")
    both = first.withColumns({"quote_id": F.lit(None).cast("long"), "quote_no": F.lit(None).cast("long")}).unionByName(quotes.withColumn("game_id", F.lit(None).cast("long")))
    both = both.repartition(tasks(table(spark, sf, "lineitem")), "team_low", "team_high")
    game = F.when(F.col("game_id").isNotNull(), F.struct("t", "game_id"))
    key = Window.partitionBy("team_low", "team_high")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    before = F.last(game, ignorenulls=True).over(key.orderBy("t").rangeBetween(*so_far))
    after = F.last(game, ignorenulls=True).over(key.orderBy(F.desc("t")).rangeBetween(*so_far))
    rows = both.withColumns({"b": before, "a": after}).filter("quote_id IS NOT NULL")
    gap = [F.expr(f"abs(timestampdiff(SECOND, t, {x}.t))") for x in "ba"]
    pick = F.when(F.col("a").isNull() | (gap[0] < gap[1]), F.col("b.game_id")).when(F.col("b").isNull() | (gap[1] < gap[0]), F.col("a.game_id")).otherwise(F.least("a.game_id", "b.game_id"))
    return rows.select("quote_id", "quote_no", F.col("t").alias("quoted_at"), pick.alias("game_id"))


@query(f"""WITH {GAMES_SQL}, {_TEAM_GAMES}, p AS (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY points DESC, game_id) AS place FROM tg WHERE points IS NOT NULL) SELECT team, season, place, game_id, points FROM p WHERE place <= 3""")
def best_games(spark, sf):
    """The three highest scores of each team and season: a top-k report."""
    w = Window.partitionBy("team", "season").orderBy(F.desc("points"), "game_id")
    return team_games(games(spark, sf)).filter("points IS NOT NULL").withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 3").select("team", "season", "place", "game_id", "points")


@query(f"""WITH {GAMES_SQL} SELECT team::BIGINT AS team FROM (SELECT home_team AS team FROM games WHERE season = 1996 AND spread < -10 INTERSECT SELECT away_team FROM games WHERE season = 1997 AND spread > 10) EXCEPT SELECT home_team FROM games WHERE season = 1998 AND total > 59""")
def set_operations(spark, sf):
    g = games(spark, sf)
    a, b, c = (g.filter(t).select(F.col(n).alias("team")) for t, n in (("season = 1996 AND spread < -10", "home_team"), ("season = 1997 AND spread > 10", "away_team"), ("season = 1998 AND total > 59", "home_team")))
    return a.intersect(b).subtract(c)


@query(f"""WITH {GAMES_SQL}, {_TEAM_GAMES} SELECT team, season, round(list_reduce(list(points::DOUBLE ORDER BY kickoff, game_id) FILTER (points IS NOT NULL), lambda a, x: 0.3 * x + 0.7 * a), 6) AS form FROM tg GROUP BY team, season HAVING count(points) > 0""")
def ewma_form(spark, sf):
    """Exponentially weighted scoring (0.3 for the newest game): a fold over a team-season's few games."""
    rows = team_games(games(spark, sf)).filter("points IS NOT NULL").groupBy("team", "season").agg(F.sort_array(F.collect_list(F.struct("kickoff", "game_id", F.col("points").cast("double").alias("x")))).alias("h"))
    start = F.get("h", F.lit(0))["x"]
    return rows.select("team", "season", rounded(F.aggregate("h", start, lambda a, r: F.when(r["game_id"] == F.col("h")[0]["game_id"], a).otherwise(0.3 * r["x"] + 0.7 * a)), 6).alias("form"))


@query(f"""WITH {_GRADED}, q AS (SELECT season, {NORM_CDF_SQL.replace("{z}", "(-spread / 13.5)")} AS p, (home_points > away_points)::INT AS y FROM graded)
 SELECT season, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-ln(CASE WHEN y = 1 THEN greatest(p, 1e-6) ELSE greatest(1 - p, 1e-6) END)), 6) AS log_loss FROM q GROUP BY season""")
def probability_scores(spark, sf):
    """Brier score and log loss of the win probability that the spread implies."""
    rows = grade(games(spark, sf), SystemFilter()).select("season", norm_cdf(-F.col("spread") / 13.5).alias("p"), (F.col("home_points") > F.col("away_points")).cast("int").alias("y"))
    said = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return rows.groupBy("season").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg((F.col("p") - F.col("y")) ** 2), 6).alias("brier"), rounded(F.avg(-F.log(F.greatest(said, F.lit(1e-6)))), 6).alias("log_loss"))


@query("""WITH o AS (SELECT o_orderkey AS quote_id, (-105 - o_orderkey % 40)::DOUBLE AS over_price, CASE WHEN o_orderkey % 3 = 0 THEN (100 + o_custkey % 60)::DOUBLE ELSE (-100 - o_custkey % 30)::DOUBLE END AS under_price FROM orders),
 p AS (SELECT *, -over_price / (-over_price + 100) AS po, CASE WHEN under_price < 0 THEN -under_price / (-under_price + 100) ELSE 100 / (under_price + 100) END AS pu FROM o)
 SELECT quote_id, round(po / (po + pu), 8) AS fair_over, round(po + pu - 1, 8) AS hold, round(greatest(0.0, ((po / (po + pu) + 0.03) * 100 / -over_price - (1 - po / (po + pu) - 0.03)) / (100 / -over_price)), 8) AS kelly FROM p""")
def odds_conversion(spark, sf):
    """Fair probability, hold and Kelly share with an edge of three points, of priced pairs."""
    o = table(spark, sf, "orders").selectExpr("o_orderkey AS quote_id", "CAST(-105 - o_orderkey % 40 AS DOUBLE) AS over_price", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(100 + o_custkey % 60 AS DOUBLE) ELSE CAST(-100 - o_custkey % 30 AS DOUBLE) END AS under_price")
    po, pu = implied_probability(F.col("over_price")), implied_probability(F.col("under_price"))
    fair = fair_pair(po, pu)
    return o.select("quote_id", rounded(fair, 8).alias("fair_over"), rounded(po + pu - 1, 8).alias("hold"), rounded(kelly(fair + 0.03, F.col("over_price")), 8).alias("kelly"))


@query(f"""WITH {GAMES_SQL}, {LINES_SQL} SELECT 'line_tape.game_id' AS edge, count(*) AS n, count(*) FILTER (game_id IS NULL) AS null_keys, count(*) FILTER (NOT EXISTS (SELECT 1 FROM games g WHERE g.game_id = t.game_id)) AS orphans FROM line_tape t
 UNION ALL SELECT 'customer.c_nationkey', count(*), count(*) FILTER (c_nationkey IS NULL), count(*) FILTER (NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey)) FROM customer""")
def orphan_edges(spark, sf):
    """Rows, null keys and orphans of declared edges."""

    def edge(name: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
        known = parent.select(F.col(parent_key).alias("__k"), F.lit(True).alias("__there")).distinct()
        return child.select(key).join(known, F.col(key) == F.col("__k"), "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("null_keys"), F.count_if(F.col("__there").isNull()).alias("orphans")).select(F.lit(name).alias("edge"), "*")

    lines = edge("line_tape.game_id", line_tape(spark, sf), "game_id", games(spark, sf), "game_id")
    return lines.unionByName(edge("customer.c_nationkey", table(spark, sf, "customer"), "c_nationkey", table(spark, sf, "nation"), "n_nationkey"))


_CELLS = [(side, size, half) for side in ("favourite", "underdog") for size in (0, 3, 7, 10) for half in ("early", "late")]


@query(f"""WITH {_GRADED}, c AS (SELECT result, profit, unnest(list_filter([{", ".join(f"CASE WHEN {'-spread' if s == 'favourite' else 'spread'} > {z} AND week {'<=' if h == 'early' else '>'} 26 THEN '{s}>{z} {h}' END" for s, z, h in _CELLS)}], lambda x: x IS NOT NULL)) AS candidate FROM graded) SELECT candidate, {_RECORD} FROM c GROUP BY candidate""")
def candidate_records(spark, sf):
    """Records of many candidate systems in one pass over the games."""
    tests = [(f"{s}>{z} {h}", ((-F.col("spread") if s == "favourite" else F.col("spread")) > z) & ((F.col("week") <= 26) if h == "early" else (F.col("week") > 26))) for s, z, h in _CELLS]
    return evaluate(grade(games(spark, sf), SystemFilter()), tests)


@query()
def beam_search(spark, sf):
    """Filter combinations found on all seasons but the last, graded on the last one."""
    return search.beam(games(spark, sf))


@query()
def ridge_ratings(spark, sf):
    """Opponent-adjusted attack and defence by season."""
    return models.ridge_ratings(games(spark, sf))


@query()
def bankroll_paths(spark, sf):
    """Quantiles of simulated bankrolls by season record."""
    return models.bankroll(grade(games(spark, sf), HOME_FAVOURITE))


@query(f"""WITH {GAMES_SQL}, r AS (SELECT season, total, home_points + away_points - total AS e FROM games WHERE home_points IS NOT NULL AND total IS NOT NULL),
 f AS (SELECT DISTINCT season FROM r) SELECT f.season, count(*) AS n_train, round(avg(e), 6) AS bias, round(sqrt(avg(e * e)), 6) AS rmse FROM f JOIN r ON r.season < f.season GROUP BY f.season""")
def walk_forward(spark, sf):
    """Bias and error of the total over all seasons before each one, from per-season sums."""
    e = F.col("home_points") + F.col("away_points") - F.col("total")
    per = games(spark, sf).filter("home_points IS NOT NULL AND total IS NOT NULL").groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("ss"))
    past = Window.partitionBy(F.lit(0)).orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    out = per.select("season", F.sum("n").over(past).alias("n_train"), F.sum("s").over(past).alias("s"), F.sum("ss").over(past).alias("ss")).filter("n_train > 0")
    return out.select("season", "n_train", rounded(F.col("s") / F.col("n_train"), 6).alias("bias"), rounded(F.sqrt(F.col("ss") / F.col("n_train")), 6).alias("rmse"))


# the other families of queries register themselves
from . import suites  # noqa: E402, F401

"""Queries of play clocks and tempo."""

from __future__ import annotations

from ..operators import pace as p
from ..registry import query, rounded
from ..sources.proxy import ctes, made

#: Forty orders a game, an order a drive; a third of the games has a stale clock.
PLAYS = """SELECT CAST(l_orderkey AS BIGINT) div 40 AS game_id, CAST(1992 + (l_orderkey div 40) % 6 AS BIGINT) AS season, CAST(1 + (l_orderkey div 240) % 12 AS BIGINT) AS week, l_orderkey AS drive, CAST(l_linenumber AS BIGINT) AS number, l_partkey * 1000 + l_suppkey AS play_id,
 CASE WHEN l_partkey % 8 < 5 THEN 'Rush' WHEN l_partkey % 8 < 7 THEN 'Pass Reception' ELSE 'Punt' END AS type, CASE WHEN l_suppkey % 19 = 0 THEN 1 + (l_orderkey div 80) % 16 ELSE (l_orderkey div 40) % 16 END AS offense, (l_orderkey div 40 + 5) % 16 AS defense, CAST(1 + l_orderkey % 5 AS BIGINT) AS period,
 CASE WHEN (l_orderkey div 40) % 3 = 0 THEN 800 - 100 * (l_linenumber div 3) ELSE 800 - 40 * l_linenumber - l_partkey % 23 END AS secs, CASE WHEN l_suppkey % 23 <> 0 THEN CAST(l_shipdate AS TIMESTAMP) + make_dt_interval(0, 0, 0, CAST(60 * l_linenumber AS DECIMAL(18,6))) END AS wall,
 CAST(l_orderkey % 31 - 15 AS BIGINT) AS margin, l_partkey % 9 AS gained, CAST(6 AS BIGINT) AS distance FROM {lineitem}"""
_SQL = PLAYS.replace("CAST(l_orderkey AS BIGINT) div 40", "l_orderkey // 40").replace(" div ", " // ").replace("make_dt_interval(0, 0, 0, CAST(60 * l_linenumber AS DECIMAL(18,6)))", "INTERVAL 60 SECOND * l_linenumber")
_PAIRS = f"""{ctes(plays=_SQL)}, n AS (SELECT *, lead(type) OVER w AS nt, lead(offense) OVER w AS no, lead(period) OVER w AS np, lead(secs) OVER w AS ns, lead(wall) OVER w AS nw FROM plays WHERE period <= 4 WINDOW w AS (PARTITION BY drive ORDER BY number, play_id)),
 pairs AS (SELECT *, secs - ns AS spent, epoch(nw) - epoch(wall) AS wspent FROM n WHERE type = 'Rush' AND no = offense AND np = period AND nt IN {p.SCRIMMAGE}),
 quality AS (SELECT game_id, any_value(season) AS season, count(*) AS rush_pairs, avg((spent <= 0)::INT) AS c, avg(coalesce(wspent <= 0, true)::INT) AS w FROM pairs GROUP BY game_id)"""
_RUNNING = f"""{_PAIRS}, run AS (SELECT *, period <= 3 AND abs(margin) <= 14 AND NOT (period IN (2, 4) AND secs <= 120) AS neutral, margin <= -9 AND NOT (period IN (2, 4) AND secs <= 120) AS chasing FROM pairs WHERE gained < distance AND game_id IN (SELECT game_id FROM quality WHERE c < 0.1))"""


@query(f"WITH {_PAIRS} SELECT game_id, season, rush_pairs, round(c, 6) AS clock_stale_share, round(w, 6) AS wallclock_stale_share, c < 0.1 AS clock_ok, w < 0.1 AS wallclock_ok FROM quality")
def fact_game_clock_quality(spark, sf):
    """Whether a game's clock can be used for timing, from rushes and the snaps after them."""
    out = p.clock_quality(made(spark, sf, PLAYS))
    return out.select("game_id", "season", "rush_pairs", rounded("clock_stale_share").alias("clock_stale_share"), rounded("wallclock_stale_share").alias("wallclock_stale_share"), "clock_ok", "wallclock_ok")


_TEMPO = f"""{_RUNNING}, fast AS (SELECT season, quantile_cont(spent, 0.25) AS fast FROM run WHERE neutral GROUP BY season), own AS (SELECT season, offense AS team, median(spent) AS t, avg((spent <= fast)::INT) AS h, count(*) AS n FROM run JOIN fast USING (season) WHERE neutral GROUP BY ALL),
 faced AS (SELECT season, defense AS team, median(spent) AS f, count(*) AS n FROM run WHERE neutral GROUP BY ALL), behind AS (SELECT season, offense AS team, median(spent) AS b, count(*) AS n FROM run WHERE chasing GROUP BY ALL),
 tempo AS (SELECT season, team, CASE WHEN own.n >= 30 THEN t END AS tempo_s, CASE WHEN own.n >= 30 THEN h END AS hurry_rate, own.n AS n_neutral, CASE WHEN behind.n >= 15 THEN b - t END AS trail_delta_s, behind.n AS n_trail, CASE WHEN faced.n >= 30 THEN f END AS tempo_faced_s, faced.n AS n_faced FROM own LEFT JOIN behind USING (season, team) FULL JOIN faced USING (season, team))"""


@query(f"WITH {_TEMPO} SELECT season, team, tempo_s, round(hurry_rate, 6) AS hurry_rate, n_neutral, trail_delta_s, n_trail, tempo_faced_s, n_faced FROM tempo")
def tempo_by_team(spark, sf):
    """Seconds between neutral snaps by team and season, hurries, the change when trailing, and the defence's side."""
    return p.tempo(p.running_pairs(made(spark, sf, PLAYS))).withColumn("hurry_rate", rounded("hurry_rate"))


@query(f"""WITH {_TEMPO}, d AS (SELECT *, dense_rank() OVER (PARTITION BY season, offense ORDER BY week) % 2 AS half FROM run), halves AS (SELECT season, offense AS team, CASE WHEN count(*) FILTER (half = 0) >= 30 THEN median(spent) FILTER (half = 0) END AS a, CASE WHEN count(*) FILTER (half = 1) >= 30 THEN median(spent) FILTER (half = 1) END AS b FROM d WHERE neutral GROUP BY ALL),
 r AS (SELECT corr(a, b) AS r FROM halves), y AS (SELECT corr(n.tempo_s, l.tempo_s) AS y FROM tempo n JOIN tempo l ON l.team = n.team AND l.season = n.season + 1) SELECT round(r, 6) AS split_half, round(2 * r / (1 + r), 6) AS full_season, round(y, 6) AS next_season FROM r, y""")
def pace(spark, sf):
    """How far a team's tempo repeats: between halves of its season, and from season to season."""
    out = p.reliability(p.running_pairs(made(spark, sf, PLAYS)))
    return out.select(*(rounded(c).alias(c) for c in ("split_half", "full_season", "next_season")))

"""Queries of the rating and forecast models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import NORM_CDF_SQL
from ..operators import forecasts as fc
from ..operators import ratings as m
from ..operators.running import team_games
from ..registry import query, rounded
from ..sources.proxy import ctes, games
from .joins import TEAM_GAMES_SQL

_Z = lambda z: NORM_CDF_SQL.replace("{z}", z)


@query(f"WITH {ctes()}, c AS (SELECT season, min(kickoff) + INTERVAL 100 DAY AS cutoff FROM games GROUP BY season) SELECT season, count(*) AS games, round(avg(home_points), 6) AS home, round(avg(away_points), 6) AS away FROM games JOIN c USING (season) WHERE kickoff < cutoff GROUP BY season")
def asof_snapshot(spark, sf):
    """Raw means of each season up to a cutoff."""
    g = games(spark, sf)
    cutoffs = g.groupBy("season").agg((F.min("kickoff") + F.expr("INTERVAL '100' DAY")).alias("cutoff"))
    return m.snapshot(g, cutoffs).groupBy("season").agg(F.count(F.lit(1)).alias("games"), rounded(F.avg("home_points")).alias("home"), rounded(F.avg("away_points")).alias("away"))


@query(f"WITH {ctes()}, e AS (SELECT game_id, home_points AS p, CASE WHEN game_id % 13 = 0 THEN home_points + 1 ELSE home_points END AS q, game_id % 9 AS a, game_id % 11 AS b FROM games) SELECT coalesce(CASE WHEN p IS NULL THEN 'unplayed' WHEN q <> p THEN 'line score' WHEN abs(a - b) > 2 THEN 'drives' END, 'kept') AS dropped, count(*) AS n FROM e GROUP BY 1")
def evidence_drops(spark, sf):
    e = games(spark, sf).select("game_id", F.col("home_points").alias("points"), F.when(F.col("game_id") % 13 == 0, F.col("home_points") + 1).otherwise(F.col("home_points")).alias("quarters"), (F.col("game_id") % 9).alias("drives_off"), (F.col("game_id") % 11).alias("drives_def"))
    return m.evidence(e).groupBy(F.coalesce("dropped", F.lit("kept")).alias("dropped")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ctes()}, {TEAM_GAMES_SQL}, w AS (SELECT team, season, week, avg(points) AS x FROM tg GROUP BY ALL) SELECT a.team, a.season, a.week, round(sum(b.x * pow(0.9, a.week - b.week)) / sum(pow(0.9, a.week - b.week)) FILTER (b.x IS NOT NULL), 6) AS rating FROM w a LEFT JOIN w b ON b.team = a.team AND b.season = a.season AND b.week < a.week GROUP BY ALL")
def decay_ratings(spark, sf):
    """Scoring so far, each week weighing nine tenths of the one after it."""
    w = team_games(games(spark, sf)).groupBy("team", "season", "week").agg(F.avg("points").alias("x"))
    return m.decayed(w, ["team", "season"], "week", "x", 0.9).select("team", "season", "week", rounded("rating").alias("rating"))


@query(f"WITH RECURSIVE {ctes()}, {TEAM_GAMES_SQL}, w0 AS (SELECT team, season, week, sum(points)::DOUBLE AS s, count(points) AS n FROM tg WHERE points IS NOT NULL GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY week) AS i FROM w0), k AS (SELECT team, season, week, i, 0.0::DOUBLE AS mean, 50.0::DOUBLE AS variance, s, n FROM w WHERE i = 1 UNION ALL SELECT w.team, w.season, w.week, w.i, (k.mean / k.variance + k.s / 100.0::DOUBLE) / (1 / k.variance + k.n / 100.0::DOUBLE), 1 / (1 / k.variance + k.n / 100.0::DOUBLE) + (w.week - k.week), w.s, w.n FROM k JOIN w ON w.team = k.team AND w.season = k.season AND w.i = k.i + 1) SELECT team, season, week, round(mean, 6) AS mean, round(variance, 6) AS variance FROM k")
def kalman_ratings(spark, sf):
    """A team's level before each week, filtered from the weeks before."""
    rows = team_games(games(spark, sf)).filter("points IS NOT NULL").select("team", "season", "week", F.col("points").cast("double").alias("x"))
    out = m.kalman(rows)
    return out.select("team", F.col("season").cast("long").alias("season"), F.col("week").cast("long").alias("week"), rounded("mean").alias("mean"), rounded("variance").alias("variance"))


_RATED = f"{ctes()}, r AS (SELECT home_team AS team, season, avg(home_points) AS x, CASE WHEN (home_team + season) % 9 <> 0 THEN (home_team * 7 + season) % 10 / 10.0::DOUBLE END AS rp FROM games WHERE home_points IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {_RATED}, c AS (SELECT *, x - avg(x) OVER (PARTITION BY season) AS u FROM r), w AS (SELECT team, season + 1 AS season, u FROM c), q AS (SELECT w.team, w.u, c.u AS y, c.rp * w.u AS z FROM w JOIN c USING (team, season) WHERE c.rp IS NOT NULL),
 p AS (SELECT team, sum(u * u) AS uu, sum(u * z) AS uz, sum(z * z) AS zz, sum(u * y) AS uy, sum(z * y) AS zy FROM q GROUP BY team), t AS (SELECT sum(uu) AS uu, sum(uz) AS uz, sum(zz) AS zz, sum(uy) AS uy, sum(zy) AS zy FROM p),
 f AS (SELECT *, uu * zz - uz * uz AS det, (zz * uy - uz * zy) / (uu * zz - uz * uz) AS b, (uu * zy - uz * uy) / (uu * zz - uz * uz) AS c FROM t), s AS (SELECT p.uy - b * p.uu - c * p.uz AS su, p.zy - b * p.uz - c * p.zz AS sz FROM p, f), m AS (SELECT sum(su * su) AS m11, sum(su * sz) AS m12, sum(sz * sz) AS m22 FROM s),
 e AS (SELECT b, c, sqrt(zz * zz * m11 - 2 * zz * uz * m12 + uz * uz * m22) / det AS se_b, sqrt(uz * uz * m11 - 2 * uz * uu * m12 + uu * uu * m22) / det AS se_c FROM f, m),
 a AS (SELECT w.team, w.season, w.u, r.rp, coalesce(r.rp, avg(r.rp) OVER (PARTITION BY w.season), avg(r.rp) OVER ()) AS held FROM w LEFT JOIN r USING (team, season)), o AS (SELECT *, (b + c * held) * u AS prior FROM a, e)
 SELECT team, season, round(prior - avg(prior) OVER (PARTITION BY season), 6) AS prior, round(b, 6) AS b, round(c, 6) AS c, round(se_b, 6) AS se_b, round(se_c, 6) AS se_c, CASE WHEN rp IS NULL THEN 'imputed' ELSE 'carryover' END AS source FROM o""")
def carry_over_priors(spark, sf):
    """Next season's priors from ratings and returning production."""
    rp = F.when((F.col("home_team") + F.col("season")) % 9 != 0, (F.col("home_team") * 7 + F.col("season")) % 10 / 10.0)
    r = games(spark, sf).filter("home_points IS NOT NULL").withColumn("rp", rp).groupBy(F.col("home_team").alias("team"), "season").agg(F.avg("home_points").alias("x"), F.first("rp").alias("rp"))
    return m.carry_over(r, "team", "season", "x", "rp").select("team", "season", *(rounded(c).alias(c) for c in ("prior", "b", "c", "se_b", "se_c")), "source")


def _bias(mean: str) -> str:
    return f"(({mean}) * ({_Z(f'(({mean}) / 9.0::DOUBLE)')}) + 9.0::DOUBLE * exp(-pow(({mean}) / 9.0::DOUBLE, 2) / 2) * 0.3989422804014327 - ({mean}))"


@query(f"WITH {ctes()}, f AS (SELECT game_id, (total - spread) / 2 - 18 AS m FROM games WHERE total IS NOT NULL AND spread IS NOT NULL) SELECT game_id, round({_bias('m')}, 5) AS floor_bias, round(-{_bias('40 - m')}, 5) AS ceiling_bias FROM f")
def censoring_bias(spark, sf):
    """What the floor at zero adds to a side's expected points, and what a ceiling takes."""
    f = games(spark, sf).filter("total IS NOT NULL AND spread IS NOT NULL").select("game_id", ((F.col("total") - F.col("spread")) / 2 - 18).alias("m"))
    return f.select("game_id", rounded(m.censored_bias(F.col("m"), F.lit(9.0)), 5).alias("floor_bias"), rounded(m.ceiling_bias(F.col("m"), F.lit(9.0), F.lit(40.0)), 5).alias("ceiling_bias"))


@query(f"WITH {ctes()}, s AS (SELECT season, min(kickoff) AS start FROM games GROUP BY season) SELECT s.season AS fold, CASE WHEN g.season = s.season THEN 'test' WHEN date_diff('day', g.kickoff, s.start) > 21 THEN 'train' ELSE 'embargo' END AS role, count(*) AS n FROM s JOIN games g ON g.season <= s.season GROUP BY ALL")
def holdout_folds(spark, sf):
    """Rows by fold and role, three weeks of embargo before each test season."""
    return m.holdout_folds(games(spark, sf).select("season", "kickoff"), "season", "kickoff", 21).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ctes()}, f AS (SELECT game_id, list_filter([spread, total - 50, CASE WHEN game_id % 4 <> 0 THEN home_points / 2.0::DOUBLE END], lambda x: x IS NOT NULL) AS v FROM games) SELECT game_id, len(v) AS n, round(list_avg(v), 6) AS mean, round(list_median(v), 6) AS median, list_max(v) - list_min(v) AS spread FROM f WHERE len(v) >= 2")
def consensus_forecast(spark, sf):
    f = games(spark, sf).select("game_id", F.col("spread").alias("a"), (F.col("total") - 50).alias("b"), F.when(F.col("game_id") % 4 != 0, F.col("home_points") / 2).alias("c"))
    return m.consensus(f, ["game_id"], ["a", "b", "c"]).select("game_id", "n", rounded("mean").alias("mean"), rounded("median").alias("median"), "spread")


@query(f"WITH {ctes()}, w AS (SELECT unnest([0.0, 0.25, 0.5, 1.0]::DOUBLE[]) AS share), f AS (SELECT season, share, total + share * (50 - total) - home_points - away_points AS e FROM games, w WHERE home_points IS NOT NULL AND total IS NOT NULL), s AS (SELECT season, share, count(*) AS n, sum(e * e) AS ss FROM f GROUP BY ALL) SELECT season, share, round(sqrt(sum(ss) OVER o / sum(n) OVER o), 6) AS rmse_before FROM s WINDOW o AS (PARTITION BY share ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def combination_sweep(spark, sf):
    """Market lines moved to a forecast by several shares: the error of each share over the seasons before."""
    from pyspark.sql import Window

    f = games(spark, sf).filter("home_points IS NOT NULL AND total IS NOT NULL").withColumn("share", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 1.0)))))
    e = m.anchored(F.col("total"), F.lit(50.0), F.col("share")) - F.col("home_points") - F.col("away_points")
    s = f.groupBy("season", "share").agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("ss"))
    o = Window.partitionBy("share").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("season", "share", rounded(F.sqrt(F.sum("ss").over(o) / F.sum("n").over(o))).alias("rmse_before"))


_PMF = "p AS (SELECT season, (home_points + away_points)::BIGINT AS k, count(*) AS n FROM games WHERE home_points IS NOT NULL GROUP BY ALL), t AS (SELECT season, sum(n) AS total, max(k) AS top FROM p GROUP BY season), d AS (SELECT season, unnest(generate_series(0, top)) AS k, total FROM t), f AS (SELECT d.season, d.k, coalesce(n, 0) / d.total::DOUBLE AS pmf, sum(coalesce(n, 0)) OVER (PARTITION BY d.season ORDER BY d.k) / d.total::DOUBLE AS cdf FROM d LEFT JOIN p ON p.season = d.season AND p.k = d.k)"


@query(f"WITH {ctes()}, {_PMF} SELECT season, round(sum(pow(cdf - (k >= 55)::INT, 2)), 6) AS crps, round(max(cdf) FILTER (k = 54) + max(pmf) FILTER (k = 55) / 2, 6) AS pit, min(k) FILTER (cdf >= 0.5 - 1e-12)::BIGINT AS median, round(CASE WHEN 55 >= min(k) FILTER (cdf >= 0.9 - 1e-12) THEN 0.9 * (55 - min(k) FILTER (cdf >= 0.9 - 1e-12)) ELSE 0.1 * (min(k) FILTER (cdf >= 0.9 - 1e-12) - 55) END, 6) AS pinball FROM f GROUP BY season")
def distribution_scores(spark, sf):
    """Scores of each season's distribution of points for a game of 55."""
    points = games(spark, sf).filter("home_points IS NOT NULL").select("season", (F.col("home_points") + F.col("away_points")).alias("k"))
    d = fc.empirical_pmf(points, "k", ["season"]).withColumn("cdf", fc.cumulated(F.col("pmf")))
    y, high = F.lit(55), fc.quantile(F.col("cdf"), 0.9)
    return d.select("season", rounded(fc.crps(F.col("cdf"), y)).alias("crps"), rounded(fc.mid_pit(F.col("pmf"), F.col("cdf"), y)).alias("pit"), fc.quantile(F.col("cdf"), 0.5).alias("median"), rounded(fc.pinball(y, high, 0.9)).alias("pinball"))


@query(f"WITH {ctes()}, c AS (SELECT season, game_id, abs(spread) AS conf, pow(home_points - away_points + spread, 2) AS loss FROM games WHERE home_points IS NOT NULL AND spread IS NOT NULL), r AS (SELECT season, avg(loss) OVER (PARTITION BY season ORDER BY conf DESC, game_id ROWS UNBOUNDED PRECEDING) AS risk FROM c) SELECT season, count(*) AS n, round(avg(risk), 4) AS aurc FROM r GROUP BY season")
def selective_risk(spark, sf):
    """Area under the risk-coverage curve, the largest spreads first."""
    e = F.col("home_points") - F.col("away_points") + F.col("spread")
    c = games(spark, sf).filter("home_points IS NOT NULL AND spread IS NOT NULL").select("season", "game_id", F.abs("spread").alias("conf"), (e * e).alias("loss"))
    return fc.risk_coverage(c, "conf", "loss", ["season"], "game_id").groupBy("season").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("risk"), 4).alias("aurc"))


@query(f"WITH {ctes()}, h AS (SELECT home_team AS team, home_points AS k, count(*) AS n FROM games WHERE home_points IS NOT NULL GROUP BY ALL), t AS (SELECT team, sum(n) AS total FROM h GROUP BY team), p AS (SELECT team, k, n / total::DOUBLE AS p FROM h JOIN t USING (team)) SELECT a.team, (a.k + b.k)::BIGINT AS points, round(sum(a.p * b.p), 8) AS p FROM p a JOIN p b ON a.team = b.team GROUP BY a.team, a.k + b.k")
def summed_points(spark, sf):
    """Distribution of the sum of two independent scores of a team."""
    h = games(spark, sf).filter("home_points IS NOT NULL").select(F.col("home_team").alias("team"), F.col("home_points").alias("k"))
    d = fc.empirical_pmf(h, "k", ["team"])
    out = d.select("team", F.posexplode(fc.convolve(F.col("pmf"), F.col("pmf"))).alias("points", "p")).filter("p > 0")
    return out.select("team", F.col("points").cast("long").alias("points"), rounded("p", 8).alias("p"))


def _possessions(spark, sf):
    g = team_games(games(spark, sf)).filter("points IS NOT NULL")
    n = F.col("game_id") % 5 + 10
    return g.select(F.col("season").cast("int").alias("season"), F.lit("end").alias("cutoff"), "team", "opponent", "is_home", (F.col("points") / n).alias("rate"), n.cast("double").alias("weight"))


@query()
def possession_ratings(spark, sf):
    """Points per possession and pace of every team, adjusted for opponents and home field."""
    return m.ratings_at(_possessions(spark, sf))


@query()
def adjusted_effects(spark, sf):
    """Crossed random effects with their standard errors, blended with a prior."""
    return m.mixed_model(_possessions(spark, sf).withColumn("y", F.col("rate") * 10))


@query()
def style_clusters(spark, sf):
    """Groups of team seasons by scoring, allowed points and total."""
    t = games(spark, sf).filter("home_points IS NOT NULL AND total IS NOT NULL").groupBy(F.col("home_team").alias("team"), "season").agg(F.avg("home_points").alias("a"), F.avg("away_points").alias("b"), F.avg("total").alias("c"))
    return m.clusters(t, ["team", "season"], ["a", "b", "c"])


@query()
def style_axes(spark, sf):
    """Principal axes of the same features."""
    t = games(spark, sf).filter("home_points IS NOT NULL AND total IS NOT NULL").groupBy(F.col("home_team").alias("team"), "season").agg(F.avg("home_points").alias("a"), F.avg("away_points").alias("b"), F.avg("total").alias("c"))
    return m.loadings(t, ["a", "b", "c"])


@query()
def boosted_totals(spark, sf):
    """Walk-forward forecasts of the points by boosted trees."""
    g = games(spark, sf).select("game_id", "season", F.col("total").alias("t"), F.col("spread").alias("s"), F.col("week").cast("double").alias("w"), (F.col("home_points") + F.col("away_points")).cast("double").alias("y"))
    return m.boosted_walk(g, ["t", "s", "w"], "y", "season", ["game_id", "season"])

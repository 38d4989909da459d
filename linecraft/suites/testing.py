"""Queries of the statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.special import beta_inc_sql, chi2_tail, chi2_tail_sql
from ..functions.stats import NORM_CDF_SQL, clustered_mean, norm_cdf
from ..operators import grades, gram
from ..operators import testing as t
from ..operators.systems import SystemFilter, grade
from ..registry import query, rounded
from ..sources.proxy import ctes, games

GRADED = f"""{ctes()}, g AS (SELECT *, home_points - away_points + spread AS margin FROM games WHERE home_points IS NOT NULL AND away_points IS NOT NULL AND spread IS NOT NULL),
 graded AS (SELECT *, CASE WHEN margin > 0 THEN 'W' WHEN margin < 0 THEN 'L' ELSE 'P' END AS result, CASE WHEN margin > 0 THEN 90.9091 WHEN margin < 0 THEN -100.0 ELSE 0.0 END::DECIMAL(18,4) AS profit FROM g)"""
EVEN = "(110.0::DOUBLE / 210)"


def _bets(spark, sf):
    return grade(games(spark, sf), SystemFilter())


def _r(*names):
    return [rounded(c).alias(c) for c in names]


@query(f"""WITH {GRADED}, a AS (SELECT season, count(*) AS n, avg(profit::DOUBLE / 100) AS roi, sqrt(var_pop(profit::DOUBLE / 100) / count(*)) AS se FROM graded GROUP BY season) SELECT season, n, round(roi, 6) AS roi, round(se, 6) AS se, round(roi / se, 6) AS t FROM a""")
def roi_test(spark, sf):
    return t.roi_test(_bets(spark, sf), ["season"]).select("season", "n", *_r("roi", "se", "t"))


@query(f"""WITH {GRADED}, a AS (SELECT season, count(*) FILTER (result <> 'P') AS n FROM graded GROUP BY season) SELECT season, n, round((1.959963984540054 + 0.8416212335729143) * sqrt({EVEN} * (1 - {EVEN}) / n) * sqrt(1.5), 6) AS mde FROM a""")
def detectable_edge(spark, sf):
    a = _bets(spark, sf).groupBy("season").agg(F.count_if(F.col("result") != "P").alias("n"))
    return a.select("season", "n", rounded(t.detectable(F.col("n"), t.break_even(), F.lit(1.5))).alias("mde"))


@query(f"""WITH {GRADED}, a AS (SELECT home_team AS team, season, week // 9 AS part, count(*) FILTER (result = 'W') AS k, count(*) FILTER (result <> 'P') AS n FROM graded GROUP BY ALL HAVING n > 0),
 s AS (SELECT *, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({EVEN}) + (n - i) * ln(1 - {EVEN})))) AS p FROM a) SELECT team, season, part, k AS wins, n, round(p, 6) AS p FROM s""")
def exact_tail(spark, sf):
    """How likely break-even bets do at least as well: the exact binomial tail."""
    a = _bets(spark, sf).groupBy(F.col("home_team").alias("team"), "season", F.expr("week div 9").alias("part")).agg(F.count_if(F.col("result") == "W").alias("wins"), F.count_if(F.col("result") != "P").alias("n")).filter("n > 0")
    return a.select("team", "season", "part", "wins", "n", rounded(t.binomial_tail(F.col("wins"), F.col("n"), t.break_even())).alias("p"))


@query(f"""WITH {GRADED}, s AS (SELECT home_team, season, sum(profit) AS p FROM graded GROUP BY ALL) SELECT home_team, count(*) FILTER (p > 0) AS profitable, count(*) AS seasons,
 CASE WHEN count(*) FILTER (p > 0) / count(*)::DOUBLE >= 0.8 THEN 'A' WHEN count(*) FILTER (p > 0) / count(*)::DOUBLE >= 0.6 THEN 'B' WHEN count(*) FILTER (p > 0) / count(*)::DOUBLE >= 0.4 THEN 'C' WHEN count(*) FILTER (p > 0) / count(*)::DOUBLE >= 0.2 THEN 'D' ELSE 'F' END AS grade FROM s GROUP BY home_team""")
def sign_consistency(spark, sf):
    """Profitable seasons of each team's bets, and the grade of their share."""
    s = t.sign_consistency(_bets(spark, sf), ["home_team"], "season")
    return s.withColumn("grade", t.letter_grade(F.col("profitable") / F.col("seasons")))


@query(f"""WITH {GRADED}, d AS (SELECT *, row_number() OVER (PARTITION BY home_team ORDER BY kickoff, game_id) - row_number() OVER (PARTITION BY home_team, result ORDER BY kickoff, game_id) AS i FROM graded WHERE result <> 'P'),
 r AS (SELECT home_team, result, i, count(*) AS n FROM d GROUP BY ALL) SELECT home_team, coalesce(max(n) FILTER (result = 'W'), 0) AS longest_win, coalesce(max(n) FILTER (result = 'L'), 0) AS longest_loss FROM r GROUP BY home_team""")
def longest_runs(spark, sf):
    return t.longest_runs(_bets(spark, sf), ["home_team"], ["kickoff", "game_id"])


@query(f"""WITH {GRADED}, c AS (SELECT season, week, sum(margin) AS s, count(*) AS n FROM graded GROUP BY ALL), a AS (SELECT season, count(*) AS g, sum(n) AS n, sum(s) / sum(n) AS mean, sqrt(count(*) / (count(*) - 1.0::DOUBLE) * (sum(s * s) - 2 * sum(s) / sum(n) * sum(s * n) + pow(sum(s) / sum(n), 2) * sum(n * n))) / sum(n) AS se FROM c GROUP BY season HAVING count(*) > 1)
 SELECT season, round(mean - 1.959963984540054 * se, 6) AS low, round(mean + 1.959963984540054 * se, 6) AS high, round((1.959963984540054 + 0.8416212335729143) * se, 6) AS mde FROM a""")
def wald_interval(spark, sf):
    """Interval and detectable size of the mean margin, robust to weeks."""
    m = clustered_mean(_bets(spark, sf), "margin", ["week"], ["season"]).filter("clusters > 1")
    return m.select("season", rounded(F.col("mean") - t.Z_TEST * F.col("se")).alias("low"), rounded(F.col("mean") + t.Z_TEST * F.col("se")).alias("high"), rounded((t.Z_TEST + t.Z_POWER) * F.col("se")).alias("mde"))


_FORECASTS = f"{ctes()}, f AS (SELECT season, week, (home_points + away_points)::DOUBLE AS y, total AS a, 50.0::DOUBLE AS b FROM games WHERE home_points IS NOT NULL AND total IS NOT NULL)"


def _forecasts(spark, sf):
    return games(spark, sf).filter("home_points IS NOT NULL AND total IS NOT NULL").select("season", "week", (F.col("home_points") + F.col("away_points")).cast("double").alias("y"), F.col("total").alias("a"), F.lit(50.0).alias("b"))


@query(f"""WITH {_FORECASTS} SELECT season, count(*) AS n, round(avg((a - y) * (a - y) - (b - y) * (b - y)), 6) AS d_mse, round(avg(abs(a - y) - abs(b - y)), 6) AS d_mae, round(avg((abs(a - y) < abs(b - y))::INT), 6) AS nearer FROM f GROUP BY season""")
def paired_scores(spark, sf):
    return t.paired_scores(_forecasts(spark, sf), "y", "a", "b", ["season"]).select("season", "n", *_r("d_mse", "d_mae", "nearer"))


@query(f"""WITH {_FORECASTS}, d AS (SELECT season, week // 6 AS g0, (y - b) * (y - b) - ((y - a) * (y - a) - (b - a) * (b - a)) AS f FROM f), k AS (SELECT season, g0, sum(f) AS s, count(*)::DOUBLE AS n FROM d GROUP BY ALL),
 c AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY g0) - 1 AS g, count(*) OVER w AS gg, sum(n) OVER w AS nn, sum(s) OVER w / sum(n) OVER w AS mean FROM k WINDOW w AS (PARTITION BY season)), r AS (SELECT *, s - mean * n AS c FROM c),
 o AS (SELECT season, any_value(gg) AS gg, any_value(nn) AS nn, any_value(mean) AS mean, any_value(mean) / (sqrt(sum(c * c) * any_value(gg) / (any_value(gg) - 1.0::DOUBLE)) / any_value(nn)) AS t FROM r GROUP BY season),
 draws AS (SELECT season, unnest(range(0, (2 ** gg)::BIGINT)) AS draw FROM o), e AS (SELECT r.season, draw, c * (2 * ((draw >> g) & 1) - 1) AS x, n, nn, gg FROM r JOIN draws USING (season)),
 v AS (SELECT season, draw, sum(x) / any_value(nn) / (sqrt(any_value(gg) / (any_value(gg) - 1.0::DOUBLE)) * sqrt(greatest(sum(x * x) - 2 * sum(x) / any_value(nn) * sum(x * n) + pow(sum(x) / any_value(nn), 2) * sum(n * n), 0)) / any_value(nn)) AS ts FROM e GROUP BY ALL),
 p AS (SELECT season, avg((abs(ts) >= abs(t) - 1e-9)::INT) AS p FROM v JOIN o USING (season) GROUP BY season) SELECT season, nn::BIGINT AS n, gg AS clusters, round(mean, 6) AS mean, round(t, 6) AS t, round(CASE WHEN mean > 0 THEN p / 2 ELSE 1 - p / 2 END, 6) AS p FROM o JOIN p USING (season)""")
def clark_west(spark, sf):
    """Whether the market's total beats a fixed one that it nests: the p-value from all sign patterns of parts of the season."""
    rows = _forecasts(spark, sf).withColumn("part", F.expr("week div 6"))
    return t.clark_west(rows, "y", "b", "a", ["part"], ["season"]).select("season", "n", "clusters", *_r("mean", "t", "p"))


@query(f"""WITH {_FORECASTS}, m AS (SELECT season, count(*) AS n, avg(a) AS mx, avg(y) AS my, regr_slope(y, a) AS slope, regr_sxx(y, a) AS sxx FROM f GROUP BY season),
 c AS (SELECT f.season, f.week, sum((a - mx) * (y - my - slope * (a - mx))) AS s FROM f JOIN m USING (season) GROUP BY f.season, f.week), g AS (SELECT season, count(*) AS clusters, sum(s * s) AS meat FROM c GROUP BY season)
 SELECT season, n, clusters, round(slope, 6) AS slope, round(sqrt(clusters / (clusters - 1.0::DOUBLE) * (n - 1) / (n - 2) * meat) / sxx, 6) AS se FROM m JOIN g USING (season)""")
def cluster_ols(spark, sf):
    return t.cluster_ols(_forecasts(spark, sf), "a", "y", ["week"], ["season"]).select("season", "n", "clusters", *_r("slope", "se"))


_SSE = "(regr_syy(y, a) - pow(regr_sxy(y, a), 2) / nullif(regr_sxx(y, a), 0))"


@query(f"""WITH {_FORECASTS}, w AS (SELECT season, count(*) AS n, {_SSE} AS pooled FROM f GROUP BY season), p AS (SELECT season, week > 26 AS h, {_SSE} AS s FROM f GROUP BY ALL), q AS (SELECT season, sum(s) AS apart FROM p GROUP BY season HAVING count(*) = 2)
 SELECT season, n, round(((pooled - apart) / 2) / (apart / (n - 4)), 6) AS f, round(pow(1 + 2 * (((pooled - apart) / 2) / (apart / (n - 4))) / (n - 4), -(n - 4) / 2.0::DOUBLE), 6) AS p FROM w JOIN q USING (season)""")
def chow_test(spark, sf):
    """Whether one line fits both halves of a season, with the exact p-value."""
    return gram.chow(_forecasts(spark, sf), ["a"], "y", F.col("week") > 26, ["season"]).select("season", "n", *_r("f", "p"))


@query(f"""WITH {GRADED}, a AS (SELECT season, count(*) FILTER (result = 'W') AS k, count(*) FILTER (result <> 'P') AS n FROM graded GROUP BY season), l AS (SELECT *, 2 * (k * ln(k / n::DOUBLE / {EVEN}) + (n - k) * ln((1 - k / n::DOUBLE) / (1 - {EVEN}))) AS lr FROM a)
 SELECT season, n, round(lr, 6) AS lr, round(2 * (1 - {NORM_CDF_SQL.replace("{z}", "sqrt(greatest(lr, 0))")}), 6) AS p, round((k + 1) / (n + 2)::DOUBLE, 6) AS mean, round(sqrt((k + 1) * (n - k + 1) / (pow(n + 2, 2) * (n + 3))), 6) AS sd FROM l""")
def likelihood_ratio(spark, sf):
    """Hit rate against break-even by likelihood, and the posterior of the rate under a flat prior."""
    a = _bets(spark, sf).groupBy("season").agg(F.count_if(F.col("result") == "W").alias("k"), F.count_if(F.col("result") != "P").alias("n")).withColumn("lr", t.likelihood_ratio(F.col("k"), F.col("n"), t.break_even()))
    mean, sd = t.beta_posterior(F.col("k"), F.col("n"))
    return a.select("season", "n", rounded("lr").alias("lr"), rounded(t.chi2_tail_1(F.col("lr"))).alias("p"), rounded(mean).alias("mean"), rounded(sd).alias("sd"))


_HITS = f"{GRADED}, h AS (SELECT season, week, home_team, kickoff, game_id, margin, spread < 0 AS fav, result = 'W' AS hit FROM graded WHERE result <> 'P')"


def _hits(spark, sf):
    return _bets(spark, sf).filter("result <> 'P'").select("season", "week", "home_team", "kickoff", "game_id", "margin", (F.col("spread") < 0).alias("fav"), (F.col("result") == "W").alias("hit"))


@query(f"""WITH {_HITS}, c AS (SELECT season, week, count(*) FILTER (fav AND hit)::DOUBLE AS a, count(*) FILTER (fav AND NOT hit)::DOUBLE AS b, count(*) FILTER (NOT fav AND hit)::DOUBLE AS c, count(*) FILTER (NOT fav AND NOT hit)::DOUBLE AS d FROM h GROUP BY ALL), n AS (SELECT *, a + b + c + d AS n FROM c WHERE a + b + c + d > 1)
 SELECT season, round(pow(greatest(0, abs(sum(a - (a + b) * (a + c) / n)) - 0.5), 2) / sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))), 6) AS chi2, round(sum(a * d / n) / sum(b * c / n), 6) AS odds_ratio FROM n GROUP BY season""")
def mantel_haenszel(spark, sf):
    return t.mantel_haenszel(_hits(spark, sf), "fav", "hit", ["week"], ["season"]).select("season", *_r("chi2", "odds_ratio"))


@query(f"""WITH {_HITS}, gg AS (SELECT season, home_team, count(*) AS n, count(*) FILTER (hit) AS k FROM h GROUP BY ALL), p AS (SELECT season, sum(k) / sum(n) AS p FROM gg GROUP BY season), c AS (SELECT season, sum(pow(k - n * p, 2) / (n * p * (1 - p))) AS x, count(*) - 1 AS d FROM gg JOIN p USING (season) GROUP BY season) SELECT season, round(x, 6) AS chi2, d AS df, round({chi2_tail_sql("x", "d")}, 6) AS p FROM c""")
def heterogeneity(spark, sf):
    """Whether all teams cover alike, with the exact tail of chi-square."""
    out = t.heterogeneity(_hits(spark, sf), ["home_team"], "hit", ["season"])
    return out.select("season", rounded("chi2").alias("chi2"), "df", rounded(chi2_tail(F.col("chi2"), F.col("df"))).alias("p"))


@query(f"""WITH {_HITS}, r AS (SELECT home_team, hit, (hit IS DISTINCT FROM lag(hit) OVER (PARTITION BY home_team ORDER BY kickoff, game_id))::INT AS new FROM h), s AS (SELECT home_team, sum(new) AS runs, count(*) FILTER (hit)::DOUBLE AS a, count(*) FILTER (NOT hit)::DOUBLE AS b FROM r GROUP BY home_team)
 SELECT home_team, runs::BIGINT AS runs, round((runs - 2 * a * b / (a + b) - 1) / sqrt(2 * a * b * (2 * a * b - a - b) / ((a + b) * (a + b) * (a + b - 1))), 6) AS z FROM s""")
def runs_test(spark, sf):
    return t.runs_test(_hits(spark, sf), "hit", ["home_team"], ["kickoff", "game_id"]).select("home_team", "runs", rounded("z").alias("z"))


@query(f"""WITH {_HITS}, a AS (SELECT season, count(*) FILTER (fav) AS n1, count(*) FILTER (NOT fav) AS n0, count(*) FILTER (fav AND hit) AS k1, count(*) FILTER (NOT fav AND hit) AS k0 FROM h GROUP BY season), p AS (SELECT *, (k1 + k0) / (n1 + n0)::DOUBLE AS p FROM a)
 SELECT season, n1, n0, round((k1 / n1::DOUBLE - k0 / n0::DOUBLE) / sqrt(p * (1 - p) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0)), 6) AS z FROM p""")
def two_proportions(spark, sf):
    return t.two_proportions(_hits(spark, sf), "fav", "hit", ["season"]).select("season", "n1", "n0", rounded("z").alias("z"))


@query(f"""WITH {_HITS}, a AS (SELECT season, avg(margin) FILTER (fav) AS m1, var_samp(margin) FILTER (fav) / count(*) FILTER (fav) AS e1, count(*) FILTER (fav) AS n1, avg(margin) FILTER (NOT fav) AS m0, var_samp(margin) FILTER (NOT fav) / count(*) FILTER (NOT fav) AS e0, count(*) FILTER (NOT fav) AS n0 FROM h GROUP BY season)
 SELECT season, round((m1 - m0) / sqrt(e1 + e0), 6) AS t, round(pow(e1 + e0, 2) / (e1 * e1 / (n1 - 1) + e0 * e0 / (n0 - 1)), 4) AS df FROM a""")
def welch_test(spark, sf):
    return t.welch(_hits(spark, sf), "margin", "fav", ["season"]).select("season", rounded("t").alias("t"), rounded("df", 4).alias("df"))


_PROB = f"{GRADED}, q AS (SELECT season, {NORM_CDF_SQL.replace('{z}', '(-spread / 13.5)')} AS p, spread, home_points > away_points AS hit FROM graded)"


def _probabilities(spark, sf):
    return _bets(spark, sf).select("season", norm_cdf(-F.col("spread") / 13.5).alias("p"), "spread", (F.col("home_points") > F.col("away_points")).alias("hit"))


@query(f"""WITH {_PROB}, r AS (SELECT season, hit, rank() OVER (PARTITION BY season ORDER BY -spread) + (count(*) OVER (PARTITION BY season, spread) - 1) / 2.0::DOUBLE AS r FROM q)
 SELECT season, round((sum(r) FILTER (hit) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2.0::DOUBLE) / (count(*) FILTER (hit) * count(*) FILTER (NOT hit))::DOUBLE, 6) AS auc FROM r GROUP BY season""")
def area_under_curve(spark, sf):
    return t.area_under_curve(_probabilities(spark, sf).withColumn("s", -F.col("spread")), "s", "hit", ["season"]).select("season", rounded("auc").alias("auc"))


@query(f"""WITH {_PROB} SELECT season, least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS said, round(avg(hit::INT), 6) AS came FROM q GROUP BY ALL""")
def calibration(spark, sf):
    return t.calibration(_probabilities(spark, sf), "p", "hit", 10, ["season"]).select("season", "bin", "n", *_r("said", "came"))


@query(f"""WITH {ctes()}, v AS (SELECT home_team AS team, season, avg(home_points) AS x FROM games WHERE home_points IS NOT NULL GROUP BY ALL), b AS (SELECT n.team, n.season, n.x, w.x AS w FROM v n JOIN v w ON n.team = w.team AND n.season = w.season + 1),
 r AS (SELECT season, rank() OVER (PARTITION BY season ORDER BY x) + (count(*) OVER (PARTITION BY season, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY season ORDER BY w) + (count(*) OVER (PARTITION BY season, w) - 1) / 2.0::DOUBLE AS rw FROM b) SELECT season, count(*) AS n, round(corr(rx, rw), 6) AS rho FROM r GROUP BY season""")
def rank_stability(spark, sf):
    v = games(spark, sf).filter("home_points IS NOT NULL").groupBy(F.col("home_team").alias("team"), "season").agg(F.avg("home_points").alias("x"))
    return t.rank_stability(v, "team", "season", "x").select("season", "n", rounded("rho").alias("rho"))


@query()
def bootstrap_interval(spark, sf):
    """Interval of the return with weeks redrawn."""
    return t.cluster_bootstrap(_bets(spark, sf), "profit", F.lit(100), ["week"], ["season"])


@query(f"""WITH {ctes()}, f AS (SELECT season, home_team AS h, away_team AS v, (home_points + away_points)::DOUBLE AS y, total AS x FROM games WHERE home_points IS NOT NULL AND total IS NOT NULL), m AS (SELECT season, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx FROM f GROUP BY season),
 s AS (SELECT f.season, h, v, (x - mx) * (y - my - slope * (x - mx)) AS s FROM f JOIN m USING (season)), a AS (SELECT season, sum(t * t) AS q FROM (SELECT season, sum(s) AS t FROM s GROUP BY season, h) GROUP BY season), b AS (SELECT season, sum(t * t) AS q FROM (SELECT season, sum(s) AS t FROM s GROUP BY season, v) GROUP BY season), c AS (SELECT season, sum(t * t) AS q FROM (SELECT season, sum(s) AS t FROM s GROUP BY season, h, v) GROUP BY season)
 SELECT season, n, round(slope, 6) AS slope, round(sqrt(greatest(0, a.q + b.q - c.q)) / sxx, 6) AS se FROM m JOIN a USING (season) JOIN b USING (season) JOIN c USING (season)""")
def two_way_ols(spark, sf):
    """Slope with errors clustered by home and by away team."""
    f = games(spark, sf).filter("home_points IS NOT NULL AND total IS NOT NULL").select("season", "home_team", "away_team", (F.col("home_points") + F.col("away_points")).cast("double").alias("y"), F.col("total").alias("x"))
    return t.two_way_ols(f, "x", "y", ["home_team"], ["away_team"], ["season"]).select("season", "n", *_r("slope", "se"))


@query(f"""WITH {GRADED}, c AS (SELECT home_team % 8 AS team, season, sum(margin)::DOUBLE AS s, count(*)::DOUBLE AS n FROM graded GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY season) - 1 AS g, count(*) OVER (PARTITION BY team) AS gg, sum(n) OVER (PARTITION BY team) AS nn FROM c),
 d AS (SELECT team, unnest(range(0, (2 ** max(gg))::BIGINT)) AS draw FROM k GROUP BY team), e AS (SELECT k.team, draw, s, n, nn, s * (2 * ((draw >> g) & 1) - 1) AS r FROM k JOIN d USING (team)),
 v AS (SELECT team, draw, abs(sum(r) / any_value(nn) / (sqrt(greatest(1e-12, sum(r * r) - 2 * sum(r) / any_value(nn) * sum(r * n) + pow(sum(r) / any_value(nn), 2) * sum(n * n))) / any_value(nn))) AS t FROM e GROUP BY ALL), o AS (SELECT v.team, t AS own FROM v WHERE draw = 0)
 SELECT v.team, (SELECT count(*) FROM k WHERE k.team = v.team) AS clusters, round(any_value(own), 6) AS t, round(avg((v.t >= own - 1e-9)::INT), 6) AS p FROM v JOIN o USING (team) GROUP BY v.team""")
def wild_bootstrap(spark, sf):
    """Whether a group's mean margin is zero, with all sign patterns of its seasons."""
    b = _bets(spark, sf).withColumn("team", F.col("home_team") % 8)
    return t.wild_bootstrap(b, "margin", ["season"], ["team"]).select("team", "clusters", *_r("t", "p"))


@query()
def probit_fit(spark, sf):
    """Win probability by the spread, fitted."""
    g = _bets(spark, sf).select("spread", (F.col("home_points") > F.col("away_points")).alias("hit"))
    return spark.createDataFrame(list(t.probit(g, ["spread"], "hit").items()), "name string, value double")


@query()
def tobit_fit(spark, sf):
    """Home points by the spread, as if points below zero were cut off at zero."""
    return spark.createDataFrame(list(t.tobit(_bets(spark, sf), "spread", "home_points").items()), "name string, value double")


def _steps(x: str, steps, op: str) -> str:
    order = steps if op in ("<", "<=") else tuple(reversed(steps))
    return "CASE " + " ".join(f"WHEN {x} {op} {b} THEN {v}::DOUBLE" for b, v in order) + " ELSE 0.0::DOUBLE END"


_WILSON = "round(greatest(0.0, (r + 1.96::DOUBLE * 1.96 / (2 * n) - 1.96 * sqrt((r * (1 - r) + 1.96::DOUBLE * 1.96 / (4 * n)) / n)) / (1 + 1.96::DOUBLE * 1.96 / n)), 4)"


@query(f"""WITH {GRADED}, s AS (SELECT home_team, season, count(*) FILTER (result = 'W') AS w, count(*) FILTER (result = 'L') AS l, sum(profit) AS p FROM graded GROUP BY ALL), gg AS (SELECT home_team, sum(w)::DOUBLE AS w, (sum(w) + sum(l))::DOUBLE AS n, count(*) FILTER (p > 0) / count(*)::DOUBLE AS good FROM s GROUP BY home_team),
 a AS (SELECT home_team, w, n, good, w / n AS r, {beta_inc_sql("w", "n - w + 1", EVEN)} AS tail FROM gg), c AS (SELECT *, {_WILSON} - {EVEN} AS margin, round((round(r, 4) - {EVEN}) / sqrt({EVEN} * (1 - {EVEN}) / n), 4) AS z FROM a),
 f AS (SELECT home_team, n::BIGINT AS decided, (CASE WHEN n < 30 THEN 0 ELSE {_steps("margin", grades.MARGIN, ">=")} END + {_steps("z", grades.Z, ">=")} + good + {_steps("tail", grades.TAIL, "<")} + 0.75) / 5 AS average FROM c)
 SELECT home_team, decided, round(average, 6) AS average, CASE {" ".join(f"WHEN average >= {b} THEN '{n}'" for b, n in grades.LETTERS)} END AS grade FROM f""")
def system_grades(spark, sf):
    """Letter grades of betting on each home team, as if five conditions had found it."""
    return grades.graded_systems(_bets(spark, sf), ["home_team"], filters=5).withColumn("average", rounded("average"))

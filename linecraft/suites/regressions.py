"""Queries of regressions with several columns and exact tails."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gram
from ..registry import query, rounded
from ..sources.proxy import ctes, games

_ROWS = f"{ctes()}, f AS (SELECT season, home_team, week, (home_points + away_points)::DOUBLE AS y, total AS a, spread AS s, week::DOUBLE AS w FROM games WHERE home_points IS NOT NULL AND total IS NOT NULL AND spread IS NOT NULL)"
#: P(F > f) with two numerator degrees of freedom is a power.
_P2 = "pow(1 + 2 * {f} / ({d}), -({d}) / 2.0::DOUBLE)"


def _rows(spark, sf):
    g = games(spark, sf).filter("home_points IS NOT NULL AND total IS NOT NULL AND spread IS NOT NULL")
    return g.select("season", "home_team", (F.col("home_points") + F.col("away_points")).cast("double").alias("y"), F.col("total").alias("line"), "spread", F.col("week").cast("double").alias("week"))


@query(f"""WITH {_ROWS}, m AS (SELECT season, count(*) AS n, sum(a) AS sa, sum(a * a) AS saa, regr_sxx(y, a) AS sxx, regr_syy(y, a) AS syy, regr_sxy(y, a) AS sxy, avg(y) AS my, avg(a) AS ma FROM f GROUP BY season),
 b AS (SELECT *, sxy / sxx AS beta, my - sxy / sxx * ma AS alpha, syy - sxy * sxy / sxx AS rss FROM m),
 t AS (SELECT *, rss / (n - 2) AS v, (n * alpha * alpha + 2 * alpha * (beta - 1) * sa + (beta - 1) * (beta - 1) * saa) / 2 / (rss / (n - 2)) AS fv FROM b WHERE n > 2)
 SELECT season, n, round(alpha, 5) AS alpha, round(beta, 6) AS beta, round(sqrt(v * saa / n / sxx), 6) AS se_alpha, round(sqrt(v / sxx), 6) AS se_beta, round(1 - rss / syy, 6) AS r2, round(sqrt(v), 5) AS sigma, round(fv, 5) AS f, round({_P2.format(f="fv", d="(n - 2)")}, 6) AS p FROM t""")
def line_efficiency(spark, sf):
    """Points on the market's total: joint test that the intercept is 0 and the slope 1."""
    out = gram.regress(_rows(spark, sf), "y", ["line"], ["season"], {"fair": [({"intercept": 1}, 0), ({"line": 1}, 1)]}).filter("n > 2")
    named = {"alpha": ("coef_intercept", 5), "beta": ("coef_line", 6), "se_alpha": ("se_intercept", 6), "se_beta": ("se_line", 6), "r2": ("r2", 6), "sigma": ("sigma", 5), "f": ("f_fair", 5), "p": ("p_fair", 6)}
    return out.select("season", "n", *(rounded(c, d).alias(k) for k, (c, d) in named.items()))


@query(f"""WITH {_ROWS}, m AS (SELECT season, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(s) AS ms, avg(w) AS mw, covar_pop(y, a) / var_pop(a) AS ky, covar_pop(s, a) / var_pop(a) AS ks, covar_pop(w, a) / var_pop(a) AS kw FROM f GROUP BY season HAVING count(*) > 4),
 r AS (SELECT season, home_team, y - my - ky * (a - ma) AS ry, s - ms - ks * (a - ma) AS rs, w - mw - kw * (a - ma) AS rw FROM f JOIN m USING (season)),
 g AS (SELECT season, sum(rs * rs) AS ss, sum(rw * rw) AS ww, sum(rs * rw) AS sw, sum(rs * ry) AS sy, sum(rw * ry) AS wy, sum(ry * ry) AS yy FROM r GROUP BY season),
 b AS (SELECT *, (ww * sy - sw * wy) / (ss * ww - sw * sw) AS bs, (ss * wy - sw * sy) / (ss * ww - sw * sw) AS bw FROM g),
 e AS (SELECT season, home_team, sum(rs * (ry - bs * rs - bw * rw)) AS us, sum(rw * (ry - bs * rs - bw * rw)) AS uw FROM r JOIN b USING (season) GROUP BY ALL),
 k AS (SELECT season, count(*) AS clusters, sum(us * us) AS m11, sum(us * uw) AS m12, sum(uw * uw) AS m22 FROM e GROUP BY season),
 t AS (SELECT *, yy - bs * sy - bw * wy AS rss, clusters / (clusters - 1.0::DOUBLE) * (n - 1) / (n - 4) AS c, ss * ww - sw * sw AS det FROM b JOIN k USING (season) JOIN m USING (season)),
 u AS (SELECT *, (yy - rss) / 2 / (rss / (n - 4)) AS fv, (sy * sy * m22 - 2 * sy * wy * m12 + wy * wy * m11) / (m11 * m22 - m12 * m12) / c / 2 AS fc FROM t)
 SELECT season, n, clusters, round(bs, 6) AS b_spread, round(bw, 6) AS b_week, round(sqrt(rss / (n - 4) * ww / det), 6) AS se_spread, round(sqrt(c * (ww * ww * m11 - 2 * ww * sw * m12 + sw * sw * m22)) / det, 6) AS cluster_se_spread,
 round(fv, 5) AS f, round({_P2.format(f="fv", d="(n - 4)")}, 6) AS p, round(fc, 5) AS cluster_f, round({_P2.format(f="fc", d="(clusters - 1)")}, 6) AS cluster_p FROM u""")
def market_test(spark, sf):
    """Whether spread and week say anything about the points that the market's total does not: plain and clustered by team."""
    out = gram.regress(_rows(spark, sf), "y", ["line", "spread", "week"], ["season"], {"others": [({"spread": 1}, 0), ({"week": 1}, 0)]}, ["home_team"]).filter("n > 4")
    named = {"b_spread": ("coef_spread", 6), "b_week": ("coef_week", 6), "se_spread": ("se_spread", 6), "cluster_se_spread": ("cluster_se_spread", 6), "f": ("f_others", 5), "p": ("p_others", 6), "cluster_f": ("cluster_f_others", 5), "cluster_p": ("cluster_p_others", 6)}
    return out.select("season", "n", "clusters", *(rounded(c, d).alias(k) for k, (c, d) in named.items()))


_RSS = "(cyy - (cay * (css * cay - cas * csy) + csy * (caa * csy - cas * cay)) / (caa * css - cas * cas))"


@query(f"""WITH {_ROWS}, h AS (SELECT season, week > 26 AS late, count(*) AS n, regr_sxx(y, a) AS caa, regr_sxx(y, s) AS css, regr_sxy(a, s) AS cas, regr_sxy(y, a) AS cay, regr_sxy(y, s) AS csy, regr_syy(y, a) AS cyy FROM f GROUP BY ALL),
 apart AS (SELECT season, sum(n) AS n, sum({_RSS}) AS rss FROM h GROUP BY season HAVING count(*) = 2), pool AS (SELECT season, sum(caa) AS caa, sum(css) AS css, sum(cas) AS cas, sum(cay) AS cay, sum(csy) AS csy, sum(cyy) AS cyy FROM h GROUP BY season),
 t AS (SELECT season, n, ({_RSS} - rss) / 2 / (rss / (n - 6)) AS fv FROM pool JOIN apart USING (season) WHERE n > 6) SELECT season, n::BIGINT AS n, round(fv, 5) AS f, round({_P2.format(f="fv", d="(n - 6)")}, 6) AS p FROM t""")
def interaction_test(spark, sf):
    """Whether line and spread weigh otherwise late in the season: joint F of the products with the flag."""
    rows = _rows(spark, sf).withColumn("late", (F.col("week") > 26).cast("double")).withColumns({"late_line": F.col("late") * F.col("line"), "late_spread": F.col("late") * F.col("spread")})
    out = gram.regress(rows, "y", ["line", "spread", "late", "late_line", "late_spread"], ["season"], {"both": [({"late_line": 1}, 0), ({"late_spread": 1}, 0)]}).filter("f_both IS NOT NULL")
    return out.select("season", "n", rounded("f_both", 5).alias("f"), rounded("p_both").alias("p"))

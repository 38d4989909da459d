"""Queries of both sides' scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import NORM_CDF_SQL
from ..operators import joint
from ..registry import query, rounded
from ..sources.proxy import ctes, games

#: Regulation points are the games' points; a tied game adds some overtime points.
_SCORES = f"{ctes()}, f AS (SELECT game_id, season, CASE WHEN week <= 10 THEN 'early' ELSE 'primary' END AS segment, home_points AS h, away_points AS a, CASE WHEN home_points = away_points THEN 3 + game_id % 12 END AS ot, (total - spread) / 2 AS mh, (total + spread) / 2 AS ma FROM games)"
TOP = 150


def scores(spark, sf):
    return games(spark, sf).selectExpr(
        "game_id", "season", "CASE WHEN week <= 10 THEN 'early' ELSE 'primary' END AS segment", "home_points AS h", "away_points AS a", "CASE WHEN home_points = away_points THEN 3 + game_id % 12 END AS ot", "(total - spread) / 2 AS mh", "(total + spread) / 2 AS ma"
    )


@query(f"""WITH {_SCORES}, done AS (SELECT * FROM f WHERE h IS NOT NULL AND a IS NOT NULL AND mh IS NOT NULL AND ma IS NOT NULL), ds AS (SELECT DISTINCT season FROM done), os AS (SELECT DISTINCT season FROM f WHERE ot IS NOT NULL),
 win AS (SELECT t.season AS test, d.season FROM (SELECT DISTINCT season FROM f) t JOIN ds d ON d.season < t.season QUALIFY row_number() OVER (PARTITION BY t.season ORDER BY d.season DESC) <= 3),
 owin AS (SELECT t.season AS test, d.season FROM (SELECT DISTINCT season FROM f) t JOIN os d ON d.season < t.season QUALIFY row_number() OVER (PARTITION BY t.season ORDER BY d.season DESC) <= 3),
 pool AS (SELECT test, segment, h - mh AS eh, a - ma AS ea, count(*) AS c FROM win JOIN done USING (season) GROUP BY ALL), size AS (SELECT test, segment, sum(c) AS m FROM pool GROUP BY ALL),
 otp AS (SELECT test, ot, count(*) AS c FROM owin JOIN f USING (season) WHERE ot IS NOT NULL GROUP BY ALL), ots AS (SELECT test, sum(c) AS m FROM otp GROUP BY test),
 cls AS (SELECT DISTINCT season, segment, mh, ma FROM f WHERE mh IS NOT NULL AND ma IS NOT NULL),
 o AS (SELECT k.season, k.segment, mh, ma, greatest(floor(mh + eh + 0.5), 0) AS h, greatest(floor(ma + ea + 0.5), 0) AS a, sum(c) / any_value(m)::DOUBLE AS w FROM cls k JOIN pool p ON p.test = k.season AND p.segment = k.segment JOIN size s ON s.test = k.season AND s.segment = k.segment GROUP BY ALL),
 d AS (SELECT season, segment, mh, ma, least(h + a, {TOP}) AS k, sum(w) AS w FROM o WHERE h <> a GROUP BY ALL),
 t AS (SELECT o.season, segment, mh, ma, least(h + a + coalesce(ot, 0), {TOP}) AS k, sum(w * coalesce(c / m::DOUBLE, 1)) AS w FROM o LEFT JOIN otp ON otp.test = o.season LEFT JOIN ots ON ots.test = o.season WHERE h = a GROUP BY ALL),
 p AS (SELECT season, segment, mh, ma, k, sum(w) AS p FROM (SELECT * FROM d UNION ALL SELECT * FROM t) GROUP BY ALL), side AS (SELECT season, segment, mh, ma, coalesce(sum(w) FILTER (h > a), 0) + coalesce(sum(w) FILTER (h = a), 0) / 2 AS hw, coalesce(sum(w) FILTER (h = a), 0) AS pt FROM o GROUP BY ALL),
 grid AS (SELECT season, segment, mh, ma, hw, pt, unnest(range(0, {TOP + 1})) AS k FROM side), c AS (SELECT g.*, coalesce(p, 0) AS p, sum(coalesce(p, 0)) OVER (PARTITION BY season, segment, mh, ma ORDER BY k) AS cdf FROM grid g LEFT JOIN p USING (season, segment, mh, ma, k)),
 y AS (SELECT season, segment, mh, ma, least(h + a + coalesce(ot, 0), {TOP}) AS y FROM f WHERE h IS NOT NULL AND mh IS NOT NULL AND ma IS NOT NULL),
 s AS (SELECT c.season, y, any_value(hw) AS hw, any_value(pt) AS pt, sum(k * p) AS mean, sum(pow(cdf - (k >= y)::INT, 2)) AS crps, coalesce(max(cdf) FILTER (k = y - 1), 0) + coalesce(max(p) FILTER (k = y), 0) / 2 AS pit, count(*) / {TOP + 1} AS n FROM c JOIN y USING (season, segment, mh, ma) GROUP BY c.season, segment, mh, ma, y)
 SELECT season, sum(n)::BIGINT AS n, round(sum(crps) / sum(n), 6) AS crps, round(sum(pit * n) / sum(n), 6) AS pit, round(sum(mean) / sum(n), 5) AS mean, round(sum(hw * n) / sum(n), 6) AS home_win, round(sum(pt * n) / sum(n), 6) AS p_tie FROM s GROUP BY season""")
def joint_totals(spark, sf):
    """Scores of the totals' distributions, overtime included, by season."""
    g = scores(spark, sf)
    pmf, sides = joint.joint_totals(g, "season", "segment", "h", "a", "ot", "mh", "ma", 3, TOP)
    on_grid = {m: joint.near(F.col(m) * joint.GRID).cast("int") for m in ("mh", "ma")}
    y = F.least(F.col("h") + F.col("a") + F.coalesce("ot", F.lit(0)), F.lit(TOP)).cast("int")
    done = g.filter("h IS NOT NULL").withColumns({**on_grid, "k": y}).groupBy("season", "segment", "mh", "ma", "k").agg(F.count(F.lit(1)).alias("n"))
    out = done.join(pmf, ["season", "segment", "mh", "ma", "k"]).join(sides, ["season", "segment", "mh", "ma"])
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return out.groupBy("season").agg(F.sum("n").alias("n"), *(rounded(mean(c), 5 if c == "mean" else 6).alias(c) for c in ("crps", "pit", "mean", "home_win", "p_tie")))


_SD_A, _SD_B, _RHO = 12.0, 11.0, -0.2
_STEPS = 400


def _simpson(lo: str, hi: str) -> str:
    z = f"({lo} + ({hi} - {lo}) * i / {_STEPS}.0::DOUBLE)"
    need = f"(total - greatest(ma + {_SD_A}::DOUBLE * {z}, 0))"
    value = f"exp(-{z} * {z} / 2) * 0.3989422804014327 * {NORM_CDF_SQL.replace('{z}', f'((mb + {_RHO * _SD_B}::DOUBLE * {z} - {need}) / {_SD_B * (1 - _RHO**2) ** 0.5}::DOUBLE)')}"
    return f"list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: CASE WHEN i IN (0, {_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {value})) * ({hi} - {lo}) / {3 * _STEPS}.0::DOUBLE"


@query(f"""WITH {ctes()}, f AS (SELECT DISTINCT (total - spread) / 2 - 18 AS ma, (total + spread) / 2 - 18 AS mb, total - 36 AS total FROM games WHERE total IS NOT NULL AND spread IS NOT NULL AND total >= 36),
 z AS (SELECT *, greatest(least(-ma / {_SD_A}::DOUBLE, 9.0::DOUBLE), -9.0::DOUBLE) AS z0, greatest(least((total - ma) / {_SD_A}::DOUBLE, 9.0::DOUBLE), -9.0::DOUBLE) AS z1 FROM f)
 SELECT ma AS mean_a, mb AS mean_b, round({_simpson('-9.0::DOUBLE', 'z0')} + {_simpson('z0', 'z1')} + {NORM_CDF_SQL.replace('{z}', '(-z1)')}, 5) AS p_over FROM z""")
def correlated_over(spark, sf):
    """P(over) of low totals when both sides' scores are correlated and cannot fall below zero."""
    g = games(spark, sf).filter("total IS NOT NULL AND spread IS NOT NULL AND total >= 36")
    f = g.selectExpr("(total - spread) / 2 - 18 AS mean_a", "(total + spread) / 2 - 18 AS mean_b", "total - 36 AS line").distinct()
    p = joint.correlated_over(F.col("mean_a"), F.col("mean_b"), F.lit(_SD_A), F.lit(_SD_B), F.lit(_RHO), F.col("line"))
    return f.select("mean_a", "mean_b", rounded(p, 5).alias("p_over"))


@query()
def over_model(spark, sf):
    """Censored fits of both sides by season, the correlation of their errors, and the mean P(over) that follows."""
    f = scores(spark, sf).filter("h IS NOT NULL AND mh IS NOT NULL AND ma IS NOT NULL").select("season", "h", "a", "mh", "ma")
    fits = [joint.censored_fit(f, x, y, ["season"]).selectExpr("season", *(f"{c} AS {c}_{y}" for c in ("alpha", "beta", "sigma", "se_alpha", "se_beta", "se_sigma", "n_censored"))) for x, y in (("mh", "h"), ("ma", "a"))]
    both = f.join(fits[0], "season").join(fits[1], "season")
    mean = {y: F.col(f"alpha_{y}") + F.col(f"beta_{y}") * F.col(x) for x, y in (("mh", "h"), ("ma", "a"))}
    rho = joint.error_correlation(both, "h", mean["h"], "a", mean["a"], ["season"]).select("season", "rho")
    p = joint.correlated_over(mean["h"], mean["a"], F.col("sigma_h"), F.col("sigma_a"), F.col("rho"), F.col("mh") + F.col("ma"))
    # one quadrature for equal forecasts of a season
    alike = f.groupBy("season", "mh", "ma").agg(F.count(F.lit(1)).alias("n")).join(fits[0], "season").join(fits[1], "season").join(rho, "season").repartition(64, "season", "mh", "ma")
    sums = alike.select("season", "rho", F.col("n").alias("w"), p.alias("p")).groupBy("season").agg(F.sum("w").alias("n"), F.first("rho").alias("rho"), (F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("p_over"))
    return sums.join(fits[0], "season").join(fits[1], "season")

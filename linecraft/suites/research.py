"""Queries of searches, ensembles and sealed folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search_null as sn
from ..operators import walkforward as wf
from ..registry import query, rounded
from ..sources.proxy import ctes, games, line_tape

_PICKS = f"""{ctes()}, picks AS (SELECT season, CASE WHEN season <= 1994 THEN 'early' WHEN season <= 1996 THEN 'middle' ELSE 'late' END AS era, CASE WHEN spread < 0 THEN 'favourite' ELSE 'underdog' END AS side,
 CASE WHEN total < 45 THEN '<45' WHEN total < 50 THEN '45' WHEN total < 55 THEN '50' ELSE '55+' END AS band, 'Q' || (1 + least(4, abs(spread)::BIGINT // 3)) AS q, CASE WHEN home_points - away_points + spread = 0 THEN NULL ELSE home_points - away_points + spread > 0 END AS win
 FROM games WHERE home_points IS NOT NULL AND spread IS NOT NULL AND total IS NOT NULL)"""
CELL, LEAST = ["side", "band", "q"], 15


def _picks(spark, sf):
    g = games(spark, sf).filter("home_points IS NOT NULL AND spread IS NOT NULL AND total IS NOT NULL")
    return g.selectExpr(
        "season", "CASE WHEN season <= 1994 THEN 'early' WHEN season <= 1996 THEN 'middle' ELSE 'late' END AS era", "CASE WHEN spread < 0 THEN 'favourite' ELSE 'underdog' END AS side",
        "CASE WHEN total < 45 THEN '<45' WHEN total < 50 THEN '45' WHEN total < 55 THEN '50' ELSE '55+' END AS band", "concat('Q', 1 + least(4, CAST(round(abs(spread)) AS BIGINT) div 3)) AS q",
        "CASE WHEN home_points - away_points + spread = 0 THEN NULL ELSE home_points - away_points + spread > 0 END AS win",
    )


@query(f"WITH {_PICKS.replace('abs(spread)::BIGINT', 'round(abs(spread))::BIGINT')}, c AS (SELECT side, band, q, count(*) AS n, count(*) FILTER (win) AS wins FROM picks WHERE win IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}) SELECT side, band, q, n, wins, round(wins / n::DOUBLE, 6) AS rate FROM c ORDER BY wins / n::DOUBLE DESC, n DESC, side, band, q LIMIT 1")
def best_cell(spark, sf):
    """The best cell of a grid of rules."""
    return sn.best_cell(_picks(spark, sf), CELL, "win", LEAST).select(*CELL, "n", "wins", rounded("rate").alias("rate"))


@query()
def best_cell_permutation(spark, sf):
    """The best cell against the best cells of shuffles within era."""
    return sn.permutation_test(_picks(spark, sf), CELL, "win", ["era"], LEAST, 1000)


@query(f"""WITH {_PICKS.replace('abs(spread)::BIGINT', 'round(abs(spread))::BIGINT')}, t AS (SELECT side, band, q, count(*) AS n, count(*) FILTER (win) AS wins FROM picks WHERE win IS NOT NULL AND season <= 1996 GROUP BY ALL HAVING count(*) >= {LEAST}), b AS (SELECT * FROM t ORDER BY wins / n::DOUBLE DESC, n DESC, side, band, q LIMIT 1),
 h AS (SELECT side, band, q, count(*) AS n, count(*) FILTER (win) AS wins FROM picks WHERE win IS NOT NULL AND season > 1996 GROUP BY ALL) SELECT side, band, q, b.n AS train_n, b.wins AS train_wins, coalesce(h.n, 0) AS test_n, coalesce(h.wins, 0) AS test_wins FROM b LEFT JOIN h USING (side, band, q)""")
def cell_walk_forward(spark, sf):
    """The rule chosen on the earlier seasons, graded on the later ones."""
    return sn.chosen_then_graded(_picks(spark, sf), CELL, "win", F.col("season") <= 1996, LEAST)


#: Projection systems of the proxy: groups of providers, so that some have most games and others two thirds.
SYSTEMS = {"m1": (4, 0), "m2": (4, 1), "m3": (4, 2), "m4": (4, 3), "m5": (2, 0), "m6": (2, 1)}
MODELS = list(SYSTEMS)
_FORECASTS = f"""{ctes()}, p AS (SELECT game_id, {", ".join(f"avg(-spread::DOUBLE) FILTER (provider % {n} = {i}) AS {m}" for m, (n, i) in SYSTEMS.items())} FROM line_tape GROUP BY game_id),
 f AS (SELECT g.game_id, season, (home_points - away_points)::DOUBLE AS y, -spread AS mkt, {", ".join(MODELS)} FROM games g LEFT JOIN p USING (game_id) WHERE home_points IS NOT NULL AND spread IS NOT NULL)"""


def forecasts(spark, sf):
    """Margins as the projection systems see them, where they have the game, beside the market's."""
    p = line_tape(spark, sf).groupBy("game_id").agg(*(F.avg(F.when(F.col("provider") % n == i, -F.col("spread").cast("double"))).alias(m) for m, (n, i) in SYSTEMS.items()))
    g = games(spark, sf).filter("home_points IS NOT NULL AND spread IS NOT NULL")
    return g.select("game_id", "season", (F.col("home_points") - F.col("away_points")).cast("double").alias("y"), (-F.col("spread")).alias("mkt")).join(p, "game_id", "left")


#: Limits that fit the number of games at the small scales.
_OPTIONS = {"screen": 2, "least_skill": 20, "least_fit": 50}


@query()
def ensemble_weights(spark, sf):
    """Screened models and fitted weights of each season."""
    return wf.ensemble_weights(forecasts(spark, sf), MODELS, "mkt", "y", **_OPTIONS)


_LONG = f"""long AS (SELECT game_id, season, y, mkt, unnest({MODELS}) AS model, unnest([{", ".join(MODELS)}]) AS x FROM f),
 cover AS (SELECT season, model, count(x) / count(*)::DOUBLE >= 0.5 AS active FROM long GROUP BY ALL), s AS (SELECT season, model, count(x) AS n, coalesce(sum((y - x) * (y - x) - (y - mkt) * (y - mkt)) FILTER (x IS NOT NULL), 0) AS gain FROM long GROUP BY ALL),
 skill AS (SELECT a.season, a.model, sum(b.gain) / sum(b.n) AS skill FROM s a JOIN s b ON a.model = b.model AND b.season < a.season GROUP BY ALL HAVING sum(b.n) >= 20),
 ranked AS (SELECT season, model, row_number() OVER (PARTITION BY season ORDER BY skill, model) AS r FROM skill), best AS (SELECT season, model FROM ranked JOIN cover USING (season, model) WHERE r <= 2 AND active),
 firsts AS (SELECT season, model, row_number() OVER (PARTITION BY season ORDER BY model) AS r FROM cover WHERE active), screened AS (SELECT * FROM best UNION ALL SELECT season, model FROM firsts WHERE r <= 2 AND season NOT IN (SELECT season FROM best)),
 cons AS (SELECT t.season AS target, l.game_id, any_value(l.season) AS season, any_value(y) AS y, any_value(mkt) AS mkt, avg(x) AS c FROM long l JOIN screened t USING (model) WHERE l.season <= t.season AND x IS NOT NULL GROUP BY t.season, l.game_id),
 tr AS (SELECT target, count(*) AS n, avg(y) AS my, avg(mkt) AS ma, avg(c - mkt) AS md, var_pop(mkt) AS aa, var_pop(c - mkt) AS dd, covar_pop(mkt, c - mkt) AS ad, covar_pop(mkt, y) AS ay, covar_pop(c - mkt, y) AS dy FROM cons WHERE season < target GROUP BY target HAVING count(*) > 50),
 w AS (SELECT *, (dd * ay - ad * dy) / (aa * dd - ad * ad) AS ba, (aa * dy - ad * ay) / (aa * dd - ad * ad) AS bd FROM tr),
 act AS (SELECT game_id, avg(x) AS e1, median(x) AS e2 FROM long JOIN cover USING (season, model) WHERE active AND x IS NOT NULL GROUP BY game_id), e3 AS (SELECT game_id, c AS e3 FROM cons WHERE season = target),
 e AS (SELECT f.season, y, e1, e2, e3, my - ba * ma - bd * md + ba * mkt + bd * coalesce(e3 - mkt, 0) AS e4, my - ay / aa * ma + ay / aa * mkt AS r0 FROM f LEFT JOIN act USING (game_id) LEFT JOIN e3 USING (game_id) LEFT JOIN w ON w.target = f.season)"""


@query(f"""WITH {_FORECASTS}, {_LONG} SELECT season, count(*) AS n, {", ".join(f"count({e}) AS n_{e}, round(sqrt(avg((y - {e}) * (y - {e}))), 5) AS rmse_{e}" for e in ("e1", "e2", "e3", "e4", "r0"))} FROM e GROUP BY season""")
def ensemble_scores(spark, sf):
    """Errors by season of ensembles whose models and weights come from the seasons before."""
    out = wf.ensembles(forecasts(spark, sf), MODELS, "mkt", "y", **_OPTIONS)
    aggs = [x for e in ("e1", "e2", "e3", "e4", "r0") for x in (F.count(e).alias(f"n_{e}"), rounded(F.sqrt(F.avg((F.col("y") - F.col(e)) * (F.col("y") - F.col(e)))), 5).alias(f"rmse_{e}"))]
    return out.groupBy("season").agg(F.count(F.lit(1)).alias("n"), *aggs)


@query()
def ridge_ensemble(spark, sf):
    """The ensemble that weighs all active systems by ridge, by season."""
    out = wf.ensembles(forecasts(spark, sf), MODELS, "mkt", "y", **_OPTIONS).filter("e5 IS NOT NULL")
    return out.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((F.col("y") - F.col("e5")) * (F.col("y") - F.col("e5")))).alias("rmse"))


_TOTALS = f"{ctes()}, f AS (SELECT game_id, (home_points + away_points)::DOUBLE AS y, total AS a, spread AS s FROM games WHERE home_points IS NOT NULL)"


def _totals(spark, sf):
    g = games(spark, sf).filter("home_points IS NOT NULL")
    return g.select("game_id", "season", (F.col("home_points") + F.col("away_points")).cast("double").alias("y"), F.col("total").alias("a"), F.col("spread").alias("s"), F.col("week").cast("double").alias("w"), F.abs("spread").alias("size"))


@query(f"""WITH {_TOTALS}, h AS (SELECT *, {wf.FOLD_SQL.format(key="game_id", seed=3, folds=4)} AS fold FROM f), k AS (SELECT unnest(range(4)) AS fold), med AS (SELECT k.fold, median(a) AS fa, median(s) AS fs FROM k JOIN h ON h.fold <> k.fold GROUP BY k.fold),
 tr AS (SELECT m.fold, y, coalesce(a, fa) AS a, coalesce(s, fs) AS s FROM med m JOIN h ON h.fold <> m.fold), m AS (SELECT fold, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(s) AS ms, stddev_pop(a) AS sa, stddev_pop(s) AS ss, corr(a, s) AS c, covar_pop(a, y) / stddev_pop(a) AS ya, covar_pop(s, y) / stddev_pop(s) AS ys FROM tr GROUP BY fold),
 b AS (SELECT *, ((1 + 0.5::DOUBLE) * ya - c * ys) / ((1 + 0.5::DOUBLE) * (1 + 0.5::DOUBLE) - c * c) AS ba, ((1 + 0.5::DOUBLE) * ys - c * ya) / ((1 + 0.5::DOUBLE) * (1 + 0.5::DOUBLE) - c * c) AS bs FROM m),
 e AS (SELECT h.fold, b.n AS n_train, my + ba * (coalesce(a, fa) - ma) / sa + bs * (coalesce(s, fs) - ms) / ss - y AS e FROM h JOIN b USING (fold) JOIN med USING (fold))
 SELECT fold, any_value(n_train) AS n_train, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias FROM e GROUP BY fold""")
def ridge_folds(spark, sf):
    """Scores of a ridge of two columns on folds it did not see, medians for missing values."""
    out = wf.net_bakeoff(_totals(spark, sf), "game_id", "y", {"both": (["a", "s"], 0.5, 0.0)}, 4, 3)
    return out.select("fold", "n_train", "n", *(rounded(c).alias(c) for c in ("mae", "rmse", "bias")))


@query()
def net_bakeoff(spark, sf):
    """Several column sets and penalties on the same folds."""
    every = ["a", "s", "w", "size"]
    return wf.net_bakeoff(_totals(spark, sf), "game_id", "y", {"line": (["a"], 0.0, 0.0), "ridge": (every, 1.0, 0.0), "net": (every, 0.3, 0.5), "lasso": (every, 0.5, 1.0)})


@query()
def probit_bakeoff(spark, sf):
    """Bets of several probit models on the folds they were not fitted on."""
    rows = _totals(spark, sf).withColumn("over", F.when(F.col("y") != F.col("a"), F.col("y") > F.col("a")))
    return wf.probit_bakeoff(rows, "game_id", "over", {"line": ["a"], "spread": ["s"], "all": ["a", "s", "w", "size"]})

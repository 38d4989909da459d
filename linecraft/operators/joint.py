"""Both sides' scores at once: totals with overtime from paired residuals, and censored pairs with correlation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import norm_cdf

#: Forecasts are rounded to this share of a point, so that equal fractions share one lattice of outcomes.
GRID = 4


def near(x: Column) -> Column:
    """The nearest integer, halves up: unlike rounding to even, the same for a value and the value plus one."""
    return F.floor(x + 0.5)


def residual_pools(games: DataFrame, season: str, segment: str, home: str, away: str, mu_home: str, mu_away: str, window: int, grid: int = GRID) -> DataFrame:
    """season, segment, eh, ea, n: how often each pair of residuals (in 1/grid points) occurs in the ``window`` seasons before.

    Seasons are those that have finished games; counts are taken by season first, so a game counts once a pass.
    """
    on_grid = lambda s, m: (F.col(s) * grid - near(F.col(m) * grid)).cast("int")
    done = games.dropna(subset=[home, away, mu_home, mu_away])
    per = done.groupBy(season, segment, on_grid(home, mu_home).alias("eh"), on_grid(away, mu_away).alias("ea")).agg(F.count(F.lit(1)).alias("n"))
    return windowed(per, games, season, window, [segment, "eh", "ea"])


def windowed(counts: DataFrame, games: DataFrame, season: str, window: int, keys: list[str]) -> DataFrame:
    """Sums of ``n`` over the ``window`` most recent seasons with counts before each season of ``games``."""
    had = F.array_sort(F.collect_set(season))
    known = counts.agg(had.alias("__had"))
    tests = games.select(F.col(season).alias("__test")).distinct().crossJoin(F.broadcast(known))  # one row of seasons
    before = F.filter("__had", lambda s: s < F.col("__test"))
    tests = tests.select("__test", F.explode(F.slice(before, F.greatest(F.size(before) - window + 1, F.lit(1)), window)).alias("__s"))
    return counts.join(F.broadcast(tests), F.col(season) == F.col("__s")).groupBy(F.col("__test").alias(season), *keys).agg(F.sum("n").alias("n"))


def joint_outcomes(games: DataFrame, season: str, segment: str, home: str, away: str, mu_home: str, mu_away: str, window: int = 3, grid: int = GRID) -> DataFrame:
    """season, segment, mh, ma (forecasts in 1/grid points), h, a, p: the joint distribution of regulation points; sums of p of equal (h, a) count.

    Every pair of residuals of the window's games of the same segment is added to both forecasts; outcomes below zero
    count as zero.  Games with the same forecasts share one computation, and forecasts with the same fractions one
    lattice of outcomes.
    """
    pools = residual_pools(games, season, segment, home, away, mu_home, mu_away, window, grid)
    mh, ma = (near(F.col(m) * grid).cast("int") for m in (mu_home, mu_away))
    classes = games.select(season, segment, mh.alias("mh"), ma.alias("ma")).dropna().distinct()
    classes = classes.withColumns({"fh": F.pmod("mh", F.lit(grid)), "fa": F.pmod("ma", F.lit(grid))})
    shift = lambda f, e: F.floor((F.col(f) + F.col(e)) / grid + 0.5).cast("int")
    fractions = classes.select(season, segment, "fh", "fa").distinct()
    lattice = pools.join(fractions, [season, segment]).groupBy(season, segment, "fh", "fa", shift("fh", "eh").alias("i"), shift("fa", "ea").alias("j")).agg(F.sum("n").alias("n"))
    sizes = pools.groupBy(season, segment).agg(F.sum("n").alias("m"))
    outcome = classes.join(lattice, [season, segment, "fh", "fa"]).join(sizes, [season, segment])
    whole = lambda m, f, i: F.greatest(((F.col(m) - F.col(f)) / grid).cast("int") + F.col(i), F.lit(0))
    return outcome.select(season, segment, "mh", "ma", whole("mh", "fh", "i").alias("h"), whole("ma", "fa", "j").alias("a"), (F.col("n") / F.col("m")).alias("p"))


def joint_totals(games: DataFrame, season: str, segment: str, home: str, away: str, overtime: str, mu_home: str, mu_away: str, window: int = 3, top: int = 150, grid: int = GRID) -> tuple[DataFrame, DataFrame]:
    """Totals with overtime and both sides' chances, for every pair of forecasts that occurs.

    ``home`` and ``away`` are points of regulation time, ``overtime`` what a tied game adds.  The first table has season,
    segment, mh, ma, k, p, cdf for totals 0 .. ``top`` (higher ones count as ``top``), and what the distribution scores
    if the total is k: crps and pit (the middle of the jump); the second home_win (a tie is half a win), p_tie and the
    mean total.  The lattice's diagonal is convolved with the overtime points of the window's seasons that had any.
    """
    key = [season, segment, "mh", "ma"]
    outcome = joint_outcomes(games, season, segment, home, away, mu_home, mu_away, window, grid)
    # all that follows needs totals and who leads only: a class has some hundred rows instead of its lattice
    outcome = outcome.groupBy(*key, (F.col("h") + F.col("a")).alias("k"), F.signum(F.col("h") - F.col("a")).alias("lead")).agg(F.sum("p").alias("p"))
    tie = F.col("lead") == 0
    over = windowed(games.filter(F.col(overtime).isNotNull()).groupBy(season, F.col(overtime).cast("int").alias("ot")).agg(F.count(F.lit(1)).alias("n")), games, season, window, ["ot"])
    share = over.join(over.groupBy(season).agg(F.sum("n").alias("m")), season).select(season, "ot", (F.col("n") / F.col("m")).alias("q"))
    tied = outcome.filter(tie).join(share, season, "left").select(*key, (F.col("k") + F.coalesce("ot", F.lit(0))).alias("k"), (F.col("p") * F.coalesce("q", F.lit(1.0))).alias("p"))
    decided = outcome.filter(~tie).select(*key, "k", "p")
    total = decided.unionByName(tied).groupBy(*key, F.least("k", F.lit(top)).alias("k")).agg(F.sum("p").alias("p"))
    sides = outcome.groupBy(*key).agg((F.coalesce(F.sum(F.when(F.col("lead") > 0, F.col("p"))), F.lit(0.0)) + F.coalesce(F.sum(F.when(tie, F.col("p"))), F.lit(0.0)) / 2).alias("home_win"), F.coalesce(F.sum(F.when(tie, F.col("p"))), F.lit(0.0)).alias("p_tie"))
    means = total.groupBy(*key).agg(F.sum(F.col("k") * F.col("p")).alias("mean"))
    sides = sides.join(means, key)
    every = total.select(*key).distinct().select(*key, F.explode(F.sequence(F.lit(0), F.lit(top))).alias("k"))
    dense = every.join(total, [*key, "k"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    w = Window.partitionBy(*key).orderBy("k")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    dense = dense.withColumn("cdf", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    low, high = F.sum(F.col("cdf") * F.col("cdf")).over(before), F.sum((1 - F.col("cdf")) * (1 - F.col("cdf"))).over(after)
    return dense.withColumn("crps", F.coalesce(low, F.lit(0.0)) + high).withColumn("pit", F.col("cdf") - F.col("p") / 2), sides


# Censored scores of both sides.


def mills(a: Column, depth: int = 60) -> Column:
    """Density over upper tail of the standard normal at ``a``; a continued fraction where the tail is small."""
    density = F.exp(-a * a / 2) * 0.3989422804014327
    x = F.greatest(a, F.lit(1.5))
    below = x
    for k in range(depth, 0, -1):
        below = x + k / below
    return F.when(a > 1.5, below).otherwise(density / norm_cdf(-a))


def _solved(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(h, g)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(h) @ g


def censored_fit(df: DataFrame, x: str, y: str, by: list[str], floor: float = 0.0, rounds: int = 25) -> DataFrame:
    """Line and spread of a score that is seen only above ``floor``, for each group, with standard errors.

    Maximum likelihood by Newton steps in slopes over spread and inverse spread, where the likelihood is concave: a round
    is one aggregate over the distinct (x, y) of all groups, which are counted once.  Standard errors come from the outer products of the rows' scores in
    (alpha, beta, log sigma).  Returns alpha, beta, sigma, se_alpha, se_beta, se_sigma, n, n_censored; the driver holds
    three numbers a group.  Groups whose rows are all censored or whose x does not vary are left out.
    """
    rows = df.dropna(subset=[x, y]).select(*by, F.col(x).cast("double").alias("__x"), F.greatest(F.col(y).cast("double"), F.lit(floor)).alias("__y"))
    rows = rows.groupBy(*by, "__x", "__y").agg(F.count(F.lit(1)).cast("double").alias("__w")).persist()
    try:
        cut = F.col("__y") <= floor
        w, dx, dy = F.col("__w"), F.col("__x") - F.col("__mx"), F.col("__y") - F.col("__my")
        means = rows.groupBy(*(F.col(b).alias(f"__by_{b}") for b in by)).agg(F.sum("__w").cast("long").alias("n"), F.coalesce(F.sum(F.when(cut, w)), F.lit(0)).cast("long").alias("c"), (F.sum(w * F.col("__x")) / F.sum(w)).alias("__mx"), (F.sum(w * F.col("__y")) / F.sum(w)).alias("__my"))
        near_mean = rows.join(F.broadcast(means), [F.col(b).eqNullSafe(F.col(f"__by_{b}")) for b in by] or F.lit(True))  # a row a group
        spread = near_mean.groupBy(*by).agg(*(F.first(c).alias(c) for c in ("n", "c", "__mx", "__my")), F.sum(w * dx * dx).alias("sxx"), F.sum(w * dx * dy).alias("sxy"), F.sum(w * dy * dy).alias("syy"))
        slope = F.col("sxy") / F.nullif(F.col("sxx"), F.lit(0.0))
        start = spread.select(*by, "n", "c", slope.alias("b"), (F.col("__my") - slope * F.col("__mx")).alias("a"), (F.col("syy") / F.col("n")).alias("v"), "sxx").collect()
        held = {tuple(r[b] for b in by): r for r in start if r["n"] > 3 and r["c"] < r["n"] and (r["sxx"] or 0) > 0 and r["v"] > 0}
        kinds = ", ".join([*(f"`{b}` {dict(df.dtypes)[b]}" for b in by), "__p double, __q double, __g double"])
        at = {k: np.array([r["a"], r["b"], 1.0]) / math.sqrt(max(r["v"] - r["b"] ** 2 * r["sxx"] / r["n"], 1e-9)) for k, r in held.items()}
        live = set(at)

        def joined(values: dict) -> DataFrame:
            params = df.sparkSession.createDataFrame([(*k, *map(float, v)) for k, v in values.items()], kinds)
            params = params.select(*(F.col(b).alias(f"__by_{b}") for b in by), "__p", "__q", "__g")
            return rows.join(F.broadcast(params), [F.col(b).eqNullSafe(F.col(f"__by_{b}")) for b in by] or F.lit(True))

        for _ in range(rounds):
            if not live:
                break
            own, g = F.col("__p") + F.col("__q") * F.col("__x"), F.col("__g")
            r, a, m = g * F.col("__y") - own, g * floor - own, F.col("__m")
            h = -m * (a + m)
            one = lambda u, v: F.sum(w * F.when(cut, u).otherwise(v))
            now = joined({k: at[k] for k in live}).withColumn("__m", F.when(cut, mills(own - g * floor)))  # density over distribution function at a
            sums = now.groupBy(*by).agg(
                one(-m, r).alias("g0"), one(-m * F.col("__x"), r * F.col("__x")).alias("g1"), one(m * floor, 1 / g - r * F.col("__y")).alias("g2"),
                one(h, F.lit(-1.0)).alias("h00"), one(h * F.col("__x"), -F.col("__x")).alias("h01"), one(h * F.col("__x") * F.col("__x"), -F.col("__x") * F.col("__x")).alias("h11"),
                one(-h * floor, F.col("__y")).alias("h02"), one(-h * floor * F.col("__x"), F.col("__x") * F.col("__y")).alias("h12"), one(h * floor * floor, -1 / (g * g) - F.col("__y") * F.col("__y")).alias("h22"),
            ).collect()
            for s in sums:
                k = tuple(s[b] for b in by)
                hess = np.array([[s["h00"], s["h01"], s["h02"]], [s["h01"], s["h11"], s["h12"]], [s["h02"], s["h12"], s["h22"]]])
                step = -_solved(hess, np.array([s["g0"], s["g1"], s["g2"]]))
                while at[k][2] + step[2] <= 0:
                    step /= 2
                at[k] = at[k] + step
                if np.abs(step).max() < 1e-7 * (1 + np.abs(at[k]).max()):
                    live.discard(k)
        mu, s = (F.col("__p") + F.col("__q") * F.col("__x")) / F.col("__g"), 1 / F.col("__g")
        z, a = (F.col("__y") - mu) / s, (mu - floor) / s
        lam = F.col("__m")
        score = [F.when(cut, -lam / s).otherwise(z / s), F.when(cut, -lam / s * F.col("__x")).otherwise(z / s * F.col("__x")), F.when(cut, a * lam).otherwise(z * z - 1)]
        out = []
        if at:
            opg = joined(at).withColumn("__m", F.when(cut, mills(a))).groupBy(*by).agg(*(F.sum(w * score[i] * score[j]).alias(f"o{i}{j}") for i in range(3) for j in range(i, 3))).collect()
            for r in opg:
                k = tuple(r[b] for b in by)
                o = np.array([[r[f"o{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
                se = np.sqrt(np.maximum(np.diag(_solved(o, np.eye(3))), 0))
                p, q, g = at[k]
                out.append((*k, p / g, q / g, 1 / g, float(se[0]), float(se[1]), float(se[2] / g), held[k]["n"], held[k]["c"]))
        out = [tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in out]
        schema = ", ".join([*(f"`{b}` {dict(df.dtypes)[b]}" for b in by), "alpha double, beta double, sigma double, se_alpha double, se_beta double, se_sigma double, n long, n_censored long"])
        return df.sparkSession.createDataFrame(out, schema)
    finally:
        rows.unpersist()


def error_correlation(df: DataFrame, a: str, mean_a: Column, b: str, mean_b: Column, by: list[str], floor: float = 0.0) -> DataFrame:
    """rho and n: correlation of both sides' errors over the games in which neither is censored."""
    both = df.filter((F.col(a) > floor) & (F.col(b) > floor))
    return both.groupBy(*by).agg(F.corr(F.col(a) - mean_a, F.col(b) - mean_b).alias("rho"), F.count(F.lit(1)).alias("n"))


def _nodes(n: int) -> Column:
    x, w = np.polynomial.legendre.leggauss(n)
    return F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("w")) for a, b in zip(x, w, strict=True)))


def correlated_over(mean_a: Column, mean_b: Column, sd_a: Column, sd_b: Column, rho: Column, line: Column, nodes: int = 40) -> Column:
    """P(max(A, 0) + max(B, 0) > line) of a normal pair with correlation, for a line of zero or more.

    Given A, B is normal; the outer integral runs over A below zero and between zero and the line (above it the total
    exceeds the line anyway), each by Gauss-Legendre points over the part within nine standard deviations.  No simulation.
    """
    sd = sd_b * F.sqrt(F.greatest(1 - rho * rho, F.lit(1e-12)))
    near_ = lambda z: F.greatest(F.least(z, F.lit(9.0)), F.lit(-9.0))
    z0, z1 = near_(-mean_a / sd_a), near_((line - mean_a) / sd_a)
    held = F.struct(*(c.cast("double").alias(n) for c, n in ((mean_a, "ma"), (mean_b, "mb"), (sd_a, "sa"), (sd_b, "sb"), (rho, "rho"), (sd, "sd"), (line, "line"), (z0, "z0"), (z1, "z1"))))

    def piece(v: Column, lo: Column, hi: Column) -> Column:
        def term(s: Column, node: Column) -> Column:
            z = (lo + hi) / 2 + (hi - lo) / 2 * node["x"]
            need = v["line"] - F.greatest(v["ma"] + v["sa"] * z, F.lit(0.0))
            p = norm_cdf((v["mb"] + v["rho"] * v["sb"] * z - need) / v["sd"])
            return s + node["w"] * F.exp(-z * z / 2) * 0.3989422804014327 * p

        return F.aggregate(_nodes(nodes), F.lit(0.0), term) * (hi - lo) / 2

    one = F.transform(F.array(held), lambda v: piece(v, F.lit(-9.0), v["z0"]) + piece(v, v["z0"], v["z1"]) + norm_cdf(-v["z1"]))
    return F.when(line >= 0, F.least(F.lit(1.0), F.get(one, F.lit(0))))

"""Statistical tests from grouped sums.

Everything that grows with the data is aggregated by Spark to one row a group, cluster or cell; the
formulas are columns over those rows.  Resampling works on cluster sums: each cluster draws how often
it enters each replicate (Poisson weights by hash), so no replicate needs a pass over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.odds import implied_probability
from ..functions.special import binomial_upper
from ..functions.stats import norm_cdf

#: Normal quantiles of a two-sided 5 % test and of a power of 80 %.
Z_TEST, Z_POWER = 1.959963984540054, 0.8416212335729143


def roi_test(bets: DataFrame, by: list[str], stake: float = 100.0) -> DataFrame:
    """Return on stake with its standard error (population variance over all bets, pushes too) and t value."""
    r = F.col("profit").cast("double") / stake
    out = bets.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("roi"), F.var_pop(r).alias("v"))
    se = F.sqrt(F.col("v") / F.col("n"))
    return out.select(*by, "n", "roi", se.alias("se"), (F.col("roi") / F.nullif(se, F.lit(0.0))).alias("t"))


def detectable(n: Column, p0: Column, deff: Column) -> Column:
    """The smallest edge over ``p0`` that ``n`` bets show with 80 % power."""
    return (Z_TEST + Z_POWER) * F.sqrt(p0 * (1 - p0) / F.nullif(n, F.lit(0))) * F.sqrt(deff)


def binomial_tail(wins: Column, n: Column, p: Column) -> Column:
    """P(X >= wins) of ``n`` trials: the probability that break-even bets do at least as well.

    The exact tail, as an incomplete beta function; it replaces a simulated permutation of the results.
    """
    return binomial_upper(wins, n, p)


def sign_consistency(bets: DataFrame, by: list[str], season: str) -> DataFrame:
    """Seasons with a profit among all seasons with a bet."""
    per = bets.groupBy(*by, season).agg(F.sum("profit").alias("p"))
    return per.groupBy(*by).agg(F.count_if(F.col("p") > 0).alias("profitable"), F.count(F.lit(1)).alias("seasons"))


def letter_grade(score: Column) -> Column:
    """A to F by fifths of a score between 0 and 1."""
    return F.when(score >= 0.8, "A").when(score >= 0.6, "B").when(score >= 0.4, "C").when(score >= 0.2, "D").when(score.isNotNull(), "F")


def longest_runs(bets: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Longest winning and losing run; pushes are transparent."""
    decided = bets.filter("result <> 'P'")
    w = Window.partitionBy(*by).orderBy(*order)
    change = (~F.col("result").eqNullSafe(F.lag("result").over(w))).cast("int")
    runs = decided.withColumn("__c", change).withColumn("__r", F.sum("__c").over(w)).groupBy(*by, "__r", "result").agg(F.count(F.lit(1)).alias("n"))
    longest = lambda x: F.coalesce(F.max(F.when(F.col("result") == x, F.col("n"))), F.lit(0))
    return runs.groupBy(*by).agg(longest("W").alias("longest_win"), longest("L").alias("longest_loss"))


def cluster_bootstrap(df: DataFrame, x: str, weight: Column, cluster: list[str], by: list[str], draws: int = 200, seed: int = 7) -> DataFrame:
    """Bootstrap interval of sum(x) / sum(weight) with whole clusters redrawn.

    Each cluster enters a replicate Poisson(1) times (by hash of cluster, replicate and seed), the
    distributed form of drawing with replacement; replicates are summed with map-side combining.
    """
    per = df.groupBy(*by, *cluster).agg(F.sum(x).cast("double").alias("s"), F.sum(weight).cast("double").alias("n"))
    each = per.select(*by, *cluster, "s", "n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    u = (F.pmod(F.xxhash64(*cluster, "draw", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    times, cumulated, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        cumulated += p
        p /= k
        times = F.when(u >= cumulated, k).otherwise(times)
    sums = each.withColumn("t", times).groupBy(*by, "draw").agg((F.sum(F.col("s") * F.col("t")) / F.nullif(F.sum(F.col("n") * F.col("t")), F.lit(0.0))).alias("r"))
    return sums.groupBy(*by).agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high"), F.count("r").alias("draws"))


def paired_scores(df: DataFrame, truth: str, a: str, b: str, by: list[str]) -> DataFrame:
    """Squared and absolute error of forecast ``a`` less those of ``b``, and how often ``a`` is nearer."""
    ea, eb = F.col(a) - F.col(truth), F.col(b) - F.col(truth)
    ok = df.filter(F.col(truth).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(ea * ea - eb * eb).alias("d_mse"), F.avg(F.abs(ea) - F.abs(eb)).alias("d_mae"), F.avg((F.abs(ea) < F.abs(eb)).cast("int")).alias("nearer"))


def wild_mean(df: DataFrame, x: str, cluster: list[str], by: list[str], enumerated: int = 12, draws: int = 4096, least: int = 6) -> DataFrame:
    """Mean of ``x`` with interval and two-sided p-value by the wild cluster bootstrap-t, the null imposed.

    Values are centred on the mean, whole clusters get random signs, and every draw has its own cluster-robust error;
    draws need the clusters' sums only.  Up to ``enumerated`` clusters all sign patterns are taken, beyond that ``draws``
    patterns by hash.  Fewer than ``least`` clusters have a mean but no interval: signs of a few say nothing.
    """
    per = df.filter(F.col(x).isNotNull()).groupBy(*by, *cluster).agg(F.sum(x).cast("double").alias("__s"), F.count(F.lit(1)).cast("double").alias("__n"))
    w = Window.partitionBy(*by)
    per = per.withColumns({"__g": F.row_number().over(w.orderBy(*cluster)) - 1, "__k": F.count(F.lit(1)).over(w), "__total": F.sum("__n").over(w), "__mean": F.sum("__s").over(w) / F.sum("__n").over(w)})
    per = per.withColumn("__c", F.col("__s") - F.col("__mean") * F.col("__n"))
    scale = lambda k: F.sqrt(k / F.greatest(k - 1, F.lit(1)))
    own = per.groupBy(*by).agg(F.sum("__n").cast("long").alias("n"), F.first("__k").alias("clusters"), F.first("__mean").alias("mean"), (scale(F.first("__k")) * F.sqrt(F.sum(F.col("__c") * F.col("__c"))) / F.first("__total")).alias("se"))
    own = own.withColumn("t", F.col("mean") / F.nullif(F.col("se"), F.lit(0.0)))
    patterns = F.when(F.col("__k") <= enumerated, F.pow(F.lit(2), F.col("__k"))).otherwise(F.lit(draws)).cast("int")
    each = per.filter(F.col("__k") >= least).withColumn("__draw", F.explode(F.sequence(F.lit(0), patterns - 1)))
    bit = F.when(F.col("__k") <= enumerated, F.expr("(__draw >> CAST(__g AS INT)) & 1")).otherwise(F.pmod(F.xxhash64("__draw", *cluster), F.lit(2)).cast("int"))
    star = each.withColumn("__r", F.col("__c") * (2 * bit - 1))
    product = lambda i, j: F.sum(F.col(i) * F.col(j))
    sums = star.groupBy(*by, "__draw").agg(F.first("__k").alias("k"), F.first("__total").alias("total"), F.sum("__r").alias("sr"), product("__r", "__r").alias("rr"), product("__r", "__n").alias("rn"), product("__n", "__n").alias("nn"))
    mean = F.col("sr") / F.col("total")
    # the draw's own residuals, cluster by cluster: r less its mean times the cluster's size
    square = F.greatest(F.col("rr") - 2 * mean * F.col("rn") + mean * mean * F.col("nn"), F.lit(0.0))
    se = scale(F.col("k")) * F.sqrt(square) / F.col("total")
    ts = sums.select(*(F.col(b).alias(f"__by_{b}") for b in by), F.when(se > 1e-12, mean / se).otherwise(0.0).alias("__ts"))
    both = own.join(ts, [F.col(b).eqNullSafe(F.col(f"__by_{b}")) for b in by] or F.lit(True), "left")
    out = both.groupBy(*by).agg(*(F.first(c).alias(c) for c in ("n", "clusters", "mean", "se", "t")), F.percentile("__ts", F.array(F.lit(0.025), F.lit(0.975))).alias("__q"), F.avg((F.abs("__ts") >= F.abs("t") - 1e-9).cast("int")).alias("p"))
    low, high = (F.col("mean") - F.get("__q", F.lit(i)) * F.col("se") for i in (1, 0))
    return out.select(*by, "n", "clusters", "mean", "t", low.alias("low"), high.alias("high"), F.when(F.col("t").isNotNull(), F.col("p")).alias("p"))


def clark_west(df: DataFrame, truth: str, small: str, large: str, cluster: list[str], by: list[str]) -> DataFrame:
    """Whether a nesting forecast beats the nested one: mean adjusted loss difference and one-sided p by the wild cluster bootstrap."""
    e1, e2, gap = F.col(truth) - F.col(small), F.col(truth) - F.col(large), F.col(small) - F.col(large)
    rows = df.withColumn("__f", e1 * e1 - (e2 * e2 - gap * gap))
    out = wild_mean(rows, "__f", cluster, by)
    return out.withColumn("p", F.when(F.col("mean") > 0, F.col("p") / 2).otherwise(1 - F.col("p") / 2))


def cluster_ols(df: DataFrame, x: str, y: str, cluster: list[str], by: list[str]) -> DataFrame:
    """Slope of y on x with a standard error robust to clusters (CR1), from two passes of grouped sums."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, *cluster, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    m = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_slope("y", "x").alias("slope"), F.regr_sxx("y", "x").alias("sxx"))
    # the score of a cluster needs sums only, not the residuals row by row
    c = ok.groupBy(*by, *cluster).agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.count(F.lit(1)).alias("k"))
    c = c.join(m, by) if by else c.crossJoin(F.broadcast(m))
    icpt = F.col("my") - F.col("slope") * F.col("mx")
    score = F.col("xy") - F.col("mx") * F.col("sy") - icpt * (F.col("sx") - F.col("mx") * F.col("k")) - F.col("slope") * (F.col("xx") - F.col("mx") * F.col("sx"))
    g = F.count(F.lit(1))
    out = c.groupBy(*by).agg(F.first("n").alias("n"), g.alias("clusters"), F.first("slope").alias("slope"), F.first("sxx").alias("sxx"), F.sum(score * score).alias("meat"))
    scale = F.col("clusters") / (F.col("clusters") - 1) * (F.col("n") - 1) / (F.col("n") - 2)
    return out.select(*by, "n", "clusters", "slope", (F.sqrt(scale * F.col("meat")) / F.col("sxx")).alias("se"))


def likelihood_ratio(wins: Column, n: Column, p0: Column) -> Column:
    """Twice the log likelihood ratio of the own rate against ``p0`` (chi-square with one degree of freedom)."""
    p = wins / n
    part = lambda k, a, b: F.when(k > 0, k * F.log(a / b)).otherwise(0.0)
    return 2 * (part(wins, p, p0) + part(n - wins, 1 - p, 1 - p0))


def chi2_tail_1(x: Column) -> Column:
    """P(chi-square with one degree of freedom > x)."""
    return 2 * (1 - norm_cdf(F.sqrt(F.greatest(x, F.lit(0.0)))))


def mantel_haenszel(df: DataFrame, exposed: str, hit: str, strata: list[str], by: list[str]) -> DataFrame:
    """Stratified 2 x 2 test with continuity correction, and the pooled odds ratio."""
    cell = lambda e, h: F.count_if((F.col(exposed) == e) & (F.col(hit) == h)).cast("double")
    t = df.groupBy(*by, *strata).agg(cell(True, True).alias("a"), cell(True, False).alias("b"), cell(False, True).alias("c"), cell(False, False).alias("d"))
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    r1, r2, c1, c2 = F.col("a") + F.col("b"), F.col("c") + F.col("d"), F.col("a") + F.col("c"), F.col("b") + F.col("d")
    t = t.filter(n > 1).select(*by, (F.col("a") - r1 * c1 / n).alias("o"), (r1 * r2 * c1 * c2 / (n * n * (n - 1))).alias("v"), (F.col("a") * F.col("d") / n).alias("up"), (F.col("b") * F.col("c") / n).alias("down"))
    out = t.groupBy(*by).agg(F.sum("o").alias("o"), F.sum("v").alias("v"), F.sum("up").alias("up"), F.sum("down").alias("down"))
    x = F.greatest(F.lit(0.0), F.abs("o") - 0.5)
    return out.select(*by, (x * x / F.nullif(F.col("v"), F.lit(0.0))).alias("chi2"), (F.col("up") / F.nullif(F.col("down"), F.lit(0.0))).alias("odds_ratio"))


def heterogeneity(df: DataFrame, group: list[str], hit: str, by: list[str]) -> DataFrame:
    """Chi-square of equal hit rates over the groups, with its degrees of freedom."""
    g = df.groupBy(*by, *group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(hit)).alias("k"))
    total = g.groupBy(*by).agg((F.sum("k") / F.sum("n")).alias("p"))
    g = g.join(total, by) if by else g.crossJoin(F.broadcast(total))
    d = F.col("k") - F.col("n") * F.col("p")
    return g.groupBy(*by).agg(F.sum(d * d / F.nullif(F.col("n") * F.col("p") * (1 - F.col("p")), F.lit(0.0))).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"))


def runs_test(df: DataFrame, hit: str, by: list[str], order: list[str]) -> DataFrame:
    """Wald-Wolfowitz: runs of equal results against what independent results would give, as a z value."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (~F.col(hit).eqNullSafe(F.lag(hit).over(w))).cast("int")
    out = df.withColumn("__n", new).groupBy(*by).agg(F.sum("__n").alias("runs"), F.count_if(F.col(hit)).cast("double").alias("a"), F.count_if(~F.col(hit)).cast("double").alias("b"))
    n, ab = F.col("a") + F.col("b"), 2 * F.col("a") * F.col("b")
    mean, var = ab / n + 1, ab * (ab - n) / (n * n * (n - 1))
    return out.select(*by, "runs", ((F.col("runs") - mean) / F.sqrt(F.nullif(var, F.lit(0.0)))).alias("z"))


def two_proportions(df: DataFrame, side: str, hit: str, by: list[str]) -> DataFrame:
    """z value of the hit rates of two sides (a boolean column), pooled variance."""
    a = df.groupBy(*by).agg(*(f.alias(n) for n, f in (("n1", F.count_if(F.col(side))), ("n0", F.count_if(~F.col(side))), ("k1", F.count_if(F.col(side) & F.col(hit))), ("k0", F.count_if(~F.col(side) & F.col(hit))))))
    p = (F.col("k1") + F.col("k0")) / (F.col("n1") + F.col("n0"))
    return a.select(*by, "n1", "n0", ((F.col("k1") / F.col("n1") - F.col("k0") / F.col("n0")) / F.sqrt(p * (1 - p) * (1 / F.col("n1") + 1 / F.col("n0")))).alias("z"))


def welch(df: DataFrame, x: str, side: str, by: list[str]) -> DataFrame:
    """t value and degrees of freedom of two means with unequal variances."""
    pick = lambda s: F.when(F.col(side) == s, F.col(x))
    a = df.groupBy(*by).agg(*(f(pick(s)).alias(f"{n}{int(s)}") for s in (True, False) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    e1, e0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    return a.select(*by, ((F.col("m1") - F.col("m0")) / F.sqrt(e1 + e0)).alias("t"), ((e1 + e0) * (e1 + e0) / (e1 * e1 / (F.col("n1") - 1) + e0 * e0 / (F.col("n0") - 1))).alias("df"))


def area_under_curve(df: DataFrame, score: str, hit: str, by: list[str]) -> DataFrame:
    """Area under the curve by rank sums: equal scores are counted first, so ranks run over distinct scores."""
    at = df.groupBy(*by, score).agg(F.count_if(F.col(hit)).alias("p"), F.count_if(~F.col(hit)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = at.withColumn("u", F.col("p") * (below + F.col("q") / 2))
    return each.groupBy(*by).agg((F.sum("u") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"))


def rank_stability(df: DataFrame, unit: str, season: str, x: str) -> DataFrame:
    """Spearman correlation of the units' values in each two neighbouring seasons."""
    now = df.select(unit, season, F.col(x).alias("x"))
    was = df.select(unit, (F.col(season) + 1).alias(season), F.col(x).alias("w"))
    both = now.join(was, [unit, season])
    mean_rank = lambda c: F.rank().over(Window.partitionBy(season).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(season, c)) - 1) / 2
    return both.withColumns({"rx": mean_rank("x"), "rw": mean_rank("w")}).groupBy(season).agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "rw").alias("rho"))


def calibration(df: DataFrame, p: str, hit: str, bins: int, by: list[str]) -> DataFrame:
    """Forecast and observed rate in equal bins of the forecast."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("said"), F.avg(F.col(hit).cast("int")).alias("came"))


def beta_posterior(wins: Column, n: Column, a: float = 1.0, b: float = 1.0) -> tuple[Column, Column]:
    """Mean and standard deviation of the posterior of a rate."""
    x, y = wins + a, n - wins + b
    return x / (x + y), F.sqrt(x * y / ((x + y) * (x + y) * (x + y + 1)))


def break_even(price: float = -110.0) -> Column:
    return implied_probability(F.lit(price))


def two_way_ols(df: DataFrame, x: str, y: str, first: list[str], second: list[str], by: list[str]) -> DataFrame:
    """Slope of y on x with a standard error robust to two clusterings: V1 + V2 - V12, each from summed scores."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("__mx"), F.avg(y).alias("__my"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("__sxx"))
    rows = ok.join(m, by)
    d = F.col(x) - F.col("__mx")
    rows = rows.withColumn("__s", d * (F.col(y) - F.col("__my") - F.col("slope") * d))
    out = m
    for name, cluster in (("a", first), ("b", second), ("ab", [*first, *second])):
        s = rows.groupBy(*by, *cluster).agg(F.sum("__s").alias("s")).groupBy(*by).agg(F.sum(F.col("s") * F.col("s")).alias(f"__{name}"))
        out = out.join(s, by)
    v = F.greatest(F.lit(0.0), F.col("__a") + F.col("__b") - F.col("__ab"))
    return out.select(*by, "n", "slope", (F.sqrt(v) / F.col("__sxx")).alias("se"))


def wild_bootstrap(df: DataFrame, x: str, cluster: list[str], by: list[str], enumerated: int = 16, draws: int = 4096) -> DataFrame:
    """p-value of a zero mean by the wild cluster bootstrap-t with signs of whole clusters.

    Up to ``enumerated`` clusters all sign patterns are weighed, beyond that ``draws`` patterns by hash.
    Patterns are taken over cluster sums: no replicate reads the rows again.
    """
    per = df.filter(F.col(x).isNotNull()).groupBy(*by, *cluster).agg(F.sum(x).cast("double").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    w = Window.partitionBy(*by)
    per = per.withColumns({"g": F.row_number().over(w.orderBy(*cluster)) - 1, "clusters_": F.count(F.lit(1)).over(w), "total": F.sum("n").over(w)}).filter("clusters_ > 1")
    patterns = F.when(F.col("clusters_") <= enumerated, F.pow(F.lit(2), F.col("clusters_"))).otherwise(F.lit(draws)).cast("int")
    each = per.withColumn("draw", F.explode(F.sequence(F.lit(0), patterns - 1)))
    bit = F.when(F.col("clusters_") <= enumerated, F.expr("(draw >> CAST(g AS INT)) & 1")).otherwise(F.pmod(F.xxhash64("draw", *cluster), F.lit(2)).cast("int"))
    r = F.col("s") * (2 * bit - 1)
    # pattern 0 turns all signs and has the t value of the data itself, up to its sign
    t = each.withColumn("r", r).groupBy(*by, "draw").agg(F.first("total").alias("total"), F.sum("r").alias("sr"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("r") * F.col("n")).alias("rn"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    mean = F.col("sr") / F.col("total")
    se = F.sqrt(F.greatest(F.lit(1e-12), F.col("rr") - 2 * mean * F.col("rn") + mean * mean * F.col("nn"))) / F.col("total")
    t = t.select(*by, "draw", F.abs(mean / se).alias("t"))
    data = per.groupBy(*by).agg(F.first("total").alias("total"), F.sum("s").alias("sr"), F.sum(F.col("s") * F.col("s")).alias("rr"), F.sum(F.col("s") * F.col("n")).alias("rn"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("clusters"))
    own = data.select(*by, "clusters", F.abs(mean / se).alias("own"))
    both = t.join(own, by) if by else t.crossJoin(F.broadcast(own))
    return both.groupBy(*by).agg(F.first("clusters").alias("clusters"), F.first("own").alias("t"), F.avg((F.col("t") >= F.col("own") - 1e-9).cast("int")).alias("p"))


def probit(df: DataFrame, columns: list[str], hit: str, rounds: int = 8) -> dict[str, float]:
    """Coefficients of P(hit) = Phi(a + b x), by scoring: each round is one aggregate over the rows; nothing without rows."""
    import numpy as np

    names = ["intercept", *columns]
    rows = df.filter(F.col(hit).isNotNull()).select(*(F.col(c).cast("double").alias(c) for c in columns), F.col(hit).cast("double").alias("__y")).dropna().persist()
    x = [F.lit(1.0), *(F.col(c) for c in columns)]
    b, k = np.zeros(len(names)), len(x)
    try:
        for _ in range(rounds):
            z = F.lit(float(b[0]))
            for value, c in zip(b[1:], columns, strict=True):
                z = z + float(value) * F.col(c)
            p = F.least(F.greatest(norm_cdf(z), F.lit(1e-9)), F.lit(1 - 1e-9))
            density = F.exp(-z * z / 2) * 0.3989422804014327
            w, u = density * density / (p * (1 - p)), (F.col("__y") - p) * density / (p * (1 - p))
            sums = rows.agg(*(F.sum(u * x[i]).alias(f"g{i}") for i in range(k)), *(F.sum(w * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k))).first()
            if sums["g0"] is None:
                return {}
            h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            b = b + np.linalg.lstsq(h, np.array([sums[f"g{i}"] for i in range(k)]), rcond=None)[0]
        return dict(zip(names, b.tolist(), strict=True))
    finally:
        rows.unpersist()


def tobit(df: DataFrame, x: str, y: str, rounds: int = 30) -> dict[str, float]:
    """Line and spread of a value that is seen only above zero, by expectation and maximisation: one aggregate a round; nothing without rows or where x or y does not vary."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).persist()
    try:
        start = rows.agg(F.regr_intercept("y", "x").alias("a"), F.regr_slope("y", "x").alias("b"), F.stddev_pop("y").alias("s")).first()
        a, b, s = start["a"], start["b"], start["s"]
        if a is None or b is None or not s:
            return {}
        for _ in range(rounds):
            mean = a + b * F.col("x")
            z = -mean / s
            ratio = F.exp(-z * z / 2) * 0.3989422804014327 / F.greatest(norm_cdf(z), F.lit(1e-12))
            # first and second moment of what lies at or below zero
            hidden = mean - s * ratio
            square = s * s * (1 - z * ratio - ratio * ratio) + hidden * hidden
            cut = F.col("y") <= 0
            e, ee = F.when(cut, hidden).otherwise(F.col("y")), F.when(cut, square).otherwise(F.col("y") * F.col("y"))
            m = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(e).alias("e"), F.sum(F.col("x") * e).alias("xe"), F.sum(ee).alias("ee")).first()
            b = (m["n"] * m["xe"] - m["x"] * m["e"]) / (m["n"] * m["xx"] - m["x"] ** 2)
            a = (m["e"] - b * m["x"]) / m["n"]
            s = max((m["ee"] - a * m["e"] - b * m["xe"]) / m["n"], 1e-12) ** 0.5
        return {"intercept": a, "slope": b, "sigma": s}
    finally:
        rows.unpersist()

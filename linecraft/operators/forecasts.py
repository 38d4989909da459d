"""Predictive distributions as arrays of probabilities, their scores, and selective prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import norm_cdf


def empirical_pmf(df: DataFrame, points: str, by: list[str]) -> DataFrame:
    """``pmf``: the share of every value 0, 1, ... up to the highest, one array a group."""
    counts = df.filter(F.col(points).isNotNull()).groupBy(*by, F.col(points).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"), F.max("k").alias("top"), F.sum("n").alias("total"))
    pmf = F.transform(F.sequence(F.lit(0), F.col("top")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)) / F.col("total"))
    return per.select(*by, pmf.alias("pmf"), "total")


def normal_pmf(mean: Column, sd: Column, top: int) -> Column:
    """Probabilities of 0 .. ``top`` of a rounded normal, the tails at the ends."""
    z = lambda x: norm_cdf((x - mean) / sd)
    return F.transform(F.sequence(F.lit(0), F.lit(top)), lambda k: F.when(k == top, F.lit(1.0)).otherwise(z(k + 0.5)) - F.when(k == 0, F.lit(0.0)).otherwise(z(k - 0.5)))


def convolve(a: Column, b: Column) -> Column:
    """Distribution of the sum of two independent values."""
    places = F.sequence(F.lit(0), F.size(a) + F.size(b) - 2)
    inner = lambda k: F.aggregate(F.sequence(F.greatest(k - F.size(b) + 1, F.lit(0)), F.least(k, F.size(a) - 1)), F.lit(0.0), lambda s, i: s + F.get(a, i) * F.get(b, k - i))
    return F.transform(places, inner)


def cumulated(pmf: Column) -> Column:
    """Distribution function of a pmf, by a fold that keeps the running sum."""
    start = F.array().cast("array<double>")
    return F.aggregate(pmf, start, lambda s, p: F.concat(s, F.array(p + F.coalesce(F.get(s, F.size(s) - 1), F.lit(0.0)))))


def crps(cdf: Column, y: Column) -> Column:
    """Continuous ranked probability score: summed squared distance of the distribution functions."""
    return F.aggregate(F.transform(cdf, lambda c, k: (c - (k >= y).cast("double")) * (c - (k >= y).cast("double"))), F.lit(0.0), lambda s, x: s + x) + F.greatest(y - F.size(cdf) + 1, F.lit(0))


def mid_pit(pmf: Column, cdf: Column, y: Column) -> Column:
    """Middle of the jump of the distribution function at ``y``."""
    return F.coalesce(F.get(cdf, y - 1), F.when(y <= 0, 0.0).otherwise(1.0)) + F.coalesce(F.get(pmf, y), F.lit(0.0)) / 2


def quantile(cdf: Column, q: float) -> Column:
    """The lowest value whose cumulated probability reaches ``q``."""
    return F.array_position(F.transform(cdf, lambda c: c >= q - 1e-12), True) - 1


def pinball(y: Column, guess: Column, q: float) -> Column:
    return F.when(y >= guess, q * (y - guess)).otherwise((1 - q) * (guess - y))


def risk_coverage(df: DataFrame, confidence: str, loss: str, by: list[str], key: str) -> DataFrame:
    """Risk of the most confident rows at every coverage; its mean is the area under the curve."""
    w = Window.partitionBy(*by).orderBy(F.desc(confidence), key)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return out.select(*df.columns, (F.col("__i") / F.col("__n")).alias("coverage"), F.avg(loss).over(so_far).alias("risk"))

"""Column functions and aggregates of the statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import rounded

#: The coefficients of the 26.2.17 approximation of the normal distribution.
_PHI = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function, absolute error below 7.5e-8.

    Divides step by step as ``NORM_CDF_SQL`` does: chances that cancel to nothing then fall on the same side of a threshold.
    """
    size, poly = 1 + _PHI[0] * F.abs(z), F.lit(_PHI[5])
    for c in _PHI[4:0:-1]:
        poly = c + poly / size
    poly = 0.0 + poly / size
    upper = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


NORM_CDF_SQL = """(CASE WHEN {z} >= 0 THEN 1 - {u} ELSE {u} END)""".replace(
    "{u}",
    "exp(-({z}) * ({z}) / 2) * 0.3989422804014327 * list_reduce([1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530, 0.0]::DOUBLE[], lambda a, b: b + a / (1 + 0.2316419 * abs({z})))",
)


#: The coefficients of Acklam's rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_quantile(p: Column) -> Column:
    """Quantile of the standard normal distribution, relative error below 1.2e-9; null outside (0, 1)."""
    q = p - 0.5
    centre = q * _poly(_A, q * q) / _poly(_B, q * q)
    tail = lambda x: _poly(_C, F.sqrt(-2 * F.log(x))) / _poly(_D, F.sqrt(-2 * F.log(x)))
    return F.when((p <= 0) | (p >= 1), None).when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(centre)


def norm_quantile_sql(p: str) -> str:
    """The same rational approximation in SQL."""

    def poly(coefficients: tuple[float, ...], x: str) -> str:
        out = f"({coefficients[0]!r})::DOUBLE"
        for c in coefficients[1:]:
            out = f"({out} * {x} + ({c!r})::DOUBLE)"
        return out

    q, tail = f"({p} - 0.5)", lambda x: f"({poly(_C, f'sqrt(-2 * ln({x}))')} / {poly(_D, f'sqrt(-2 * ln({x}))')})"
    centre = f"({q} * {poly(_A, f'({q} * {q})')} / {poly(_B, f'({q} * {q})')})"
    return f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < 0.02425 THEN {tail(p)} WHEN {p} > 1 - 0.02425 THEN -{tail(f'(1 - {p})')} ELSE {centre} END"


def wilson(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval in [0, 1], rounded to 4 digits; (0, 0) without a trial."""
    m = F.nullif(n, F.lit(0)).cast("double")
    p = wins / m
    centre, spread = p + z * z / (2 * m), z * F.sqrt((p * (1 - p) + z * z / (4 * m)) / m)
    low, high = (centre - spread) / (1 + z * z / m), (centre + spread) / (1 + z * z / m)
    none = m.isNull()
    return F.when(none, 0.0).otherwise(rounded(F.greatest(low, F.lit(0.0)), 4)), F.when(none, 0.0).otherwise(rounded(F.least(high, F.lit(1.0)), 4))


def adjusted(df: DataFrame, p: str, key: str, group: list[str]) -> DataFrame:
    """``bh`` and ``holm``: adjusted p-values within each ``group`` (grouped by a column: no single task)."""
    up = Window.partitionBy(*group).orderBy(p, key)
    every = Window.partitionBy(*group)
    out = df.withColumn("__i", F.row_number().over(up)).withColumn("__m", F.count(F.lit(1)).over(every))
    rest = Window.partitionBy(*group).orderBy(F.desc(p), F.desc(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("bh", F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__i")).over(rest)))
    out = out.withColumn("holm", F.least(F.lit(1.0), F.max(F.col(p) * (F.col("__m") - F.col("__i") + 1)).over(so_far)))
    return out.drop("__i", "__m")


def sample_moments(x: str) -> list[Column]:
    """Sample skewness and excess kurtosis."""
    n, g1, g2 = F.count(x), F.skewness(x), F.kurtosis(x)
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return [skew.alias("skewness"), kurt.alias("kurtosis")]


def clustered_mean(df: DataFrame, x: str, cluster: list[str], by: list[str]) -> DataFrame:
    """Mean of ``x`` with a cluster-robust standard error (G / (G - 1)), intra-class correlation and design effect.

    Two levels of aggregation: sums per cluster, then moments of the sums, so nothing is centred on
    a second pass over the rows.
    """
    per = df.filter(F.col(x).isNotNull()).groupBy(*by, *cluster).agg(F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("ss"), F.count(F.lit(1)).alias("n"))
    out = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum(F.col("s") * F.col("n")).alias("sn"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"),
    )
    mean, g, n = F.col("s") / F.col("n"), F.col("clusters"), F.col("n")
    out = out.withColumn("mean", mean).withColumn("se", F.when(g > 1, F.sqrt(g / (g - 1) * F.greatest(F.lit(0.0), F.col("s2") - 2 * mean * F.col("sn") + mean * mean * F.col("nn"))) / n))
    msb = (F.col("between") - F.col("s") * F.col("s") / n) / F.nullif(g - 1, F.lit(0))
    msw = (F.col("ss") - F.col("between")) / F.nullif(n - g, F.lit(0))
    m0 = (n - F.col("nn") / n) / F.nullif(g - 1, F.lit(0))
    icc = (msb - msw) / F.nullif(msb + (m0 - 1) * msw, F.lit(0.0))
    icc = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(icc, F.lit(0.0))))
    out = out.withColumn("icc", icc).withColumn("deff", 1 + (n / g - 1) * F.col("icc")).withColumn("effective_n", n / F.col("deff"))
    return out.select(*by, "clusters", "n", "mean", "se", "icc", "deff", "effective_n")

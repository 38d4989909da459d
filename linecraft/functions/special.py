"""Regularised incomplete beta and gamma functions as columns, and the exact tails that follow from them.

Both run inside the JVM: a continued fraction or a power series whose length follows from the arguments,
written as a fold over a sequence.  Tests hold them against closed forms and sums.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The coefficients of Lanczos' approximation of the gamma function (g = 7, nine terms).
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
_TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0."""
    y = x - 1
    series = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        series = series + c / (y + k)
    t = y + 7.5
    return 0.9189385332046727 + (y + 0.5) * F.log(t) - t + F.log(series)


def _steps(size: Column) -> Column:
    """1, 2, ... as far as terms of arguments of that size can matter."""
    return F.sequence(F.lit(1), F.least(F.lit(20_000), F.lit(60) + (F.sqrt(F.greatest(size, F.lit(1.0))) * 8).cast("int")))


def _safe(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, _TINY).otherwise(x)


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b); 0 and 1 outside (0, 1), null unless a and b are positive."""
    a, b, x = (c.cast("double") for c in (a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1 - x).otherwise(x)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    d0 = 1 / _safe(1 - (p + q) * z / (p + 1))
    start = F.struct(p.alias("p"), q.alias("q"), z.alias("z"), F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def turn(s: Column, top: Column) -> tuple[Column, Column, Column]:
        d, c = 1 / _safe(1 + top * s["d"]), _safe(1 + top / s["c"])
        return c, d, s["h"] * c * d

    def half(s: Column, top: Column) -> Column:
        c, d, h = turn(s, top)
        return F.struct(s["p"].alias("p"), s["q"].alias("q"), s["z"].alias("z"), c.alias("c"), d.alias("d"), h.alias("h"))

    def even(s: Column, m: Column) -> Column:
        return half(s, m * (s["q"] - m) * s["z"] / ((s["p"] + 2 * m - 1) * (s["p"] + 2 * m)))

    def odd(s: Column, m: Column) -> Column:
        return half(s, -(s["p"] + m) * (s["p"] + s["q"] + m) * s["z"] / ((s["p"] + 2 * m) * (s["p"] + 2 * m + 1)))

    # both halves of a step as one fold over 2, 3, 4, 5, ...: even places first
    twice = F.transform(F.sequence(F.lit(2), 2 * F.size(_steps(F.greatest(a, b)))), lambda i: i.cast("double"))
    done = F.aggregate(twice, start, lambda s, i: F.when(i % 2 == 0, even(s, i / 2)).otherwise(odd(s, (i - 1) / 2)))
    part = front * done["h"] / p
    return F.when((a <= 0) | (b <= 0), None).when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(swap, 1 - part).otherwise(part))


def gamma_tail(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x); 1 for x <= 0, null unless a is positive."""
    a, x = a.cast("double"), x.cast("double")
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    series = F.struct(a.alias("a"), x.alias("x"), (1 / a).alias("t"), (1 / a).alias("s"))

    def term(s: Column, k: Column) -> Column:
        t = s["t"] * s["x"] / (s["a"] + k)
        return F.struct(s["a"].alias("a"), s["x"].alias("x"), t.alias("t"), (s["s"] + t).alias("s"))

    low = 1 - front * F.aggregate(_steps(F.greatest(a, x)), series, term)["s"]
    b0 = x + 1 - a
    fraction = F.struct(a.alias("a"), b0.alias("b"), F.lit(1 / _TINY).alias("c"), (1 / _safe(b0)).alias("d"), (1 / _safe(b0)).alias("h"))

    def turn(s: Column, k: Column) -> Column:
        top, b = -k * (k - s["a"]), s["b"] + 2
        d, c = 1 / _safe(top * s["d"] + b), _safe(b + top / s["c"])
        return F.struct(s["a"].alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    high = front * F.aggregate(_steps(F.greatest(a, x)), fraction, turn)["h"]
    return F.when(a <= 0, None).when(x <= 0, 1.0).when(x < a + 1, low).otherwise(high)


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f) with d1 and d2 degrees of freedom."""
    return F.when((d2 > 0) & (f <= 0), 1.0).when(d2 > 0, beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


def t_tails(t: Column, df: Column) -> Column:
    """P(|T| > |t|) of Student's distribution."""
    return F.when(df > 0, beta_inc(df / 2, F.lit(0.5), df / (df + t * t)))


def chi2_tail(x: Column, df: Column) -> Column:
    """P(chi-square with df degrees of freedom > x)."""
    return gamma_tail(df / 2, x / 2)


def binomial_upper(wins: Column, n: Column, p: Column) -> Column:
    """P(X >= wins) of n trials."""
    return F.when(wins <= 0, 1.0).when(wins > n, 0.0).otherwise(beta_inc(F.greatest(wins, F.lit(1)), F.greatest(n - wins, F.lit(0)) + 1, p))


def beta_inc_sql(a: str, b: str, x: str, terms: int = 3000) -> str:
    """The same by its power series in DuckDB, an independent way."""

    def series(a: str, b: str, x: str) -> str:
        term = f"exp(lgamma({a} + {b} + i) - lgamma({a} + {b}) - lgamma({a} + 1 + i) + lgamma({a} + 1) + i * ln({x}))"
        return f"exp({a} * ln({x}) + {b} * ln(1 - {x}) - ln({a}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) * list_sum(list_transform(range(0, {terms}), lambda i: {term}))"

    a, b, x = f"({a})::DOUBLE", f"({b})::DOUBLE", f"({x})::DOUBLE"
    return f"CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN {x} <= ({a} + 1) / ({a} + {b} + 2) THEN {series(a, b, x)} ELSE 1 - {series(b, a, f'(1 - {x})')} END"


def f_tail_sql(f: str, d1: str, d2: str) -> str:
    return f"CASE WHEN {f} <= 0 THEN 1.0 ELSE {beta_inc_sql(f'({d2}) / 2.0::DOUBLE', f'({d1}) / 2.0::DOUBLE', f'({d2}) / (({d2}) + ({d1}) * ({f}))')} END"


def chi2_tail_sql(x: str, df: str, terms: int = 3000) -> str:
    a, h = f"(({df}) / 2.0::DOUBLE)", f"(({x}) / 2.0::DOUBLE)"
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, {terms}), lambda i: exp(({a} + i) * ln({h}) - {h} - lgamma({a} + i + 1)))) END"

"""Letter grades of systems from five scores of their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import wilson
from .testing import binomial_tail, break_even

#: Fixed bands: the least average score of each letter, and the scores' own steps (bound, score from there on).
LETTERS = ((0.85, "A"), (0.70, "B"), (0.55, "C"), (0.35, "D"), (0.0, "F"))
MARGIN, Z, TAIL, FILTERS = ((0.0, 0.3), (0.02, 0.6), (0.05, 0.8), (0.10, 1.0)), ((0.0, 0.2), (1.0, 0.5), (1.645, 0.75), (1.96, 1.0)), ((0.01, 1.0), (0.05, 0.8), (0.10, 0.5), (0.20, 0.25)), ((3, 1.0), (7, 0.75), (14, 0.5), (24, 0.25))
#: Decided bets below which the size of a sample scores nothing.
DECIDED = 30


def _from(x: Column, steps: tuple[tuple[float, float], ...]) -> Column:
    """The score of the highest bound that ``x`` reaches; 0 below all."""
    out = F.lit(0.0)
    for bound, score in steps:
        out = F.when(x >= bound, score).otherwise(out)
    return out


def _below(x: Column, steps: tuple[tuple[float, float], ...], inclusive: bool) -> Column:
    out = F.lit(0.0)
    for bound, score in reversed(steps):
        out = F.when(x <= bound if inclusive else x < bound, score).otherwise(out)
    return out


def overfit_count(system) -> int:
    """Conditions of a ``SystemFilter`` that narrow its sample: flags, bounds, listed values, feature conditions."""
    n = sum(bool(f) for f in (system.favorite, system.underdog)) + sum(b is not None for b in (system.spread_min, system.spread_max, system.total_min, system.total_max))
    n += sum(len(v) for v in (system.teams, system.conferences, system.seasons, system.weeks))
    return n + sum(len(f.value) if f.op == "in" and isinstance(f.value, (list, tuple, set, frozenset)) else 1 for f in system.features)


def graded_systems(bets: DataFrame, by: list[str], season: str = "season", filters: Column | int = 0) -> DataFrame:
    """by, decided, average and grade of each group of graded bets (result W, L or P; profit).

    The average is that of five scores: the lower Wilson bound's margin over break-even (with enough decided bets), the z
    value of the hit rate, the share of profitable seasons, the exact tail of the record, and how few conditions
    (``filters``) narrow it.  A group without a bet is absent, so it has no grade.
    """
    per = bets.groupBy(*by, season).agg(F.count_if(F.col("result") == "W").alias("w"), F.count_if(F.col("result") == "L").alias("l"), F.sum("profit").alias("p"))
    g = per.groupBy(*by).agg(F.sum("w").alias("w"), F.sum("l").alias("l"), F.count_if(F.col("p") > 0).alias("good"), F.count(F.lit(1)).alias("seasons"))
    g = g.withColumn("decided", F.col("w") + F.col("l"))
    even, n = break_even(), F.col("decided")
    rate = F.round(F.col("w") / F.nullif(n, F.lit(0)), 4)
    z = F.when(n > 0, F.round((rate - even) / F.sqrt(even * (1 - even) / F.nullif(n, F.lit(0))), 4)).otherwise(0.0)
    margin = wilson(F.col("w"), n)[0] - even
    tail = F.when(n > 0, binomial_tail(F.col("w"), F.greatest(n, F.lit(1)), even)).otherwise(1.0)
    size = F.when(n < DECIDED, 0.0).otherwise(_from(margin, MARGIN))
    count = F.lit(filters) if isinstance(filters, int) else filters
    average = (size + _from(z, Z) + F.col("good") / F.col("seasons") + _below(tail, TAIL, False) + _below(count, FILTERS, True)) / 5
    out = g.select(*by, n.alias("decided"), average.alias("average"))
    letter = F.lit("F")
    for bound, name in reversed(LETTERS):
        letter = F.when(F.col("average") >= bound, name).otherwise(letter)
    return out.withColumn("grade", letter)

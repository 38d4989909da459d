"""Column functions on prices and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def implied_probability(american: Column) -> Column:
    """Share of bets that a price needs to win: 100 / (a + 100), or a / (a + 100) for negative prices."""
    size = F.abs(american)
    return F.when(american < 0, size / (size + 100)).when(american > 0, F.lit(100.0) / (size + 100))


def decimal_price(american: Column) -> Column:
    return F.when(american < 0, 1 + F.lit(100.0) / F.abs(american)).when(american > 0, 1 + american / 100)


def payout(american: Column) -> Column:
    """What a won bet pays on one unit: the decimal price less the stake, without the rounding of a sum and a difference."""
    return F.when(american < 0, F.lit(100.0) / F.abs(american)).when(american > 0, american / 100)


def profit(result: Column, stake: Column, american: Column) -> Column:
    """Win pays the price, push nothing, loss the stake."""
    return F.when(result == "W", stake * (decimal_price(american) - 1)).when(result == "L", -stake).when(result == "P", F.lit(0.0))


def kelly(p: Column, american: Column) -> Column:
    """Share of the bankroll, 0 without an edge."""
    b = decimal_price(american) - 1
    return F.greatest(F.lit(0.0), (p * b - (1 - p)) / b)


def fair_pair(p_over: Column, p_under: Column) -> Column:
    """Probability of the first side without the margin."""
    return p_over / F.nullif(p_over + p_under, F.lit(0.0))


def clv_points(side: Column, taken: Column, close: Column) -> Column:
    """Points of closing-line value; more is better for the bettor."""
    return F.when(side.isin("home", "away", "under"), taken - close).when(side == "over", close - taken)


def snap_half(x: Column) -> Column:
    """Nearest half point, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) * 2 + 0.5) / 2

"""Quotes, execution and settlement of bets.

A quote is a book's line and American price for one side at a time; a decision is a game, a side, a
model probability and the time by which to bet.  Everything is columns over joined rows: the last
quotes of a decision come from one as-of pass per book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.odds import decimal_price, implied_probability
from ..functions.stats import norm_quantile
from .ratings import censored_bias

NO_ACTION = ("void", "cancelled", "postponed")


def settle(status: Column, margin: Column, stake: Column, american: Column) -> Column:
    """Profit of a bet: nothing for no-action and pushes, the price for a win, the stake for a loss."""
    return F.when(status.isin(*NO_ACTION) | (margin == 0), 0.0).when(margin > 0, stake * (decimal_price(american) - 1)).when(margin < 0, -stake)


def drop_reason(ticks: DataFrame) -> DataFrame:
    """Why a tick is no quote (null: it is one): not main, live, without line, without price.

    The flags are three-valued: an unknown ``live`` or ``main`` is a reason of its own.
    """
    reason = F.when(F.col("main").isNull() | F.col("live").isNull(), "unknown flag").when(~F.col("main"), "alternative").when(F.col("live"), "live").when(F.col("line").isNull(), "no line").when(F.col("price").isNull() | (F.abs("price") < 100), "no price")
    return ticks.withColumn("reason", reason)


def cents(american: Column) -> Column:
    """A price on the line without the gap from -100 to 100: +100 and -100 are 0."""
    return F.when(american >= 100, american - 100).when(american <= -100, american + 100)


def american(cents_: Column) -> Column:
    return F.when(cents_ >= 0, cents_ + 100).otherwise(cents_ - 100)


def degrade(line: Column, price: Column, points: float, cents_: int, under: bool) -> tuple[Column, Column]:
    """Line and price moved against the bettor."""
    return line - points if under else line + points, american(cents(price) - cents_)


def pmf_outcomes(pmf: Column, line: Column) -> tuple[Column, Column, Column]:
    """Probability of over, push and under of a line, from an array of probabilities of 0, 1, 2, ... points."""
    part = lambda test: F.aggregate(F.filter(F.transform(pmf, lambda p, i: F.when(test(i), p).otherwise(0.0)), lambda p: p > 0), F.lit(0.0), lambda s, p: s + p)
    return part(lambda i: i > line), part(lambda i: i == line), part(lambda i: i < line)


def expected_value(p_win: Column, p_push: Column, price: Column) -> Column:
    return p_win * (decimal_price(price) - 1) - (1 - p_win - p_push)


def compounded(bets: DataFrame, by: list[str], order: list[str], share: Column) -> DataFrame:
    """Bankroll after each bet of a ``share`` of it: the exponential of summed log growth."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bets.withColumn("bank", F.exp(F.sum(F.log1p(share * F.col("return"))).over(w)))


def bet_to(projection: Column, sigma: Column, price: Column, edge: float) -> Column:
    """The lowest half-point total at which an under still has ``edge``: solved in closed form, then rounded up."""
    z = norm_quantile(implied_probability(price) + edge)
    return F.ceil((projection + z * sigma) * 2) / 2


def bet_to_over(spread: Column, sd_dog: Column, sd_favourite: Column, threshold: float) -> Column:
    """The highest half-point total whose expected total, lifted by the floor under both scores, exceeds it by more than ``threshold``.

    The lift falls as the total rises, so halving the range of half points finds the last one that qualifies, without
    rounding; null if not even 0 does.  The spread and both sides' deviations are held fixed.
    """
    if threshold <= 0:
        raise ValueError("a positive threshold is needed")
    side = F.abs(spread)
    lift = lambda half, v: censored_bias((half / 2 - v["s"]) / 2, v["d"]) + censored_bias((half / 2 + v["s"]) / 2, v["f"])
    top = F.greatest(F.ceil(2 * (side + 20 * F.greatest(sd_dog, sd_favourite))).cast("double"), F.lit(1.0))
    start = F.struct(F.lit(-1.0).alias("low"), top.alias("high"), side.cast("double").alias("s"), sd_dog.cast("double").alias("d"), sd_favourite.cast("double").alias("f"))

    def halve(v: Column, _: Column) -> Column:
        mid = F.floor((v["low"] + v["high"]) / 2).cast("double")
        open_, fits = v["high"] - v["low"] > 1, lift(mid, v) > threshold
        low, high = F.when(open_ & fits, mid).otherwise(v["low"]), F.when(open_ & ~fits, mid).otherwise(v["high"])
        return F.struct(low.alias("low"), high.alias("high"), v["s"].alias("s"), v["d"].alias("d"), v["f"].alias("f"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve)["low"]
    return F.when(done >= 0, done / 2)


def fair_line(line: Column, p_over: Column, sigma: Column) -> Column:
    """The line at which both sides are even: shifted by the quantile of the under's fair probability."""
    return line - norm_quantile(1 - p_over) * sigma
